"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The vocabulary is a tree of softmaxes of FAN outcomes: the root chooses one of FAN classes of words that are spelt alike, and
within a class a Huffman tree leads to each frequent word, or to one of the class's leaves for rare words, in which words have
their smoothed training frequencies. Every string, seen or not, has a place, so that the model is proper over all texts.

Each softmax, at the root and within classes, adds to its prior log-frequencies the weights of three hashed features of the
context: the word before (2-gram), the two words before (3-gram), and the word before that one alone (skip-gram). A node of
the tree has a share of the weight table by its number of training tokens; the table grows with the training tokens.

1. One scan counts all training tokens. 2. One scan turns texts into word codes, which are stored; later scans are numpy only.
3. A scan counts outcomes by feature; from these the weights start as smoothed log-ratios to the prior. 4. An epoch of gradient
rounds: each is a scan over another part of the training rows, in which every task sums the gradient of its tokens (observed less
expected outcomes) by hashed feature; Spark adds the tasks' blocks of the table; the driver updates the weights, which the next
round gets by broadcast. 5. A scan scores all rows in sparse numpy batches, and the counts of rare words come by a shuffle join.

Texts of any length are scored with their whole context: a word's features don't depend on batches.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, frequency_cutoff, stored, text_or_empty

#: Outcomes of a softmax; leaves for rare words; smoothing of counts; words whose counts and codes are broadcast, at most.
FAN, RARE, ALPHA, HEAVY = 16, 256, 0.1, 200_000
#: Softmaxes that this share of training tokens pass have features.
LEAST_SHARE = 2.0**-9
#: The weight table has a row for every 2^THIN training tokens, about: 2^LEAST_BITS rows at least, and at most 2^MOST_BITS, what a worker holds (32 MB).
THIN, LEAST_BITS, MOST_BITS = 6, 10, 19
#: The end token: no word has white space in it.
END = b"\n"
#: Gradient rounds of an epoch, smoothing, the start's share of the log-ratios, the rate of updates, the largest weight.
ROUNDS, KAPPA, FIRST, RATE, MOST_WEIGHT = 2, 20.0, 0.6, 0.25, 8.0
#: Tokens of one numpy batch, distinct words that a task counts or remembers, rows of the weight table that travel as one.
BATCH, FLUSH, CACHE, BLOCK = 1 << 12, 200_000, 100_000, 256
#: Words, or rows of the weight table, that the driver works on at once.
SLICE = 1 << 14
#: Training tokens of one task of a gradient round.
TASK = 1 << 24
_U, _START = np.uint32, np.int32(0x7FFFFFFF)
_ONES = np.ones(FAN, np.float32)


def words_of(text: str) -> list[bytes]:
    """Words: runs of characters that aren't white space, A-Z lower-cased; without the end token."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def is_held_out(doc_id: Column, parts: int = 10) -> Column:
    """crc32 of doc_id as text, modulo parts, is 0; a null doc_id counts as empty text, so it is held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts == 0


def _counted(batches):
    from collections import Counter

    counts = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

    for batch in batches:
        for t in batch.column(0):
            counts.update(words_of(t.as_py()))
            counts[END] += 1
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of every token of docs (t), ends included."""
    return docs.select("t").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _letters(words: list[bytes]) -> np.ndarray:
    """(words, 64): how often each word has bytes of each kind."""
    out = np.empty((len(words), 64), np.float32)
    for a in range(0, len(words), SLICE):
        part = words[a : a + SLICE]
        size = np.fromiter(map(len, part), np.int64, len(part))
        raw = np.frombuffer(b"".join(part), np.uint8)
        out[a : a + SLICE] = np.bincount(np.repeat(np.arange(len(part)), size) * 64 + (raw & 63), minlength=64 * len(part)).reshape(-1, 64)
    return out


def classes_of(words: list[bytes], counts: np.ndarray, k: int = FAN) -> np.ndarray:
    """A class below k for each word, by weighted spherical k-means on letters."""
    if not words:
        return np.zeros(0, np.int64)
    x, weight = _letters(words), np.sqrt(counts).astype(np.float32)
    mean = (x * weight[:, None]).sum(0)
    x /= np.sqrt(np.maximum(mean / max(mean.sum(), 1e-9), 1e-5))  # letters that few words have tell more
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[:1]
    while len(centre) < min(k, len(words)):  # the next seed: the heaviest for its distance from those before
        centre = np.vstack([centre, x[np.argmax(weight * (1 - (x @ centre.T).max(1)).clip(0))]])
    for _ in range(8):
        own = (x @ centre.T).argmax(1)
        fresh = np.stack([weight[own == c] @ x[own == c] for c in range(len(centre))])
        size = np.linalg.norm(fresh, axis=1, keepdims=True)
        centre = np.where(size > 0, fresh / np.maximum(size, 1e-12), centre)
    return (x @ centre.T).argmax(1)


def _ending(word: bytes) -> bytes:
    return word[-2:]


class Vocabulary:
    """What every worker knows of words: codes of frequent words (0 and up), rare leaves of all others.

    A rare word's code is negative: its leaf and 23 bits of a hash, by which it is told apart as context.
    """

    def __init__(self, heavy: dict[bytes, int]):
        import zlib

        self._crc = zlib.crc32
        heavy = heavy if END in heavy else heavy | {END: 0}
        self.words = sorted(heavy, key=lambda w: (-heavy[w], w))
        self.count = np.array([heavy[w] for w in self.words], float)
        self.codes = {w: i for i, w in enumerate(self.words)}
        self.classes = classes_of(self.words, self.count + ALPHA)
        votes: dict[bytes, np.ndarray] = {}
        for w, c, n in zip(self.words, self.classes, self.count):
            votes.setdefault(_ending(w), np.zeros(FAN))[c] += n + ALPHA
        self._leaf = {e: self._leaf_in(e, int(v.argmax())) for e, v in votes.items()}  # by ending

    def _leaf_in(self, end: bytes, c: int | None = None) -> int:
        """The leaf of an ending: that of its class, or of some class if no frequent word has it."""
        at = self._crc(end)
        return (at >> 8 & (FAN - 1) if c is None else c) * (RARE // FAN) + at % (RARE // FAN)

    def leaf_of(self, word: bytes) -> int:
        """The leaf of a word that isn't frequent."""
        end = _ending(word)
        found = self._leaf.get(end)
        return self._leaf_in(end) if found is None else found

    def code_of(self, word: bytes) -> int:
        return -1 - (self.leaf_of(word) | (self._crc(word) & 0x7FFFFF) << 8)


class Coder:
    """Codes of a text's tokens through a bounded cache of rare words; the vocabulary keeps it for a worker's later tasks."""

    def __init__(self, v: Vocabulary):
        self._v, self._known = v, dict(v.codes)
        self._most = len(self._known) + CACHE

    @staticmethod
    def of(v: Vocabulary) -> Coder:
        if not hasattr(v, "coder"):
            v.coder = Coder(v)
        return v.coder

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            fresh = set(words).difference(known)
            if len(known) + len(fresh) > self._most:
                known.clear()
                known.update(self._v.codes)
                fresh = set(words).difference(known)
            known.update(zip(fresh, map(self._v.code_of, fresh)))
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def leaves(codes: np.ndarray) -> np.ndarray:
    """The leaf of each code: rare leaves come first, then frequent words."""
    return np.where(codes >= 0, codes + RARE, (-1 - codes) & (RARE - 1))


class Tree:
    """Softmaxes (nodes) on the way to each leaf. weight: training mass of each leaf, all over 0; rows: of the weight table."""

    def __init__(self, classes: np.ndarray, weight: np.ndarray, rows: int):
        n = len(weight)
        parent, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parents, slots, mass = [-1], [0], [float(weight.sum())]  # of nodes; 0 is the root
        self.bias = [np.full(FAN, -np.inf)]
        for c in range(FAN):
            heap = [(float(weight[x]), int(x)) for x in np.flatnonzero(classes == c)]
            heapq.heapify(heap)
            take = (len(heap) - 2) % (FAN - 1) + 2
            while True:
                some = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
                at, take, total = len(parents), FAN, sum(w for w, _ in some)
                bias = np.full(FAN, -np.inf)
                for k, (w, x) in enumerate(some):
                    if x < n:
                        parent[x], slot[x] = at, k
                    else:
                        parents[x - n], slots[x - n] = at, k
                    bias[k] = np.log(w / total)
                parents.append(0)
                slots.append(c)
                mass.append(total)
                self.bias.append(bias)
                if not heap:
                    break
                heapq.heappush(heap, (total, n + at))
            self.bias[0][c] = np.log(total / mass[0])
        self.bias = np.stack(self.bias).astype(np.float32)
        # nodes that few tokens pass have no features: below them a leaf has its prior, below[leaf]
        least = LEAST_SHARE * mass[0]
        self.depth, self.start, self.below = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        nodes, outcomes = [], []
        for x in range(n):
            at, k, self.start[x] = int(parent[x]), int(slot[x]), len(nodes)
            while at >= 0:
                if mass[at] >= least:
                    nodes.append(at)
                    outcomes.append(k)
                else:
                    self.below[x] += self.bias[at][k]
                at, k = parents[at], slots[at]
            self.depth[x] = len(nodes) - self.start[x]
        self.nodes, self.outcomes = np.array(nodes, np.int32), np.array(outcomes, np.int8)
        share = np.array(mass) * (np.array(mass) >= least)
        share = np.maximum(1, share / share.sum() * rows).astype(np.int64)
        self.size, self.base = share.astype(np.uint64), np.concatenate(([0], np.cumsum(share)[:-1])).astype(np.uint64)
        self.rows = int(share.sum())
        self.owner = np.repeat(np.arange(len(share), dtype=np.int32), share)  # the node of each row of the table


def _hash(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(15)
    x *= _U(0x2C1B3C6D)
    x ^= x >> _U(12)
    x *= _U(0x297A2D39)
    x ^= x >> _U(15)
    return x


def contexts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(3, n) context hashes of every token: 2-gram, 3-gram, skip-gram. first: where texts begin."""
    one = np.concatenate(([_START], codes[:-1]))
    one[first] = _START
    two = np.concatenate(([_START], one[:-1]))
    two[first] = _START
    one, two = one.view(_U) * _U(0x9E3779B1), two.view(_U) * _U(0x85EBCA77)
    return np.stack([_hash(one + _U(1)), _hash(one + two + _U(2)), _hash(two + _U(3))])


class Visits:
    """The softmaxes that a run of tokens passes: token, node, outcome, and the table's rows of the three features."""

    def __init__(self, tree: Tree, codes: np.ndarray, hashes: np.ndarray):
        leaf = leaves(codes)
        depth = tree.depth[leaf]
        ends = np.cumsum(depth)
        at = np.repeat(tree.start[leaf] - (ends - depth), depth) + np.arange(ends[-1])
        self.token = np.repeat(np.arange(len(codes)), depth)
        self.node, self.outcome = tree.nodes[at], tree.outcomes[at]
        size, base = tree.size[self.node], tree.base[self.node]
        self.rows = [((h.astype(np.uint64)[self.token] * size >> np.uint64(32)) + base).astype(np.int64) for h in hashes]

    def logits(self, tree: Tree, weights: np.ndarray) -> np.ndarray:
        z = tree.bias[self.node]
        for r in self.rows:
            z += weights.take(r, axis=0)
        return z


def _runs(texts, batch: int):
    """From arrays of codes: (codes, context hashes, number of the text) of runs of at most `batch` tokens. Contexts are those of
    the whole text, also where a run begins inside it."""
    held, n = [], 0

    def out():
        codes = np.concatenate([c for _, c in held])
        size = np.array([len(c) for _, c in held])
        hashes, own = contexts(codes, np.concatenate(([0], np.cumsum(size)[:-1]))), np.repeat([k for k, _ in held], size)
        for a in range(0, len(codes), batch):
            yield codes[a : a + batch], hashes[:, a : a + batch], own[a : a + batch]

    for k, c in texts:
        held.append((k, c))
        n += len(c)
        if n >= batch:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def _codes(column, rows: int):
    return ((k, np.frombuffer(c.as_buffer(), np.int32)) for k, c in zip(range(rows), column))


def _coded(vocabulary):
    """A row per text: its codes, its tokens' number, and the rare words that the join has to look up."""

    def run(batches):
        coder = Coder.of(vocabulary.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [[*words_of(t), END] for t in part.column(3).to_pylist()]
                codes = [coder(words) for words in texts]
                rare = [[words[i] for i in np.flatnonzero(c < 0).tolist()] for words, c in zip(texts, codes)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "doc_id", "held_out", "codes", "rare"])

    return run


def _packed(x: np.ndarray) -> bytes:
    """The upper halves of 32-bit floats, rounded: sums travel with three digits; whole numbers up to 256 are exact."""
    return ((x.view(_U) + _U(0x8000)) >> _U(16)).astype(np.uint16).tobytes()


def _widened(x: np.ndarray) -> np.ndarray:
    return (x.astype(_U) << _U(16)).view(np.float32)


def _unpacked(raw) -> np.ndarray:
    return _widened(np.frombuffer(raw, np.uint16))


def _blocks(table: np.ndarray):
    """(block, binary) batches of a table's rows, BLOCK rows in each; blocks of zeros are left out."""
    at = [b for b in range(0, len(table), BLOCK) if table[b : b + BLOCK].any()]
    for k in range(0, len(at), 256):
        some = at[k : k + 256]
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in some], pa.int32()), pa.array([_packed(table[b : b + BLOCK]) for b in some], pa.binary())], names=["block", "held"])


def _gathered(tree, weights):
    """Sums over a task's tokens by row of the table: outcomes (no weights), or observed less expected outcomes."""

    def run(batches):
        t, w = tree.value, weights.value if weights else None
        total = np.zeros((t.rows, FAN), np.float32)
        flat, pairs = total.reshape(-1), total.view(np.complex64).reshape(-1)  # two outcomes are added at a time
        for batch in batches:
            for codes, hashes, _ in _runs(_codes(batch.column(0), batch.num_rows), BATCH):
                v = Visits(t, codes, hashes)
                if w is None:
                    for r in v.rows:
                        np.add.at(flat, r * FAN + v.outcome, np.float32(1))
                    continue
                z = v.logits(t, w)
                np.exp(z, out=z)
                z *= (-1 / (z @ _ONES))[:, None]
                z[np.arange(len(z)), v.outcome] += 1
                z = z.view(np.complex64).reshape(-1)
                for r in v.rows:
                    np.add.at(pairs, ((r * (FAN // 2))[:, None] + np.arange(FAN // 2)).reshape(-1), z)
        yield from _blocks(total)

    return run


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, held in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = _unpacked(held.as_buffer())
            if b in sums:
                sums[b] += x
            else:
                sums[b] = x.astype(np.float64)
    for b, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(x.astype(np.float32))], pa.binary())], names=["block", "held"])


class Sums:
    """(rows, FAN) sums as they travel, in half the bytes of floats; a slice of rows is widened when it is asked for."""

    def __init__(self, rows: int):
        self._held = np.zeros((rows, FAN), np.uint16)

    def put(self, block: int, raw) -> None:
        x = np.frombuffer(raw, np.uint16).reshape(-1, FAN)
        self._held[block * BLOCK : block * BLOCK + len(x)] = x

    def __getitem__(self, rows: slice) -> np.ndarray:
        return _widened(self._held[rows])


def gathered(codes: DataFrame, tree, weights, rows: int, tasks: int) -> Sums:
    """Sums over all texts. The table's rows reach the driver, 2^MOST_BITS and one for each node at most."""
    parts = codes.coalesce(tasks).mapInArrow(_gathered(tree, weights), "block int, held binary")
    out = Sums(rows)
    found = parts.repartition("block").mapInArrow(_summed, "block int, held binary").collect()
    while found:  # a row goes once it is copied
        out.put(*found.pop())
    return out


def _parts_of(tree: Tree):
    """The table's rows in slices, with the prior of each row's outcomes: what the driver computes at once stays small."""
    for a in range(0, tree.rows, SLICE):
        part = slice(a, a + SLICE)
        yield part, np.exp(tree.bias[tree.owner[part]])


def start_weights(tree: Tree, counts) -> np.ndarray:
    """A share of the smoothed log-ratios of a feature's outcomes to the prior of its node."""
    out = np.zeros((tree.rows, FAN), np.float32)
    for part, prior in _parts_of(tree):
        n, tiny = counts[part], np.float32(1e-9)
        ratio = (n + KAPPA * prior + tiny) / (n.sum(1, keepdims=True) * prior + KAPPA * prior + tiny)
        out[part] = np.where(prior > 0, FIRST * np.log(ratio), 0).clip(-MOST_WEIGHT, MOST_WEIGHT)
    return out


def update(tree: Tree, weights: np.ndarray, counts, gradient, share: float) -> None:
    """Step along the gradient of a part of the rows, each weight's divided by its curvature in that part."""
    for part, prior in _parts_of(tree):
        n = counts[part]
        seen = n.sum(1, keepdims=True)
        p = (n + KAPPA * prior) / (seen + KAPPA)
        step = (gradient[part] / (share * seen * p * (1 - p) + KAPPA / 2)).clip(-1, 1)
        weights[part] = np.where(prior > 0, weights[part] + RATE * step, 0).clip(-MOST_WEIGHT, MOST_WEIGHT)


def log_probabilities(tree: Tree, weights: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The natural logarithm of each token's leaf's probability."""
    v = Visits(tree, codes, hashes)
    z = v.logits(tree, weights)
    own = z[np.arange(len(z)), v.outcome]
    return np.bincount(v.token, own - np.log(np.exp(z, out=z) @ _ONES), len(codes)) + tree.below[leaves(codes)]


def _scores(tree, weights, count, mass):
    """For every row: its tokens, known frequent ones, their log-frequencies, and the model's value but for rare words' frequencies."""
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "shape"]

    def run(batches):
        t, w, c, z = tree.value, weights.value, count.value, mass.value
        # by leaf: a rare word's own frequency comes by the join
        logs = np.concatenate((np.zeros(RARE), np.log10(c + ALPHA)))
        inside = np.concatenate((-z, np.zeros(len(c))))
        known = np.concatenate((np.zeros(RARE, bool), c > 0))
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for codes, hashes, own in _runs(_codes(batch.column(3), n), BATCH):
                leaf = leaves(codes)
                each = log_probabilities(t, w, codes, hashes) / np.log(10) + inside[leaf]
                for total, x in zip(sums, (None, known[leaf], logs[leaf], each)):
                    total += np.bincount(own, x, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])], names=names)

    return run


class Model:
    """A trained model and the tables that it was made from: coded (row, doc_id, held_out, codes, rare), counts (word, c).

    Words and outcomes leave the driver's memory as soon as the codes are stored and the weights are trained.
    """

    def __init__(self, docs: DataFrame, parts: int = 10, rounds: int = ROUNDS, heavy: int = HEAVY):
        context = docs.sparkSession.sparkContext
        doc = F.col("doc_id").cast("long")
        base = docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc_id"), is_held_out(doc, parts).alias("held_out"), text_or_empty().alias("t"))
        self.counts = stored(token_counts(base.where("NOT held_out").select("t")), "counts")
        whole = self.counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = whole["n"] or 0, whole["v"]
        # words that occur once are rare in any corpus: from them the model learns where new words come
        self.cutoff = max(2, frequency_cutoff(self.counts, "c", heavy)) if self.v else 2
        frequent = self._frequent()
        vocabulary = self.vocabulary
        self.count, kinds_of = vocabulary.count, vocabulary.classes
        shared = context.broadcast(vocabulary)
        del vocabulary
        self.rare = self.counts.where(~frequent)

        def rare_leaves(batches):
            own = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([own.leaf_of(w) for w in batch.column(0).to_pylist()], pa.int32()), batch.column(1)], names=["k", "c"])

        size, kinds = np.zeros(RARE), np.zeros(RARE)
        for r in self.rare.mapInArrow(rare_leaves, "k int, c long").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            size[r["k"]], kinds[r["k"]] = r["c"], r["v"]
        self.mass = size + ALPHA * (kinds + 1)  # of each rare leaf: its words and one that wasn't seen
        bits = min(MOST_BITS, max(LEAST_BITS, int(self.n).bit_length() - THIN))
        classes = np.concatenate((np.arange(RARE) // (RARE // FAN), kinds_of))
        self.tree = Tree(classes, np.concatenate((self.mass, self.count + ALPHA)), 1 << bits)
        coded = base.mapInArrow(_coded(shared), "row long, doc_id long, held_out boolean, codes binary, rare array<binary>")
        self.coded = stored(coded, "coded", compression="zstd")
        shared.destroy()
        del shared, coded, rare_leaves
        self.shared_tree = context.broadcast(self.tree)
        train, rows = self.coded.where("NOT held_out"), self.tree.rows
        if self.n:
            outcomes = self._gathered_outcomes()
            self.weights = start_weights(self.tree, outcomes)
            for k in range(rounds):
                part = train.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("codes")
                held = context.broadcast(self.weights)
                update(self.tree, self.weights, outcomes, gathered(part, self.shared_tree, held, rows, self._tasks(self.n // rounds)), 1 / rounds)
                held.destroy()
        else:
            self.weights = np.zeros((rows, FAN), np.float32)

    def _tasks(self, n: int) -> int:
        return max(self.coded.sparkSession.sparkContext.defaultParallelism, -(-n // TASK))

    def _gathered_outcomes(self) -> Sums:
        return gathered(self.coded.where("NOT held_out").select("codes"), self.shared_tree, None, self.tree.rows, self._tasks(self.n))

    @property
    def outcomes(self) -> np.ndarray:
        """(rows, FAN) counts of outcomes by row of the table, gathered again whenever they are asked for."""
        return self._gathered_outcomes()[:]

    def _frequent(self) -> Column:
        return (F.col("c") >= self.cutoff) | (F.col("word") == F.lit(END))

    @property
    def vocabulary(self) -> Vocabulary:
        """Made from the stored counts whenever it is asked for; the model doesn't keep it."""
        return Vocabulary({bytes(r["word"]): r["c"] for r in self.counts.where(self._frequent()).collect()})

    def scores(self) -> DataFrame:
        context = self.coded.sparkSession.sparkContext
        run = _scores(self.shared_tree, context.broadcast(self.weights), context.broadcast(self.count), context.broadcast(np.log10(self.mass)))
        rows = self.coded.select("row", "doc_id", "held_out", "codes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, shape double")
        words = self.coded.select("row", F.explode("rare").alias("word")).join(self.rare.hint("merge"), "word", "left")
        log = F.log10(F.coalesce("c", F.lit(0)) + ALPHA)
        words = words.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
                             F.col("c").isNotNull().cast("long").alias("known"), log.alias("logs"), log.alias("shape"))
        per = rows.unionByName(words).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "logs", "shape")))
        every = float(np.log10(self.n + ALPHA * (self.v + 1)))
        return per.select(
            "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(self.n).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * every).alias("base_score"), F.col("shape").alias("score"),
        )


def scores(docs: DataFrame, parts: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-ALPHA unigram log10 probability, score the model's; both count one end token per text. A null text
    is empty: its one token is the end. A null doc_id counts as held out. Repeated rows each give a row. Without training
    rows all tokens are unknown and both scores are those of the smoothing alone. An empty table gives no rows; columns
    besides doc_id and text are ignored. Texts of any length are scored whole, each word with its own context.
    """
    return Model(docs, parts, rounds).scores()
