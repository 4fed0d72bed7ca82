"""N-gram Jaccard self-join: a size-aware heavy-light join of shingle sets, exact.

Two sets of n <= m shingles are similar if den * |both| >= num * |either|; their overlap is then at least
o(n, m) = ceil(num (n + m) / (num + den)), and they differ in at most n + m - 2 o(n, m) shingles.

Light: small sets enumerate all their subsets of the sizes o(n, m) that a small partner can ask for. Similar small sets
share such a subset.
Heavy: large sets post to inverted lists that are scanned. Sets whose sizes lie in the same interval or in neighbouring
ones can differ in d shingles at most. Hashing the shingles into k > d parts leaves k - d parts at least that are equal in
both sets, so a list is kept for the exact content of a part rather than for a shingle: a list then holds near copies, and a
passage that many documents share doesn't make one. Of its k parts a set posts the d + 1 largest; the largest part that is equal in
both is among them on either side.
The boundary between light and heavy is the size at which the estimated cost (keys to make, lists to scan) is least.

Copies are one node: the keys are posted by set, not by document. A list isn't expanded into pairs. First every node of a
list is compared with the list's least and greatest node, and verified links are joined into components. Pairs within one component then
need no comparison, as they can't change it; the pairs of a list that lie in different components are all compared. Sizes and
a parity sketch (which bounds the difference from below) rule out pairs before their sets are read. No pair is left out.

Shingle sets are sets of 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, broadcast_if_small, stored, text_or_empty
from .components import components
from .wordbpe import _Cache

#: Set sizes among which the light-heavy boundary is chosen, and the cost of a scanned list entry in enumerated subsets.
MOST_LIGHT, SCAN = 40, 3
#: Bits of the fixed-size filters with which later scans skip keys and texts that cannot matter (a join decides).
FILTER_BITS = 1 << 26
#: Bytes of the table of rows to drop up to which it is broadcast (counted first); beyond it texts are shuffled.
MOST_BROADCAST = 32_000_000
#: Parity sketches have so many words of 64 bits.
SKETCH = 16
#: Words whose hashes a worker remembers, rows that it turns into Python objects at once.
CACHE, ROWS = 100_000, 256
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)  # fixed values: a 64-bit finalizer's multipliers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _M1
    x = (x ^ (x >> _U(33))) * _M2
    return x ^ (x >> _U(33))


class Shingles:
    """Distinct shingle hashes of a text: `words` consecutive words, A-Z lower-cased; all words if there are fewer."""

    def __init__(self, words: int):
        import xxhash

        self._words = words
        self._hash = _Cache(lambda ws: [xxhash.xxh3_64_intdigest(w) for w in ws], CACHE)

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
        if not words:
            return np.empty(0, _U)
        known = self._hash.known
        try:
            h = np.array([known[w] for w in words], _U)
        except KeyError:
            known = self._hash.of(words)
            h = np.array([known[w] for w in words], _U)
        k = min(self._words, len(h))
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = mix(out) + h[j : len(h) - k + 1 + j]
        return np.unique(mix(out + _U(k)))


class Scheme:
    """Keys under which sets are brought together, for a threshold num / den and a light-heavy boundary."""

    def __init__(self, num: int, den: int, boundary: int = 0):
        self.num, self.den, self.boundary = num, den, boundary
        self._bounds: list[tuple[int, int, int, int]] = []  # size from, to, d, parts

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def interval(self, n: int) -> int:
        while not self._bounds or self._bounds[-1][1] < n:
            low = self._bounds[-1][1] + 1 if self._bounds else 1
            high = self.largest(low)
            m = min(self.largest(high), self.largest(high + 1))
            d = (self.den - self.num) * (high + m) // (self.num + self.den)
            self._bounds.append((low, high, d, d + 1 + (d + 1) // 4))
        lo, hi = 0, len(self._bounds) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self._bounds[mid][1] >= n else (mid + 1, hi)
        return lo

    def subset_sizes(self, n: int) -> list[int]:
        least = -(-n * self.num // self.den)
        return sorted({o for m in range(max(1, least), self.largest(n) + 1) if (o := self.overlap(n, m)) <= n})

    def light_keys(self, n: int) -> int:
        return sum(comb(n, o) for o in self.subset_sizes(n))

    def heavy_keys(self, n: int) -> int:
        i = self.interval(n)
        return sum(self._bounds[j][2] + 1 for j in (i, i - 1) if j >= 0)

    def choose(self, sizes: dict[int, int]) -> None:
        """Set the boundary of least cost for so many sets of each size up to MOST_LIGHT."""

        def cost(x: int) -> int:
            light = sum(c * self.light_keys(n) for n, c in sizes.items() if 0 < n <= x)
            return light + SCAN * sum(c * self.heavy_keys(n) for n, c in sizes.items() if self.largest(n) > x)

        self.boundary = min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        n, out = len(hashes), []
        if n <= self.boundary:
            with np.errstate(over="ignore"):
                total = hashes.sum(dtype=_U)
                for o in self.subset_sizes(n):
                    drop = n - o
                    sums = np.array([total - hashes[list(c)].sum(dtype=_U) for c in combinations(range(n), drop)], _U) if drop else np.array([total], _U)
                    out.append(mix(sums + _U(0x5B5E << 32 | o)))
        if self.largest(n) > self.boundary:
            at = self.interval(n)
            for i in (at, at - 1):
                if i < 0:
                    continue
                _, _, d, parts = self._bounds[i]
                part = ((mix(hashes + _U(i + 1)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
                count = np.bincount(part, minlength=parts)
                held = np.zeros(parts, _U)
                np.add.at(held, part, hashes)
                most = np.argpartition(count * parts + np.arange(parts), parts - d - 1)[parts - d - 1 :] if parts > d + 1 else np.arange(parts)
                out.append(mix(held[most] + mix(most.astype(_U) + _U(i << 32) + _U(1 << 63))))
        return np.unique(np.concatenate(out)) if out else np.empty(0, _U)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of 1024 counts: sets differ in at least as many shingles as their sketches differ in bits."""
    odd = (np.bincount((hashes >> _U(54)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class KeyFilter:
    """A fixed-size set of bits for 64-bit keys: `in` may say yes wrongly, never no."""

    def __init__(self, bits: bytes):
        self._bits = np.frombuffer(bits, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys ^ (keys >> _U(26)) ^ (keys >> _U(52))) & _U(FILTER_BITS - 1)).astype(np.int64)
        return (self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(df: DataFrame, col: str) -> KeyFilter:
        """Made by Spark: FILTER_BITS / 32,768 rows of 4 KiB at most reach the driver."""
        x = F.col(col)
        at = x.bitwiseXOR(F.shiftrightunsigned(x, 26)).bitwiseXOR(F.shiftrightunsigned(x, 52)).bitwiseAND(FILTER_BITS - 1)
        parts = df.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits")).collect()
        bits = bytearray(FILTER_BITS // 8)
        for r in parts:
            bits[r["block"] * 4096 : r["block"] * 4096 + len(r["bits"])] = r["bits"]
        return KeyFilter(bytes(bits))


def _all_keys(words: int, scheme: Scheme):
    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                keys, nodes = [], []
                for t in batch.column(0).slice(a, ROWS).to_pylist():
                    if len(h := shingles.of(t)):
                        keys.append(k := scheme.keys(h))
                        nodes.append(np.full(len(k), node_of(h)))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def node_of(hashes: np.ndarray) -> np.int64:
    return _signed(mix(np.array([hashes.sum(dtype=_U) + _U(len(hashes))], _U)))[0]


_DOC = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), *((f"b{i}", pa.int64()) for i in range(SKETCH)), ("keys", pa.list_(pa.int64()))])


def _documents(words: int, scheme: Scheme, repeated):
    """A row per document: its set's size, node and sketch, and those of its keys that another node may have too."""

    def run(batches):
        shingles, seen = Shingles(words), repeated.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                sizes, nodes, keys, bits = [], [], [], np.empty((SKETCH, part.num_rows), np.int64)
                for i, t in enumerate(part.column(1).to_pylist()):
                    h = shingles.of(t)
                    sizes.append(len(h))
                    nodes.append(int(node_of(h)) if len(h) else None)
                    bits[:, i] = sketch(h)
                    own = scheme.keys(h) if len(h) else h
                    keys.append(_signed(own[seen.has(own)]))
                columns = [part.column(0), part.column(2), sizes, nodes, *bits, keys]
                yield pa.RecordBatch.from_pydict(dict(zip(_DOC.names, columns)), schema=_DOC)

    return run


def _sets(words: int, wanted):
    def run(batches):
        shingles, seen = Shingles(words), wanted.value
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.fill_null(0)).astype(np.int64).view(_U)
            keep = np.flatnonzero(seen.has(known) | np.asarray(ids.is_null()))
            for a in range(0, len(keep), ROWS):
                sets = [h for t in batch.column(1).take(pa.array(keep[a : a + ROWS])).to_pylist() if len(h := shingles.of(t))]
                nodes = pa.array([int(node_of(h)) for h in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "held"])

    return run


def _similar(num: int, den: int):
    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(num: int, den: int):
    """A condition on two nodes' sizes and sketches that every similar pair meets (columns u_*, v_*)."""
    n, m = F.least("u_n", "v_n"), F.greatest("u_n", "v_n")
    apart = sum((F.bit_count(F.col(f"u_b{i}").bitwiseXOR(F.col(f"v_b{i}"))) for i in range(SKETCH)), F.lit(0))
    return (F.lit(den) * n >= F.lit(num) * m) & (F.lit(num + den) * apart <= F.lit(den - num) * (n + m))


_SKETCH = [f"b{i}" for i in range(SKETCH)]


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *_SKETCH)))


class Join:
    """The join of one table (doc_id, text). rows: doc_id, n, node; nodes: one for each set; labels()."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.words, self.num, self.den = words, num, den
        spark = docs.sparkSession
        context = spark.sparkContext
        text = text_or_empty()
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("text_hash"))
        self.scheme = Scheme(num, den)
        short = base.where(F.octet_length("t") <= 100 * MOST_LIGHT).select(F.size(F.split(F.trim("t"), r"[\x20\x09-\x0D]+")).alias("w"))
        sizes = short.select(F.greatest(F.lit(1), F.col("w") - (words - 1)).alias("n")).where(f"n <= {MOST_LIGHT}").groupBy("n").count().collect()
        self.scheme.choose({r["n"]: r["count"] for r in sizes})
        every = base.select("t").mapInArrow(_all_keys(words, self.scheme), "key long, node long")
        lists = every.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot != last")
        self.lists = stored(lists, "lists")
        found = context.broadcast(KeyFilter.of(self.lists, "key"))
        self.rows = stored(base.mapInArrow(_documents(words, self.scheme, found), "doc_id long, text_hash long, n long, node long, " + ", ".join(f"{b} long" for b in _SKETCH) + ", keys array<long>"), "rows")
        info = [F.max(c).alias(c) for c in ("n", *_SKETCH)]
        self.nodes = stored(self.rows.where("n > 0").groupBy("node").agg(*info, F.min("doc_id").alias("doc_id")), "nodes")
        held = self.rows.select("node", F.explode("keys").alias("key")).distinct()
        self.posts = stored(held.join(self.lists.hint("merge"), "key"), "posts")
        self._base = base

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) of nodes whose sets are similar."""
        pairs = stored(pairs.select("u", "v").distinct(), "pairs")
        needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(self.nodes.select("node", "doc_id"), "node")
        needed = stored(needed, "needed")
        # one document for each set, told by its doc_id; the join on the set itself decides
        wanted = self._base.sparkSession.sparkContext.broadcast(KeyFilter.of(needed.where("doc_id IS NOT NULL"), "doc_id"))
        sets = self._base.mapInArrow(_sets(self.words, wanted), "node long, held binary")
        sets = stored(sets.join(needed.select("node").hint("merge"), "node").dropDuplicates(["node"]), "sets")
        u, v = (sets.select(F.col("node").alias(s), F.col("held").alias(f"{s}_held")) for s in "uv")
        both = pairs.join(v.hint("merge"), "v").join(u.hint("merge"), "u").select("u", "v", "u_held", "v_held")
        return stored(both.mapInArrow(_similar(self.num, self.den), "u long, v long"), "links")

    def labels(self) -> DataFrame:
        """(node, label): the component of every node that is linked to another."""
        possible = _possible(self.num, self.den)
        ends = F.explode(F.array("pivot", "last"))
        stars = self.posts.select(ends.alias("u"), F.col("node").alias("v")).where("u != v").distinct()
        stars = stars.join(_side(self.nodes, "v"), "v").join(_side(self.nodes, "u"), "u").where(possible)
        stars = stored(stars.select("u", "v"), "stars")
        links = self._verified(stars)
        first = components(links)
        post = self.posts.select("key", "node").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
        post = stored(post, "labelled")
        mixed = post.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a != z").select("key")
        rest = stored(post.join(mixed, "key", "left_semi").join(self.nodes.drop("doc_id"), "node"), "mixed")
        u, v = _side(rest, "u", "key", F.col("label").alias("u_label")), _side(rest, "v", "key", F.col("label").alias("v_label"))
        across = u.join(v, (u["key"] == v["key"]) & (F.col("u") < F.col("v")) & (F.col("u_label") != F.col("v_label")) & possible)
        tried = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        across = across.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
        return components(links.union(self._verified(across)))


def _labelled(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, label) of every row; label: its component, null without words."""
    join = Join(docs, words, num, den)
    rows = join.rows.select("doc_id", "text_hash", "n", "node").join(join.labels(), "node", "left")
    return stored(rows.select("doc_id", "text_hash", "n", F.coalesce("label", "node").alias("label")), "labelled")


def similar_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links, its own included).

    Two documents link if den * |intersection| >= num * |union| of their shingle sets. Texts without words and nulls have no
    shingles, link with nothing and are their own component. A null doc_id stays null and never names a component that has
    another id. Repeated rows each give a row. An empty table gives no rows; other columns are ignored.
    """
    rows = _labelled(docs, words, num, den)
    # stored, so that the join below is one of two scans, whose large groups Spark can split
    least = stored(rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for near copies: of each component the row with the least doc_id (null last) and hash of the text.

    Rows without words link with nothing and all stay. Of rows that are equal in doc_id and text one stays. All columns are
    kept; columns of any name pass through. An empty table stays empty.
    """
    rows = _labelled(docs, words, num, den)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    least = stored(rows.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("least")), "least")
    marked = rows.join(least, "label").groupBy("doc_id", "text_hash").agg(F.min(place != F.col("least")).alias("gone"), F.count("*").alias("times"))
    marked = marked.where("gone OR times > 1").select(F.col("doc_id").alias("_near_doc"), F.col("text_hash").alias("_near_hash"), F.col("gone").alias("_near_gone"))
    marked = stored(marked, "near")
    marked = broadcast_if_small(marked, 40 * marked.count(), MOST_BROADCAST)  # few enough: texts stay where they are
    names = docs.columns
    same = docs["doc_id"].cast("long").eqNullSafe(marked["_near_doc"]) & (F.xxhash64(text_or_empty(docs["text"])) == marked["_near_hash"])
    left = docs.join(marked, same, "left").where("_near_gone IS NULL OR NOT _near_gone")
    once = left.where("_near_gone IS NULL")
    again = left.where("_near_gone IS NOT NULL").dropDuplicates(["_near_doc", "_near_hash"])  # those that repeat, whole rows of them
    return once.select(*names).unionByName(again.select(*names))
