"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed: byte trigrams of the text, word shapes (what kinds of characters a word begins,
holds and ends with, and whether it repeats the word before) as 1- to 3-grams, and the logarithmic size of the text. Each
indicator is scaled by the log-count ratio of the two classes; a linear hinge-loss model on the scaled indicators is fitted
by dual coordinate descent; margins become probabilities by a logistic curve that is fitted on rows that the model
has not seen.

Fitting uses a sample of at most `rows` labelled rows, those with the least MD5 of doc_id, of a repeated doc_id the text
with the least hash (a documented bound, so that fitting fits on the driver); scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

BITS = 18
#: Labelled rows that a model is fitted on, at most, and bytes of text that they may bring to the driver.
FIT_ROWS, FIT_BYTES = 6000, 40_000_000
_U = np.uint32

# kinds of bytes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, 5 end of sentence, 6 other marks
_KIND = np.full(256, 6, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:?"]] = 5

#: A pseudo-random value of each byte; a word's sum of them tells it from its neighbours.
_BYTE = np.random.default_rng(5).integers(0, 1 << 62, 256, dtype=np.uint64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + _U(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _U(0x85EBCA6B)
    x ^= x >> _U(15)
    return (x * _U(0xC2B2AE35)) >> _U(32 - BITS)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    out = [_mixed(np.array([n.bit_length()], _U), 7)]
    if n >= 3:
        b = raw.astype(_U)
        out.append(_mixed(b[:-2] << _U(16) | b[1:-1] << _U(8) | b[2:], 1))
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (kind != 0).view(np.int8), [0]))))
    start, stop = edge[::2], edge[1::2]
    if len(start):
        onehot = np.left_shift(1, kind, dtype=np.uint8)
        held = np.bitwise_or.reduceat(onehot, np.stack([start, stop - 1], 1).ravel())[::2] | onehot[stop - 1]
        shape = kind[start].astype(_U) | held.astype(_U) << _U(3) | kind[stop - 1].astype(_U) << _U(11) | np.minimum(stop - start, 15).astype(_U) // _U(4) << _U(14)
        # a word's hash by prefix sums, to see whether it repeats the word before
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw], out=sums[1:])
        size = (stop - start).astype(np.uint64)
        word = (sums[stop] - sums[start]) * np.uint64(31) + size
        again = np.concatenate(([False], word[1:] == word[:-1])).astype(_U)
        shape |= again << _U(17)
        g = _mixed(shape, 2)
        grams = [g]
        if len(g) > 1:
            grams.append(_mixed(g[:-1] * _U(0x01000193) ^ g[1:], 3))
        if len(g) > 2:
            grams.append(_mixed((g[:-2] * _U(0x01000193) ^ g[1:-1]) * _U(0x01000193) ^ g[2:], 4))
        out += grams
    return np.unique(np.concatenate(out))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes: log of the classes' relative indicator counts, smoothed by alpha."""
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for x, label in zip(rows, y):
        (p if label else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of the indicators in an L2-regularized hinge-loss model on indicator * r, plus a bias in the last place.

    Every row's scaled indicators are brought to unit length; classes weigh the same in sum.
    """
    w = np.zeros((1 << BITS) + 1)
    sign = np.where(y > 0, 1.0, -1.0)
    limit = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    scaled = [(x, r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum() + 1))) for x in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v = scaled[i]
            gradient = sign[i] * (w[x] @ v + w[-1]) - 1
            before = alpha[i]
            now = min(max(before - gradient / (v @ v + 1), 0.0), limit[i])
            if now != before:
                w[x] += (now - before) * sign[i] * v
                w[-1] += (now - before) * sign[i]
                most = max(most, abs(now - before))
            alpha[i] = now
        if most < 1e-3:
            break
    return w


class NaiveBayesSvm:
    def __init__(self, r: np.ndarray, w: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.r, self.w, self.slope, self.shift = r.astype(np.float32), w.astype(np.float32), slope, shift

    def margin(self, x: np.ndarray) -> float:
        v = self.r[x]
        return float(v @ self.w[x] / np.sqrt((v * v).sum() + 1) + self.w[-1])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -60, 60))))

    @staticmethod
    def fit(texts: list[str], labels: list[int]) -> NaiveBayesSvm:
        """A fitted model. One class only: a model that gives that class; no rows: 0.5 for every text."""
        y = np.array(labels, int)
        none = np.zeros(1 << BITS)
        if not len(y) or y.min() == y.max():
            return NaiveBayesSvm(none, np.zeros((1 << BITS) + 1), 1.0, 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1))
        rows = [features(t) for t in texts]
        margins = np.zeros(len(y))
        folds = np.arange(len(y)) % 3
        for k in range(3):  # margins of unseen rows, for the logistic curve
            train = np.flatnonzero(folds != k)
            if y[train].min() == y[train].max():
                continue
            own = [rows[i] for i in train]
            r = log_count_ratio(own, y[train])
            part = NaiveBayesSvm(r, dual_coordinate_descent(own, r, y[train]))
            for i in np.flatnonzero(folds == k):
                margins[i] = part.margin(rows[i])
        a, b = 1.0, 0.0
        target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
        for _ in range(50):  # Newton steps on the log-loss, slightly regularized
            p = 1 / (1 + np.exp(-(a * margins + b)))
            d, h = p - target, np.maximum(p * (1 - p), 1e-9)
            g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
            hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        r = log_count_ratio(rows, y)
        return NaiveBayesSvm(r, dual_coordinate_descent(rows, r, y), float(a), float(b))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of doc_id as text, modulo parts, is 0; a null doc_id counts as empty text, so it is held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> NaiveBayesSvm:
    """Fit on labelled rows that aren't held out. Conflicting or null labels of a doc_id are left out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("z"))
    marks = marks.where("q = z AND q IN (0, 1)").where(~held_out(F.col("doc_id")))
    # choose by id before any text moves; whole texts of the chosen only
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = marks.select("doc_id", "q", order.alias("o")).orderBy("o", "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).join(F.broadcast(chosen), "doc_id")
    # of the texts of a repeated doc_id that with the least hash, whatever the order of rows
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least"), F.first("q").alias("q"), F.first("o").alias("o")).select("doc_id", "q", "o", "least.t")
    found, size, fits = stored(found, "labelled"), 0, []
    for r in sorted(found.select("o", "doc_id", F.octet_length("t").alias("n")).collect()):
        if size + r["n"] <= most:  # else the row is skipped, and shorter ones go on
            size += r["n"]
            fits.append((r["doc_id"],))
    if not fits:
        return NaiveBayesSvm.fit([], [])
    ids = found.sparkSession.createDataFrame(fits, "doc_id long")
    picked = sorted(found.join(F.broadcast(ids), "doc_id").select("o", "doc_id", "t", "q").collect())
    texts, y = [r["t"] for r in picked], [r["q"] for r in picked]
    return NaiveBayesSvm.fit(texts, y)


def scored(docs: DataFrame, model: NaiveBayesSvm, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null: empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                s = np.array([shared.value.score(t) for t in batch.column(1).slice(a, 512).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Only texts are inputs of a score.

    Null and empty texts have the score that a text without n-grams gets. Repeated rows get equal scores. Without usable
    labels every score is 0.5. An empty table gives no rows; other columns are ignored.
    """
    return scored(docs, train(docs, labels), threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the classifier rejects, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(names.index("text")).to_pylist()
                yield part.filter(pa.array([shared.value.score(t or "") >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
