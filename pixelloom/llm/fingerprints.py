"""Document fingerprints: one-permutation MinHash, in DataFrame operations only.

Each shingle (`words` consecutive words of the lower-cased text; the whole sequence, if it has fewer) is hashed once.
The high bits of the hash choose one of `bins` bins and the rest competes there, so one sort of the hashes together with
one sentinel per bin gives every bin's minimum in bin order. Empty bins borrow by optimal densification: each empty bin
probes the bins in a pseudo-random order of its own and takes the first that is not empty. Of each bin the low `BITS` bits
are kept. The likeness of two fingerprints is the share of equal entries, corrected for chance equality of b bits.

The text comes to the operator once: rows are dealt out by ranges of doc_id in a single shuffle, in which every document
also meets the next one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, text_or_empty

#: As a SQL string.
WORD_GAP = r"[\\x20\\x09-\\x0D]+"
#: Bits kept of each bin; two hex digits.
BITS = 8
#: Of a 64-bit hash, the sign is dropped, log2(bins) bits choose the bin and the others compete.
_POSITIVE = 0x7FFFFFFFFFFFFFFF


def _bins_sql(text: str, words: int, bins: int) -> str:
    """array<int>: the kept low bits of every bin; all bins of a text without words hold the same mark."""
    shift = 63 - (bins.bit_length() - 1)
    mark = f"{(1 << shift) - 1}L"
    sentinels = "array(" + ", ".join(f"{b << shift | (1 << shift) - 1}L" for b in range(bins)) + ")"
    split = f"transform(filter(split(translate({text}, '{UPPER}', '{LOWER}'), '{WORD_GAP}'), x -> x != ''), x -> xxhash64(x))"
    hashes = let("w", split, f"""CASE WHEN size(w) = 0 THEN cast(array() AS array<bigint>) WHEN size(w) < {words} THEN array(xxhash64(w))
        ELSE transform(slice(w, 1, size(w) - {words - 1}), (x, i) -> xxhash64(slice(w, i + 1, {words}))) END""")
    ordered = f"sort_array(concat(transform({hashes}, x -> x & {_POSITIVE}L), {sentinels}))"
    firsts = f"filter(s, (x, i) -> i = 0 OR shiftright(x, {shift}) != shiftright(s[i - 1], {shift}))"
    # each empty bin b asks the bins that hold something, in an order of its own
    probe = f"array_min(transform(held, y -> struct(xxhash64(b, shiftright(y, {shift})) AS at, y AS y))).y"
    dense = f"CASE WHEN size(held) IN (0, {bins}) THEN m ELSE transform(m, (x, b) -> CASE WHEN (x & {mark}) != {mark} THEN x ELSE {probe} END) END"
    kept = f"transform({dense}, x -> cast(x & {(1 << BITS) - 1} AS int))"
    return let("s", ordered, let("m", firsts, let("held", f"filter(m, x -> (x & {mark}) != {mark})", kept)))


def _with_bins(df: DataFrame, text: str, out: str, words: int, bins: int) -> DataFrame:
    return df.withColumn(out, F.expr(_bins_sql(text, words, bins)))


def packed(col: str) -> Column:
    """The kept bits as lower-case hex, two digits for each bin."""
    return F.expr(f"array_join(transform({col}, x -> lpad(lower(hex(x)), {BITS // 4}, '0')), '')")


def likeness(a: str, b: str, bins: int) -> Column:
    """Estimated Jaccard likeness of two arrays of kept bits: the share of equal bins less what chance gives, 0 to 1."""
    same = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END), 0, (s, x) -> s + x)")
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))


def fingerprint(docs: DataFrame, text: str = "text", words: int = 5, bins: int = 128) -> DataFrame:
    """docs with a column fingerprint (hex) of a text column; equal texts have equal fingerprints."""
    return _with_bins(docs, text, "_bits", words, bins).withColumn("fingerprint", packed("_bits")).drop("_bits")


#: Rows that one range of doc_ids should hold, and the most ranges; split points are that many longs on the driver.
RANGE_ROWS, MOST_RANGES = 512, 100_000


def _ranges(docs: DataFrame) -> DataFrame:
    """Add part and h: the number of each row's range in the order of (doc_id, h), nulls last; h is a hash of the text.

    Split points are approximate quantiles of doc_id. A doc_id that several of them hit has as many ranges, split by h, and so
    have rows without a doc_id.
    """
    found = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    parts = max(1, min(MOST_RANGES, found["ids"] // RANGE_ROWS + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 2 * parts)).alias("c")).first()["c"]
    cuts = sorted(cuts or [])
    values = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def before(under):  # binary search: how many cuts come before the doc_id
        return F.aggregate(F.array(*map(F.lit, steps or [1])), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & under(F.get(values, at + s - 1)), at + s).otherwise(at))

    share = F.col("h") / F.lit(2.0**64) + F.lit(0.5)  # 0 to 1, in the order of h
    spread = lambda n: F.least(F.floor(share * n).cast("int"), n - 1)
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("upto", before(lambda c: c <= F.col("doc_id"))).withColumn("low", before(lambda c: c < F.col("doc_id")))
    nulls = max(1, min(MOST_RANGES, (found["n"] - found["ids"]) // RANGE_ROWS))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + spread(F.lit(nulls)))
    part = part.when(F.col("upto") - F.col("low") > 1, F.col("low") + 1 + spread(F.col("upto") - F.col("low"))).otherwise(F.col("upto"))
    return docs.withColumn("part", part).drop("upto", "low")


def edit_likeness(docs: DataFrame, words: int = 5, bins: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last floor(n/2) code points are replaced by the first
    as many (or all) of the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The next document is the next in order of (doc_id, hash of the text, text), null doc_ids last; after the last comes the
    first. A null text is empty. Texts without words all have the same fingerprint. Repeated rows each have a place in the
    order; rows that are equal in doc_id and text share a range. One row is its own next. An empty table gives no rows;
    columns besides doc_id and text are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = _ranges(base).withColumn("ends", F.lit(False))
    # the first row of each range follows the last row of the range before: keys alone find it, a row for each range
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    heads = base.groupBy("part").agg(F.min(place).alias("head"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("part").alias("of"), F.coalesce(F.lag("part").over(ring), F.last("part").over(whole)).alias("before"), F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h"))
    same = (F.col("part") == F.col("of")) & (F.col("h") == F.col("head_h")) & F.col("doc_id").eqNullSafe(F.col("head_id"))
    copies = base.join(F.broadcast(heads), same).groupBy("before").agg(F.min("text").alias("text"))  # MOST_RANGES rows for each kind at most
    ends = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), F.col("before").alias("part"), F.lit(True).alias("ends"))
    rows = base.select("doc_id", "text", "h", "part", "ends").unionByName(ends)
    order = Window.partitionBy("part").orderBy("ends", F.col("doc_id").asc_nulls_last(), "h", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half))
    ).drop("next_text")
    rows = _with_bins(_with_bins(rows, "text", "bits", words, bins), "edited", "edited_bits", words, bins)
    rows = rows.withColumn("next_bits", F.lead("bits").over(order)).where("NOT ends")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("bits").alias("fingerprint"), packed("edited_bits").alias("edited_fingerprint"),
        likeness("bits", "edited_bits", bins).alias("near_edited"), likeness("bits", "next_bits", bins).alias("near_next"),
    )
