"""Benchmark decontamination through a distributed positional inverted index, in DataFrame operations only.

Index: postings (term, document key, position) of the training tokens, stored as a table. `build_index(docs)` stores all of
them, for any later benchmark; the query, which has one benchmark, stores the lists that its search reads: those of the
`anchors` rarest terms of each test window, by the terms' counts over the whole corpus. A window is `width` consecutive words
of an item (the whole item, if it has fewer); equal windows are one.

Search: a posting at document position p of a term at offset o of a window puts the window at p - o. Intersecting the
offset-adjusted lists is an aggregation by (document, window, place): a place is kept if all the window's anchors are there.
The places of a document meet in one row, where its text is split once and the window's words are compared by hash at each
of them: the work is linear in the text and its places. Proximity matches use the same lists with a tolerance.

Words: A-Z are lower-cased; a word is a run of ASCII letters, digits and characters beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, let, stored, text_or_empty

#: As a SQL string.
WORDS_SQL = rf"filter(split(translate({{}}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x != '')"
#: Bytes of a stored test-side table up to which it is broadcast (summed first); beyond it both sides are shuffled.
MOST_BROADCAST = 32_000_000


def words_of(text: str) -> Column:
    """The words of a text column, in order."""
    return F.expr(WORDS_SQL.format(text))


def sized(df: DataFrame, row: int, text: str | None = None) -> DataFrame:
    """A stored table, marked for broadcast if its rows, of `row` bytes and those of a text column each, are few."""
    found = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(text) if text else F.lit(0)).alias("b")).first()
    return broadcast_if_small(df, found["n"] * row + (found["b"] or 0), MOST_BROADCAST)


def test_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, window, words, size): every window of every non-empty item; window is a hash of its words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where(F.size("w") > 0).distinct()
    size = F.least(F.size("w"), F.lit(width))
    at = items.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("s"))
    return at.select("item", F.expr("slice(w, s, size)").alias("words"), "size").withColumn("window", F.xxhash64("words")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """(key, pos, term): one row per word of every text."""
    return docs.select("key", F.posexplode(words_of("text")).alias("pos", "term"))


def corpus_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, freq): counts over the whole corpus of the terms of the test set; 0 where a term doesn't occur."""
    terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    found = tokens(docs).join(sized(terms, 40, "term"), "term").groupBy("term").agg(F.count("*").alias("freq"))
    return terms.join(found, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def anchor_terms(windows: DataFrame, counts: DataFrame, anchors: int) -> DataFrame:
    """(window, size, o, term, need): the offsets of each distinct window's rarest terms; none for windows with an absent term."""
    each = windows.select("window", "words", "size").dropDuplicates(["window"])
    at = each.select("window", "size", F.posexplode("words").alias("o", "term")).groupBy("window", "size", "term").agg(F.min("o").alias("o")).join(counts, "term")
    whole = Window.partitionBy("window")
    ranked = at.withColumn("rank", F.row_number().over(whole.orderBy("freq", "o"))).withColumn("least", F.min("freq").over(whole)).withColumn("terms", F.count("*").over(whole))
    kept = ranked.where((F.col("rank") <= anchors) & (F.col("least") > 0))
    return kept.select("window", "size", "o", "term", F.least(F.col("terms"), F.lit(anchors)).alias("need"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Stored postings (term, key, pos) of every text (key, text): of all terms, or of a table of distinct terms."""
    rows = tokens(docs) if terms is None else tokens(docs).join(sized(terms, 40, "term"), "term")
    return stored(rows.select("term", "key", "pos"), "postings", path)


def places(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, window, size, place): where all of a window's anchors are."""
    hits = index.join(sized(anchors, 60, "term"), "term").select("key", "window", "size", "need", (F.col("pos") - F.col("o")).alias("place"))
    met = hits.where("place >= 0").groupBy("key", "window", "size", "need", "place").agg(F.count("*").alias("got"))
    return met.where("got >= need").drop("got", "need")  # rows that repeat count their postings more than once; the words decide


def exact_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, hits): a document's places, as (place, size, window), at which its words are the window's; one row per key."""
    per = stored(found.groupBy("key").agg(F.collect_set(F.struct("place", "size", "window")).alias("hits")), "places")
    keys = stored(per.select("key"), "keys")
    # few enough: texts without a place stay where they are
    docs = docs.join(sized(keys, 40), "key", "left_semi").dropDuplicates(["key"])
    same = "filter(hits, x -> x.place + x.size <= size(d) AND xxhash64(slice(d, x.place + 1, x.size)) = x.window)"
    both = per.join(docs.select("key", "text"), "key").select("key", F.expr(let("d", WORDS_SQL.format("text"), same)).alias("hits"))
    return both.where(F.size("hits") > 0)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, anchors: int = 3, index: DataFrame | None = None) -> DataFrame:
    """Exact occurrences of the windows of benchmark in docs (key, text): key, hits. index: one of all terms, if there is one."""
    windows = stored(test_windows(benchmark, width), "windows")
    rare = stored(anchor_terms(windows, corpus_counts(docs, windows), anchors), "rarest")
    if index is None:
        index = build_index(docs, stored(rare.select("term").distinct(), "terms"))
    return exact_matches(docs, places(index, rare))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, anchors: int = 3, slack: int = 2, index: DataFrame | None = None) -> DataFrame:
    """(key, item, window): windows all of whose rarest terms occur in a text, the places that they put it at `slack` apart at most."""
    windows = stored(test_windows(benchmark, width), "windows")
    rare = stored(anchor_terms(windows, corpus_counts(docs, windows), anchors), "rarest")
    if index is None:
        index = build_index(docs, stored(rare.select("term").distinct(), "terms"))
    hits = index.join(sized(rare, 60, "term"), "term").select("key", "window", "need", "o", (F.col("pos") - F.col("o")).alias("place"))
    # a posting counts for every span of places [from, from + slack] that it lies in
    spans = hits.select("key", "window", "need", "o", F.explode(F.sequence(F.col("place") - slack, F.col("place"))).alias("from"))
    met = spans.groupBy("key", "window", "need", "from").agg(F.count_distinct("o").alias("got")).where("got = need")
    return met.select("key", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("key", "item", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, anchors: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash (xxhash64 of the text).

    n_hit counts the document words inside any occurrence of a window; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null or empty texts have no words and are clean. Items without words match nothing; items with a null item_id count
    as hits and have no id to list; repeated item rows count once. Rows with the same doc_id are told apart by their
    text, and rows that repeat both get the same figures. A null doc_id stays null.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = base.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    matches = stored(phrase_matches(base.select("key", "text"), benchmark, width, anchors), "matches")
    # words in the union of the places, which are taken in order
    covered = F.expr("""aggregate(array_sort(transform(hits, x -> struct(x.place AS a, x.place + x.size AS z))), struct(0 AS upto, 0L AS n),
        (s, x) -> struct(greatest(s.upto, x.z) AS upto, s.n + greatest(0, x.z - greatest(x.a, s.upto)) AS n), s -> s.n)""")
    hit = matches.select("key", covered.alias("n_hit"))
    ids = stored(test_windows(benchmark, width).where("item IS NOT NULL").select("window", "item").distinct(), "items")
    listed = (
        matches.select("key", F.explode(F.array_distinct(F.transform("hits", lambda x: x["window"]))).alias("window")).join(sized(ids, 40, "item"), "window").groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("found"))
        .select("key", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"))
    )
    # matches of repeated rows join to each of them, once: both sides are one row per key
    per_key = hit.join(listed, "key", "left")
    sizes = base.select("doc_id", "key", F.size(words_of("text")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return sizes.join(per_key, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("key.h").alias("text_hash"),
    )
