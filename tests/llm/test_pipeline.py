"""The pipeline's stages on awkward rows and against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]


def shingles(text, k=5):
    import re

    w = [x for x in re.split("[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def kept_brute(rows):
    """(doc_id, text) rows that stay: one of each component of similar sets, all without words."""
    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                own[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return [g for g in groups.values()]


def test_near_duplicates_keep_one_of_each_group(spark, rows):
    base = " ".join(f"w{i}" for i in range(60))
    odd = [(1, base), (1, "another text of its own"), (1, base), (2, base + " x"), (None, base), (None, "alone and unlike"), (None, None), (None, ""), (5, None), (5, " "), (2, "alone and unlike")]
    all_rows = [(1000 + r["doc_id"], r["text"]) for r in rows.collect()] + odd
    d = spark.createDataFrame(all_rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("node", F.lit("n"))
    kept = cp.near_duplicates(spark, d, DATA)
    assert kept.columns == d.columns
    got, groups = [(r["doc_id"], r["text"]) for r in kept.collect()], kept_brute(all_rows)
    assert len(got) == len(groups)
    for g in groups:
        stay = [r for r in g if r in got]
        assert stay and stay[0][0] == min((d for d, _ in g if d is not None), default=None)


def test_quality_keeps_the_rows_that_the_operator_accepts(spark, rows):
    from pixelloom.llm.quality import quality_scores

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = sorted(r["doc_id"] for r in quality_scores(rows, labels).collect() if r["score"] >= 0.3)
    assert sorted(r["doc_id"] for r in cp.quality(spark, rows, DATA).collect()) == want and 0 < len(want) < rows.count()


def test_packing_places_every_token_of_what_is_left(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = cp.packed(spark, rows, DATA).collect()
    length = {}
    for r in got:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert length == {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows.collect()}


def test_decontamination_removes_passages_and_nothing_else(spark, rows):
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    schema = "doc_id long, text string, key string"
    d = spark.createDataFrame([(1, "so " + passage, "a"), (2, "clean words only", "b"), (None, passage, "c"), (None, None, "d"), (3, None, "e")], schema)
    assert sorted(r["key"] for r in cp.decontaminated(spark, d, DATA).collect()) == ["b", "d", "e"]


def test_whole_pipeline_is_its_stages_in_turn(spark, rows):
    out = cp.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    docs = rows
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_table_passes_through(spark, rows):
    docs = rows.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
