"""Registered queries work on whole tables, not on a bounded number of rows."""

from pyspark.sql import functions as F

from pixelloom.operators import sampling as S
from pixelloom.plans import models, stats
from pixelloom.sources import npy
from pixelloom.sources.derived import FEATURES, feature_rows

DATA = "/root/testdata/sf0.001"


def test_the_ensemble_scores_every_validation_row(spark):
    rows = feature_rows(spark, DATA)
    n = models.QUERIES["model_ensemble"](spark, DATA).agg(F.sum("n")).first()[0]
    assert n == S.split(rows, label="label").where("part = 'valid'").count() > 1000


def test_model_queries_read_all_rows(spark, monkeypatch):
    assert models._rows(spark, DATA).count() == feature_rows(spark, DATA).count()
    seen = []
    monkeypatch.setattr(stats.X, "rfe", lambda df, *a, **k: seen.append(df.count()) or [0])
    stats.QUERIES["select_rfe"](spark, DATA)
    assert seen == [feature_rows(spark, DATA).count()] and len(FEATURES) == 8


def test_every_vector_makes_the_round_trip(spark, tmp_path):
    import __spark_entry__ as e

    want = {r[0]: r[1] for r in spark.sql(f"SELECT vec_id, embedding FROM parquet.`{DATA}/embeddings.parquet`").collect()}
    got = {r["row"]: r["first"] for r in e.queries()["npy_round_trip_all"](spark, DATA).collect()}
    assert got == {k: float(v[0]) for k, v in want.items()} and len(got) > 50
    assert {r["row"] for r in e.queries()["npy_round_trip"](spark, DATA).collect()} == set(range(50))
    odd = spark.createDataFrame([("a", [1.0, 2.0]), ("bcd", [3.0]), ("e", None)], "k string, v array<double>")
    assert npy.write_npy_rows(odd, "k", "v", str(tmp_path / "n")) == 3
    assert {r[0]: r[1] for r in npy.read_npy_rows(spark, str(tmp_path / "n")).collect()} == {"a": [1.0, 2.0], "bcd": [3.0], "e": []}


def test_co_occurrence_at_every_drawn_pixel(spark):
    import __spark_entry__ as e

    drawn = {(r["image_id"], r["pixel_idx"]) for r in e.queries()["sample_boundary"](spark, DATA).collect()}
    got = {(r["image_id"], r["pixel_idx"]) for r in e.queries()["glcm_boundary_sample"](spark, DATA).collect()}
    assert got == drawn and len({p for _, p in got}) > 1


def test_size_sweep_has_every_method_and_the_baseline(spark):
    got = {r["method"]: r.asDict() for r in models.QUERIES["select_size_sweep"](spark, DATA).collect()}
    assert set(got) == {"all", "mrmr", "anova", "rfe"} and got["all"]["8"] is not None
    assert all(got[m][n] is not None for m in ("mrmr", "anova", "rfe") for n in ("2", "4", "6"))
