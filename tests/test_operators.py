import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import blending as B
from pixelloom.operators import labels as L
from pixelloom.operators import metrics as M
from pixelloom.operators import sampling as S
from pixelloom.operators import scaling as C
from pixelloom.operators import selection as X
from pixelloom.sources import npy


def mask(spark, rows, h=5, w=5):
    """rows: {(r, c): (class, instance)}"""
    return spark.createDataFrame([(0, r, c, *rows.get((r, c), (0, 0)), 1.0) for r in range(h) for c in range(w)], "image_id long, r long, c long, class_id long, inst_id long, v double")


def test_erosion_is_per_instance_and_the_border_counts_as_inside(spark):
    two = {(r, c): (0, 1 if c < 2 else 2) for r in range(5) for c in range(4)}
    left = {(x["r"], x["c"]) for x in L.eroded(mask(spark, two), 5, 5, 1).collect()}
    # column 1 and 2 touch the other instance, column 3 the background; column 0 lies at the image's border
    assert left == {(r, 0) for r in range(5)}


def test_interior_wins_over_boundary(spark):
    lab = {(x["r"], x["c"]): x["label"] for x in L.three_class_labels(mask(spark, {(r, c): (1, 1) for r in range(3) for c in range(3)}), 5, 5, 1).collect()}
    assert lab[0, 0] == 1 and lab[1, 1] == 1 and lab[2, 2] == 2 and lab[4, 4] == 0


def test_small_regions_are_dropped(spark):
    m = mask(spark, {(0, 0): (0, 1), **{(r, c): (1, 2) for r in (2, 3) for c in range(5)}})
    r = L.instances(m, 10).collect()
    assert [(x["inst_id"], x["area"], x["r0"], x["c0"], x["r1"], x["c1"], x["class_name"]) for x in r] == [(2, 10, 2, 0, 4, 5, "inflammatory")]


def labels(spark, nucleus, h=8, w=8):
    return spark.createDataFrame([(0, r, c, int((r, c) in nucleus)) for r in range(h) for c in range(w)], "image_id long, r long, c long, label long")


def test_sample_sizes_and_no_repeats(spark):
    d = S.boundary_sample(labels(spark, {(0, 0), (0, 1), (0, 2)}), 10, 3.0, 2, width=8).collect()
    by = {k: [x["pixel_idx"] for x in d if x["label"] == k] for k in (0, 1)}
    assert len(by[0]) == len(set(by[0])) == 10 and sorted(by[1]) == [0, 1, 2]


def test_no_nucleus_no_boost(spark):
    d = S.boundary_sample(labels(spark, set()), 5, 3.0, 10, width=8).collect()
    assert len(d) == 5 and {x["weight"] for x in d} == {1.0}


def test_sampling_ignores_partitioning(spark):
    px = labels(spark, {(r, c) for r in range(3) for c in range(3)})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.boundary_sample(px.repartition(1), 7, width=8)) == key(S.boundary_sample(px.repartition(7), 7, width=8))


def test_stratified_sample_has_exact_quotas(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("long").alias("label"))
    n = {r["label"]: r["count"] for r in S.stratified_sample(df, 100).groupBy("label").count().collect()}
    assert n == {0: 75, 1: 25}
    assert S.stratified_sample(df, 5000).count() == 1000


def test_scalers(spark):
    df = spark.createDataFrame([(float(i), 5.0, float("nan") if i == 3 else float(i)) for i in range(11)], "a double, flat double, holes double")
    m = C.fit(df, {"a": "standard", "flat": "robust", "holes": "pass"})
    out = m.transform(df).toPandas()
    assert out["a"].mean() == pytest.approx(0) and out["a"].std(ddof=0) == pytest.approx(1) and (out["flat"] == 0).all() and out["holes"][3] == 0
    assert C.ScalerModel.from_json(m.to_json()).transform(df).toPandas().equals(out)
    with pytest.raises(ValueError):
        C.fit(df, {"a": "unknown"})


def test_quantile_scaler_is_a_rank(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(101)], "a double")
    u = C.fit(df, {"a": "quantile_uniform"}).transform(df).toPandas()["a"].to_numpy()
    assert np.allclose(u, np.arange(101) / 100, atol=2e-3)


def test_yeo_johnson_likelihood():
    x = np.random.default_rng(0).lognormal(0, 0.5, 4000) - 1
    assert abs(C._best_lambda(x)) < 0.6 and C._best_lambda(np.ones(5)) == 1.0


def test_feature_registry():
    names = X.feature_names()
    assert len(names) == len(set(names)) == 93 and names[0] == "od_R" and names[85:87] == ["entropy", "edge_dist"] and names[-1] == "glcm_ASM"


def blocks(spark, copies=40):
    """Columns a and b say y together, c nearly repeats a, d is constant, e is unrelated."""
    rows = []
    for i in range(16 * copies):
        a, b, e = i % 4, i // 4 % 4, i % 7
        rows.append((float(a), float(b), a + 0.01 * (i % 3), 1.5, float(e), int(a + b > 2)))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, label int"), np.array(rows)


def test_mrmr_takes_what_says_something_new(spark):
    df, _ = blocks(spark)
    got = X.mrmr(df, list("abcde"), 2)
    assert 1 in got and {0, 2} & set(got)  # b, and one of the two that say the same
    with pytest.raises(ValueError):
        X.mrmr(df, ["a"], 2)
    with pytest.raises(ValueError):
        X.select(df, ["a"], 1, "unknown")


def test_moments_give_correlations_and_f(spark):
    df, x = blocks(spark)
    r = {(v["a"], v["b"]): v["r"] for v in X.correlations(df, list("abcde")).collect()}
    assert abs(r["a", "c"] - abs(np.corrcoef(x[:, 0], x[:, 2])[0, 1])) < 1e-12 and r["a", "d"] == 0 and len(r) == 10
    f = {v["feature"]: v["f"] for v in X.anova_f(df, list("abcde")).collect()}
    groups = [x[x[:, 5] == k, 1] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - x[:, 1].mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert abs(f["b"] / (between / (within / (len(x) - 2))) - 1) < 1e-9 and f["d"] == 0


def test_ninety_three_columns_take_one_scan(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 93)) @ g.normal(size=(93, 93)) * 0.2
    names = X.feature_names()
    df = spark.createDataFrame([(*map(float, v), i % 3) for i, v in enumerate(x)], ", ".join(f"`{n}` double" for n in names) + ", label int")
    want = np.abs(np.corrcoef(x.T))
    got = X.correlations(df, names).collect()
    at = {n: i for i, n in enumerate(names)}
    assert len(got) == 93 * 92 // 2 and max(abs(v["r"] - want[at[v["a"]], at[v["b"]]]) for v in got) < 1e-9
    assert len(X.mrmr(df, names, 20)) == 20


def test_exact_percentiles(spark):
    import pandas as pd

    from pixelloom.operators import scaling

    g = np.random.default_rng(5)
    data = pd.DataFrame({"a": g.normal(size=3001), "b": g.integers(0, 5, 3001).astype(float), "c": np.full(3001, 2.0)})
    p = [0.0, 0.01, 0.25, 0.5, 0.777, 0.95, 1.0]
    got = scaling.exact_percentiles(spark.createDataFrame(data), dict.fromkeys("abc", p))
    for n in "abc":
        assert np.allclose(got[n], np.quantile(data[n], p), atol=1e-12)
    assert scaling.exact_percentiles(spark.createDataFrame([], "a double"), {"a": [0.5]}) == {"a": None}


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from pixelloom.operators import scaling

    u = [1e-7, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.9, 0.98, 1 - 1e-7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(scaling._normal_quantile(F.col("u"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in u], atol=1e-7)


def test_split_keeps_the_shares_of_labels(spark):
    from pixelloom.operators import sampling

    df = spark.range(5000).selectExpr("id AS row_id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 3 THEN 'x' ELSE 'y' END AS label")
    parts = {(r["label"], r["part"]): r["count"] for r in sampling.split(df, 0.2, label="label").groupBy("label", "part").count().collect()}
    assert parts["x", "valid"] == 200 and parts["y", "valid"] == 700 and sum(parts.values()) == 5000


# A published confusion matrix (true by predicted) and its macro-F1.
def test_macro_f1_of_a_published_confusion_matrix(spark):
    cm = spark.createDataFrame([(0, 0, 872144), (0, 1, 137056), (1, 0, 98268), (1, 1, 856969)], "truth long, predicted long, n long")
    assert M.macro_f1(cm).first()[0] == pytest.approx(0.880201, abs=1e-6)


def test_curves_collapse_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, label long")
    assert M.roc_curve(df, "p").count() == 3 and M.roc_auc(df, "p").first()[0] == pytest.approx(0.875)
    assert M.average_precision(df, "p").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_blend_and_simplex(spark):
    df = spark.createDataFrame([(0.25, 1.0), (0.5, 0.0)], "one double, two double")
    assert [round(r["p1"], 9) for r in B.blend(df, {"one": 3, "two": 1}).collect()] == [0.4375, 0.375]
    assert len(B.simplex(10)) == 66 and len(B.simplex(2)) == 6


def test_weight_surface_counts_every_vector(spark):
    g = np.random.default_rng(9)
    p, y = g.random((500, 3)), g.integers(0, 2, 500)
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(p, y)], "a double, b double, c double, label int")
    got = {(r["w_a"], r["w_b"], r["w_c"]): r["macro_f1"] for r in B.weight_surface(df, ("a", "b", "c"), parts=4).collect()}
    assert len(got) == 15
    for w, f in got.items():
        hit = p @ np.array(w) > 2
        one = lambda h, t: 2 * (h & t).sum() / max(1, h.sum() + t.sum())
        assert abs(f - (one(hit, y == 1) + one(~hit, y == 0)) / 2) < 1e-9


def test_npy_headers():
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert (npy.load(npy.dump(x)) == x).all()
    raw = npy.dump(x).replace(b"(2, 3)", b"(np.int64(2), 3)")
    n = len(raw) - len(npy.dump(x))
    raw = raw[:8] + (int.from_bytes(raw[8:10], "little") + n).to_bytes(2, "little") + raw[10:]
    assert (npy.load(raw) == x).all()
    with pytest.raises(ValueError):
        npy.load(b"nothing of the kind")


def test_feature_list_needs_equal_lengths(spark, tmp_path):
    from pixelloom.sources import artefacts as A

    with pytest.raises(ValueError):
        A.save_feature_list(spark, str(tmp_path), "mrmr", [1], ["a", "b"])
    to = A.save_feature_list(spark, str(tmp_path), "mrmr", [3], ["a"])
    assert json.loads(spark.read.text(to + "/json").first()[0])["names"] == ["a"]


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    from pixelloom.streaming.ingest import ingest_parquet

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    assert ingest_parquet(spark, src, out, "id").count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert sorted(r[0] for r in ingest_parquet(spark, src, out, "id").collect()) == list(range(15))


def test_scalers_of_one_count_equal_those_fitted_apart(spark):
    from pixelloom.operators import scaling as C

    df = spark.createDataFrame([(float(i * i % 37), None if i % 5 == 0 else i / 7.0) for i in range(120)], "a double, b double")
    kinds = ["standard", "robust", "robust_wide", "quantile_uniform", "quantile_normal"]
    each = C.fit_each(df, ["a", "b"], kinds)
    for k in kinds[1:4]:
        assert each[k].params == C.fit(df, dict.fromkeys(["a", "b"], k)).params
    q = each["quantile_uniform"].transform(df)
    apart = [tuple(r) for r in each["quantile_normal"].transform(df).collect()]
    assert [tuple(r) for r in q.select(C.normal_of(q["a"]), C.normal_of(q["b"])).collect()] == apart
    scaled = each["standard"].transform(df)
    rows = scaled.collect()
    got = {r["grp"]: (r["cells"], r["share"]) for r in C.outliers(scaled, {"a": "x", "b": "y"}, 1.0).collect()}
    over, held = ([f([r[c] for r in rows if r[c] is not None]) for c in "ab"] for f in (lambda v: sum(abs(x) > 1 for x in v), len))  # nulls have no share
    assert got == {"x": (120, over[0] / held[0]), "y": (120, over[1] / held[1]), "Global": (240, sum(over) / sum(held))}


def test_power_exponent_is_of_maximum_likelihood_over_all_rows(spark):
    # more rows than the 50,000 of the former sample
    i = F.col("id")
    df = spark.range(120_000).select(
        F.pow(i % 7, F.lit(2)).alias("few"), (F.exp(i % 997 / 300) - 3).alias("signed"), (-1e4 - F.sqrt(i)).alias("negative"),
        F.when(i % 3 == 0, None).when(i % 3 == 1, F.sqrt(i)).otherwise(float("nan")).alias("holes"), F.lit(4.0).alias("flat"), F.lit(None).cast("double").alias("empty"),
    )
    names = df.columns
    model = C.fit(df, dict.fromkeys(names, "power"))
    lam = {n: p["lambda"] for n, p in model.params.items()}
    k = np.arange(120_000)
    held = {"few": (k % 7) ** 2.0, "signed": np.exp(k % 997 / 300) - 3, "holes": np.where(k % 3 == 1, np.sqrt(k), 0.0)[k % 3 != 0]}

    def loss(x, e):
        y = np.where(x >= 0, ((np.maximum(x, 0) + 1) ** e - 1) / e, -((np.maximum(-x, 0) + 1) ** (2 - e) - 1) / (2 - e))
        return np.log(y.var()) / 2 - (e - 1) * (np.sign(x) * np.log1p(np.abs(x))).mean()

    for n, x in held.items():
        assert loss(x, lam[n]) < min(loss(x, lam[n] - 1e-4), loss(x, lam[n] + 1e-4)), n
    assert lam["flat"] == lam["empty"] == 1.0 and C.ScalerModel.from_json(model.to_json()) == model
    # the mirror of a column has 2 less its exponent; how rows are dealt doesn't matter, nor which kinds are fitted together
    mirror = C.fit(df.select(*((-F.col(n)).alias(n) for n in held)), dict.fromkeys(held, "power")).params
    assert all(mirror[n]["lambda"] == pytest.approx(2 - lam[n], abs=2e-6) for n in held)
    each = C.fit_each(df.repartition(7), names, ["standard", "robust", "power"])["power"]
    assert {n: p["lambda"] for n, p in each.params.items()} == lam
