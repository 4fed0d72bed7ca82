"""Registered queries: sampling, scaling, selection, evaluation and blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import blending as B
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import scaling as C
from ..operators import selection as X
from ..sources.derived import FEATURES, MODELS, SIDE, feature_rows, gray_pixels, mask_pixels, rgb_pixels, score_rows, unit_sql, with_sql

R = P.rounded
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LAB = with_sql("mask") + ", lab AS (SELECT image_id, r, c, CAST(inst_id > 0 AS BIGINT) AS label FROM mask)"
_KEY = f"round(-ln(greatest({unit_sql(chr(39) + '42' + chr(39), 'image_id', '(r * 8 + c)')}, 0.000000000001)) / weight, 9)"


def _labels(spark, sf_dir):
    return L.binary_labels(mask_pixels(spark, sf_dir))


@query(_LAB + f""", near AS (
  SELECT DISTINCT b.image_id, b.r, b.c FROM lab b JOIN lab n ON b.image_id = n.image_id AND b.label = 0 AND n.label = 1
    AND (b.r - n.r) * (b.r - n.r) + (b.c - n.c) * (b.c - n.c) < 4
), w AS (SELECT l.*, CASE WHEN n.r IS NOT NULL THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lab l LEFT JOIN near n USING (image_id, r, c)),
k AS (SELECT image_id, label, r * 8 + c AS pixel_idx, weight, {_KEY} AS key FROM w),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY key, pixel_idx) AS rk FROM k)
SELECT image_id, label, pixel_idx, weight FROM q WHERE rk <= 5""")
def sample_boundary(spark, sf_dir):
    return S.boundary_sample(_labels(spark, sf_dir), per_class=5, boost=3.0, distance=2, width=SIDE)


@query(_LAB + f""", w AS (SELECT *, 1.0::DOUBLE AS weight FROM lab),
k AS (SELECT image_id, label, r * 8 + c AS pixel_idx, weight, {_KEY} AS key FROM w),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY key, pixel_idx) AS rk FROM k)
SELECT image_id, label, pixel_idx, weight FROM q WHERE rk <= 7""")
def sample_uniform(spark, sf_dir):
    return S.boundary_sample(_labels(spark, sf_dir), per_class=7, boost=1, width=SIDE)


@query(_LAB + """, near AS (
  SELECT DISTINCT b.image_id, b.r, b.c FROM lab b JOIN lab n ON b.image_id = n.image_id AND b.label = 0 AND n.label = 1
    AND (b.r - n.r) * (b.r - n.r) + (b.c - n.c) * (b.c - n.c) < 4
) SELECT image_id, r, c FROM near""")
def near_boundary(spark, sf_dir):
    return S.near_nuclei(_labels(spark, sf_dir), 2)


@query(_LAB + " SELECT sum(least(20, k))::BIGINT AS n FROM (SELECT image_id, label, count(*) AS k FROM lab GROUP BY 1, 2)")
def sample_count_pass(spark, sf_dir):
    return S.sample_size(_labels(spark, sf_dir), 20)


@query(_LAB + """, k AS (SELECT image_id, label, least(20, count(*)) AS n FROM lab GROUP BY 1, 2), t AS (SELECT image_id, sum(n) AS n FROM k GROUP BY 1)
SELECT 'images' AS what, count(*) AS k, round(avg(n), 6) + 0.0 AS mean, round(stddev_pop(n), 6) + 0.0 AS sd FROM t
UNION ALL SELECT 'class ' || label, count(*), round(avg(n), 6) + 0.0, round(stddev_pop(n), 6) + 0.0 FROM k GROUP BY label""")
def sample_balance(spark, sf_dir):
    k = _labels(spark, sf_dir).groupBy("image_id", "label").agg(F.least(F.lit(20), F.count("*")).alias("n"))
    stats = [F.count("*").alias("k"), R(F.avg("n")).alias("mean"), R(F.stddev_pop("n")).alias("sd")]
    images = k.groupBy("image_id").agg(F.sum("n").alias("n")).agg(*stats).select(F.lit("images").alias("what"), "k", "mean", "sd")
    return images.unionByName(k.groupBy("label").agg(*stats).select(F.concat(F.lit("class "), F.col("label").cast("string")).alias("what"), "k", "mean", "sd"))


def _strata(n: int, quota: str) -> str:
    return with_sql("feats") + f""", u AS (SELECT row_id, label, {unit_sql("'42'", "row_id")} AS u FROM feats),
q AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY u, row_id) AS rk, count(*) OVER (PARTITION BY label) AS k, count(*) OVER () AS n FROM u)
SELECT row_id, label FROM q WHERE rk <= {quota.format(n=n)}"""


@query(_strata(5000, "({n} * k) // n"))
def sample_stratified(spark, sf_dir):
    return S.stratified_sample(feature_rows(spark, sf_dir).select("row_id", "label"), 5000)


@query(_strata(50, "greatest(1, ({n} * k) // n)"))
def sample_proportional(spark, sf_dir):
    return S.stratified_sample(feature_rows(spark, sf_dir).select("row_id", "label"), 50, least_one=True)


@query(with_sql("feats") + f""", u AS (SELECT row_id, label, {unit_sql("'42'", "'split'", "row_id")} AS u FROM feats), r AS (
  SELECT label, row_id, rank() OVER (PARTITION BY label ORDER BY u, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT CASE WHEN r <= floor(0.2 * n) THEN 'valid' ELSE 'train' END AS part, label, count(*) AS n, CAST(sum(row_id % 1000) AS BIGINT) AS ids FROM r GROUP BY 1, 2""")
def sample_split(spark, sf_dir):
    parts = S.split(feature_rows(spark, sf_dir).select("row_id", "label"), label="label")
    return parts.groupBy("part", "label").agg(F.count("*").alias("n"), F.sum(F.col("row_id") % 1000).cast("long").alias("ids"))


@query(with_sql("feats") + " SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM feats GROUP BY 1")
def class_counts(spark, sf_dir):
    from pyspark.sql import Window

    n = feature_rows(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("share", R(F.col("n") / F.sum("n").over(Window.partitionBy())))


def _standard_sql(names, fn) -> str:
    stats = ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s" for n in names)
    return with_sql("feats") + f", st AS (SELECT {stats} FROM feats) SELECT row_id, " + ", ".join(fn.format(n=n) for n in names) + " FROM feats, st"


@query(_standard_sql(FEATURES, "round(({n} - {n}_m) / CASE WHEN {n}_s = 0 THEN 1 ELSE {n}_s END, 5) + 0.0 AS {n}"))
def scale_standard(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", *FEATURES)
    out = C.fit(rows, dict.fromkeys(FEATURES, "standard")).transform(rows)
    return out.select("row_id", *(R(F.col(c), 5).alias(c) for c in FEATURES))


def _robust_sql(low: float, high: float) -> str:
    stats = ", ".join(f"quantile_cont({n}, 0.5) AS {n}_m, quantile_cont({n}, {high}) - quantile_cont({n}, {low}) AS {n}_s" for n in FEATURES)
    return with_sql("feats") + f", st AS (SELECT {stats} FROM feats) SELECT row_id, " + ", ".join(f"round(({n} - {n}_m) / CASE WHEN {n}_s = 0 THEN 1 ELSE {n}_s END, 6) + 0.0 AS {n}" for n in FEATURES) + " FROM feats, st"


@query(_robust_sql(0.25, 0.75))
def scale_robust(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", *FEATURES)
    out = C.fit(rows, dict.fromkeys(FEATURES, "robust")).transform(rows)
    return out.select("row_id", *(R(F.col(c)).alias(c) for c in FEATURES))


@query(_robust_sql(0.05, 0.95))
def scale_robust_wide(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", *FEATURES)
    out = C.fit(rows, dict.fromkeys(FEATURES, "robust_wide")).transform(rows)
    return out.select("row_id", *(R(F.col(c)).alias(c) for c in FEATURES))


@query(with_sql("feats") + """, t AS (SELECT row_id, f_net / 10000 - 5 AS x FROM feats),
y AS (SELECT row_id, CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(-x + 1, 1.5) - 1) / 1.5 END AS y FROM t)
SELECT row_id, round(y, 6) + 0.0 AS y FROM y""")
def scale_yeo_johnson(spark, sf_dir):
    x = F.col("f_net") / 10000 - 5
    return feature_rows(spark, sf_dir).select("row_id", R(C.yeo_johnson(x, 0.5)).alias("y"))


@query()
def scale_power_fitted(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", "f_price", "f_net")
    return C.fit(rows, {"f_price": "power", "f_net": "power"}).transform(rows).agg(R(F.avg("f_price"), 4).alias("mean_price"), R(F.stddev_pop("f_price"), 4).alias("sd_price"), F.count("*").alias("n"))


@query(with_sql("feats") + f""", pts AS (SELECT quantile_cont(f_price, {[i / 1000 for i in range(1001)]}) AS q FROM feats),
p AS (SELECT unnest(q) AS lo, unnest(range(1001)) AS i, unnest(list_append(q[2:], NULL)) AS hi FROM pts),
m AS (SELECT min(lo) AS a, max(lo) AS z FROM p)
SELECT row_id, round(CASE WHEN f_price <= a THEN 0.0 WHEN f_price >= z THEN 1.0 ELSE (i + (f_price - lo) / (hi - lo)) / 1000.0 END, 6) + 0.0 AS u
FROM feats, m LEFT JOIN p ON f_price >= lo AND f_price < hi""")
def scale_quantile_uniform(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", "f_price")
    return C.fit(rows, {"f_price": "quantile_uniform"}).transform(rows).select("row_id", R(F.col("f_price")).alias("u"))


@query()
def scale_quantile_normal(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", "f_price")
    return C.fit(rows, {"f_price": "quantile_normal"}).transform(rows).select("row_id", R(F.col("f_price"), 4).alias("z"))


#: The group scaler on the derived columns: a scaler for each group of columns, all fitted in one pass.
GROUP_KINDS = {"f_quantity": "pass", "f_price": "standard", "f_discount": "pass", "f_tax": "robust_wide", "f_unit": "robust_wide", "f_net": "standard", "f_line": "pass", "f_days": "standard"}


@query(with_sql("feats") + """, st AS (SELECT avg(f_price) AS pm, stddev_pop(f_price) AS ps, avg(f_net) AS nm, stddev_pop(f_net) AS ns, avg(f_days) AS dm, stddev_pop(f_days) AS ds,
  quantile_cont(f_tax, [0.05, 0.5, 0.95]) AS t, quantile_cont(f_unit, [0.05, 0.5, 0.95]) AS u FROM feats)
SELECT row_id, f_quantity, round((f_price - pm) / ps, 5) + 0.0 AS f_price, f_discount, round((f_tax - t[2]) / (t[3] - t[1]), 5) + 0.0 AS f_tax, round((f_unit - u[2]) / (u[3] - u[1]), 5) + 0.0 AS f_unit,
  round((f_net - nm) / ns, 5) + 0.0 AS f_net, f_line, round((f_days - dm) / ds, 5) + 0.0 AS f_days FROM feats, st""")
def scale_by_group(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", *FEATURES)
    out = C.fit(rows, GROUP_KINDS).transform(rows)
    return out.select("row_id", *((F.col(c) if GROUP_KINDS[c] == "pass" else R(F.col(c), 5)).alias(c) for c in FEATURES))


_GROUPS = {"f_quantity": "count", "f_price": "money", "f_discount": "rate", "f_tax": "rate", "f_unit": "money", "f_net": "money", "f_line": "count", "f_days": "time"}


@query(_standard_sql(FEATURES, "({n} - {n}_m) / {n}_s AS {n}").replace(" SELECT row_id,", " , z AS (SELECT row_id,") + """), o AS (""" + " UNION ALL ".join(
    f"SELECT '{g}' AS grp, CAST(abs({n}) > 1.7 AS INT) AS o FROM z" for n, g in _GROUPS.items()) + """)
SELECT coalesce(grp, 'Global') AS grp, count(*) AS cells, round(avg(o), 6) + 0.0 AS share FROM o GROUP BY ROLLUP (grp)""")
def scale_outliers(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("row_id", *FEATURES)
    return C.outliers(C.fit(rows, dict.fromkeys(FEATURES, "standard")).transform(rows), _GROUPS, 1.7).select("grp", "cells", R(F.col("share")).alias("share"))


@query(with_sql("feats") + f""" SELECT round(({' + '.join(f'abs(avg({n}))' for n in FEATURES)}) / 8, 4) + 0.0 AS mean_abs_mean, round(greatest({', '.join(f'abs(avg({n}))' for n in FEATURES)}), 4) + 0.0 AS max_abs_mean,
round(({' + '.join(f'abs(quantile_cont({n}, 0.5))' for n in FEATURES)}) / 8, 4) + 0.0 AS mean_abs_median, round(({' + '.join(f'avg(CAST(abs({n}) > 3 AS INT))' for n in FEATURES)}) / 8, 6) + 0.0 AS outliers FROM feats""")
def scale_spot_check(spark, sf_dir):
    out = C.spot_check(feature_rows(spark, sf_dir), FEATURES)
    return out.select(R(F.col("mean_abs_mean"), 4).alias("mean_abs_mean"), R(F.col("max_abs_mean"), 4).alias("max_abs_mean"), R(F.col("mean_abs_median"), 4).alias("mean_abs_median"), R(F.col("outliers")).alias("outliers"))


def _long(label="label") -> str:
    return ", x AS (" + " UNION ALL ".join(f"SELECT {i} AS idx, '{n}' AS feature, {label} AS y, {n} AS x FROM feats" for i, n in enumerate(FEATURES)) + ")"


_F = _long() + """, g AS (SELECT idx, feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM x GROUP BY ALL), t AS (SELECT idx, avg(x) AS m FROM x GROUP BY 1),
f AS (SELECT idx, feature, (sum(g.n * (g.m - t.m) * (g.m - t.m)) / (count(*) - 1)) / (sum(ss) / (sum(g.n) - count(*))) AS f FROM g JOIN t USING (idx) GROUP BY ALL)"""


@query(with_sql("feats") + _F + " SELECT feature, round(f, 4) + 0.0 AS f FROM f")
def select_anova(spark, sf_dir):
    return X.anova_f(feature_rows(spark, sf_dir), FEATURES).select("feature", R(F.col("f"), 4).alias("f"))


@query(with_sql("feats") + _F + " SELECT rk AS rank, idx::BIGINT AS idx, feature FROM (SELECT *, row_number() OVER (ORDER BY f DESC, idx DESC) AS rk FROM f) WHERE rk <= 3")
def select_anova_top(spark, sf_dir):
    return X.anova_top(feature_rows(spark, sf_dir), FEATURES, 3).select(F.col("rank").cast("long").alias("rank"), F.col("idx").cast("long").alias("idx"), "feature")


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_CORR = ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM feats" for a, b in _PAIRS) + ")"


@query(with_sql("feats") + _CORR + " SELECT a, b, round(r, 6) + 0.0 AS r FROM c")
def select_correlations(spark, sf_dir):
    return X.correlations(feature_rows(spark, sf_dir), FEATURES).select("a", "b", R(F.col("r")).alias("r"))


@query(with_sql("feats") + _CORR + " SELECT a, b, round(r, 6) + 0.0 AS r FROM c WHERE r > 0.5")
def select_high_pairs(spark, sf_dir):
    return X.high_pairs(feature_rows(spark, sf_dir), FEATURES, 0.5).select("a", "b", R(F.col("r")).alias("r"))


@query(with_sql("feats") + _F + _CORR + """, rel AS (SELECT idx, feature, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS v FROM f),
sym AS (SELECT a, b, r FROM c UNION ALL SELECT b, a, r FROM c),
s1 AS (SELECT * FROM rel ORDER BY v DESC, idx LIMIT 1),
s2 AS (SELECT rel.idx, rel.feature FROM rel JOIN sym ON sym.a = rel.feature AND sym.b = (SELECT feature FROM s1) ORDER BY v - r DESC, rel.idx LIMIT 1),
s3 AS (SELECT rel.idx, rel.feature FROM rel JOIN sym ON sym.a = rel.feature AND sym.b IN (SELECT feature FROM s1 UNION SELECT feature FROM s2) WHERE rel.feature NOT IN (SELECT feature FROM s1 UNION SELECT feature FROM s2)
       GROUP BY rel.idx, rel.feature, v ORDER BY v - avg(r) DESC, rel.idx LIMIT 1)
SELECT 1::BIGINT AS rank, idx::BIGINT AS idx, feature FROM s1 UNION ALL SELECT 2, idx, feature FROM s2 UNION ALL SELECT 3, idx, feature FROM s3""")
def select_mrmr(spark, sf_dir):
    chosen = X.mrmr(feature_rows(spark, sf_dir), FEATURES, 3)
    return spark.createDataFrame([(k + 1, i, FEATURES[i]) for k, i in enumerate(chosen)], "rank long, idx long, feature string")


_SETS = [("mrmr", ["od_R", "entropy", "lbp_r1"]), ("anova", ["od_R", "entropy", "edge_dist"]), ("rfe", ["glcm_ASM"])]
_SETS_SQL = "sets(method, names) AS (VALUES " + ", ".join(f"('{m}', {n})" for m, n in _SETS) + ")"


@query("WITH " + _SETS_SQL + """ SELECT a.method AS a, b.method AS b,
  round(len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))), 6) + 0.0 AS jaccard FROM sets a, sets b""")
def select_jaccard(spark, sf_dir):
    return X.jaccard(spark.createDataFrame(_SETS, "method string, names array<string>")).select("a", "b", R(F.col("jaccard")).alias("jaccard"))


@query("WITH " + _SETS_SQL + " SELECT method, split_part(n, '_', 1) AS grp, count(*) AS n FROM (SELECT method, unnest(names) AS n FROM sets) GROUP BY 1, 2")
def select_group_contribution(spark, sf_dir):
    names = spark.createDataFrame(_SETS, "method string, names array<string>").select("method", F.explode("names").alias("name"))
    groups = spark.createDataFrame([(n, X.feature_group(n)) for n in X.feature_names()], "name string, grp string")
    return names.join(F.broadcast(groups), "name").groupBy("method", "grp").agg(F.count("*").alias("n"))


_F1 = [("mrmr", 10, 0.80), ("mrmr", 15, 0.85), ("mrmr", 20, 0.8515), ("mrmr", 25, 0.86), ("rfe", 10, 0.8), ("rfe", 15, 0.81), ("rfe", 20, 0.82), ("rfe", 25, 0.83)]


@query("WITH s(method, n, f1) AS (VALUES " + ", ".join(f"('{m}', {n}, {f}::DOUBLE)" for m, n, f in _F1) + """), b AS (SELECT *, lag(f1) OVER (PARTITION BY method ORDER BY n) AS p FROM s)
SELECT method, coalesce(min(CASE WHEN n >= 15 AND f1 - p < 0.002 THEN n END), 20)::BIGINT AS n FROM b GROUP BY 1""")
def select_elbow(spark, sf_dir):
    return X.elbow(spark.createDataFrame(_F1, "method string, n long, f1 double")).select("method", F.col("n").cast("long").alias("n"))


@query()
def select_rfe(spark, sf_dir):
    chosen = X.rfe(feature_rows(spark, sf_dir), FEATURES, 4, step=2, iterations=30)
    return spark.createDataFrame([(i, FEATURES[i]) for i in chosen], "idx long, feature string")


_CM = ", cm AS (SELECT label AS truth, CAST(lgbm >= 0.5 AS BIGINT) AS predicted, count(*) AS n FROM scores GROUP BY 1, 2)"


def _predicted(spark, sf_dir):
    return score_rows(spark, sf_dir).withColumn("predicted", P.threshold_label(F.col("lgbm")))


@query(with_sql("scores") + _CM + " SELECT * FROM cm")
def metric_confusion(spark, sf_dir):
    return M.confusion(_predicted(spark, sf_dir))


_REPORT = """, k AS (SELECT unnest([0, 1]) AS class), e AS (
  SELECT class, sum(CASE WHEN truth = class THEN n ELSE 0 END) AS support, sum(CASE WHEN predicted = class THEN n ELSE 0 END) AS p, sum(CASE WHEN truth = class AND predicted = class THEN n ELSE 0 END) AS ok FROM cm, k GROUP BY 1)"""


@query(with_sql("scores") + _CM + _REPORT + """
SELECT class::BIGINT AS class, round(ok / p, 6) + 0.0 AS precision, round(ok / support, 6) + 0.0 AS recall, round(2 * ok / (p + support), 6) + 0.0 AS f1, support::BIGINT AS support FROM e""")
def metric_class_report(spark, sf_dir):
    out = M.class_report(M.confusion(_predicted(spark, sf_dir)))
    return out.select("class", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(with_sql("scores") + _CM + _REPORT + " SELECT round(avg(2 * ok / (p + support)), 6) + 0.0 AS macro_f1 FROM e")
def metric_macro_f1(spark, sf_dir):
    return M.macro_f1(M.confusion(_predicted(spark, sf_dir))).select(R(F.col("macro_f1")).alias("macro_f1"))


_CURVE = """, d AS (SELECT lgbm AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY 1),
cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d)"""


@query(with_sql("scores") + _CURVE + " SELECT score, round(fp / n, 6) + 0.0 AS fpr, round(tp / p, 6) + 0.0 AS tpr FROM cv")
def metric_roc(spark, sf_dir):
    return M.roc_curve(score_rows(spark, sf_dir), "lgbm").select("score", R(F.col("fpr")).alias("fpr"), R(F.col("tpr")).alias("tpr"))


@query(with_sql("scores") + _CURVE + " SELECT round(sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)), 6) + 0.0 AS auc FROM cv")
def metric_auc(spark, sf_dir):
    return M.roc_auc(score_rows(spark, sf_dir), "lgbm").select(R(F.col("auc")).alias("auc"))


@query(with_sql("scores") + _CURVE + " SELECT score, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / p, 6) + 0.0 AS recall FROM cv")
def metric_pr(spark, sf_dir):
    return M.pr_curve(score_rows(spark, sf_dir), "lgbm").select("score", R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"))


@query(with_sql("scores") + _CURVE + " SELECT round(sum(pos / p * tp / (tp + fp)), 6) + 0.0 AS ap FROM cv")
def metric_average_precision(spark, sf_dir):
    return M.average_precision(score_rows(spark, sf_dir), "lgbm").select(R(F.col("ap")).alias("ap"))


@query(with_sql("scores") + " SELECT least(CAST(floor(rf * 10) AS BIGINT), 9) AS bin, round(avg(rf), 6) + 0.0 AS pred, round(avg(label), 6) + 0.0 AS \"true\", count(*) AS n FROM scores GROUP BY 1")
def metric_calibration(spark, sf_dir):
    return M.calibration(score_rows(spark, sf_dir), "rf").select("bin", R(F.col("pred")).alias("pred"), R(F.col("true")).alias("true"), "n")


@query(with_sql("scores") + """, t AS (SELECT grp, label AS t, CAST(lgbm >= 0.5 AS BIGINT) AS y FROM scores),
k AS (SELECT grp, count(*) AS n, sum(t * y) AS tp, sum((1 - t) * y) AS fp, sum(t * (1 - y)) AS fn, sum((1 - t) * (1 - y)) AS tn FROM t GROUP BY 1)
SELECT grp, n, round((CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2.0 * tp / (2.0 * tp + fp + fn) END + 2.0 * tn / (2.0 * tn + fp + fn)) / CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2 END, 6) + 0.0 AS macro_f1 FROM k WHERE n >= 10""")
def metric_grouped_f1(spark, sf_dir):
    return M.grouped_f1(_predicted(spark, sf_dir), "grp").select("grp", "n", R(F.col("macro_f1")).alias("macro_f1"))


@query(with_sql("scores") + """ SELECT sum(CAST(lgbm > 0.5 AS BIGINT))::BIGINT AS by_argmax, sum(CAST(lgbm >= 0.5 AS BIGINT))::BIGINT AS by_threshold, sum(CAST(round(1 - lgbm, 4) < lgbm AS BIGINT))::BIGINT AS by_pair FROM scores""")
def label_tie_rules(spark, sf_dir):
    p = F.col("lgbm")
    return score_rows(spark, sf_dir).agg(F.sum(P.argmax_label(F.lit(0.5), p)).alias("by_argmax"), F.sum(P.threshold_label(p)).alias("by_threshold"), F.sum(P.argmax_label(F.round(1 - p, 4), p)).alias("by_pair"))


@query(with_sql("scores") + " SELECT row_id, round((rf * 0.2 + lgbm * 1.0 + xgb * 0.8) / 2.0, 5) + 0.0 AS p1 FROM scores")
def blend_scores(spark, sf_dir):
    return B.blend(score_rows(spark, sf_dir), {"rf": 0.2, "lgbm": 1.0, "xgb": 0.8}).select("row_id", R(F.col("p1"), 5).alias("p1"))


_SURFACE = """, g AS (SELECT a.range AS w_rf, b.range AS w_lgbm, 10 - a.range - b.range AS w_xgb FROM range(11) a, range(11) b WHERE a.range + b.range <= 10),
h AS (SELECT w_rf, w_lgbm, w_xgb, label AS t, CAST(round(rf * w_rf + lgbm * w_lgbm + xgb * w_xgb, 9) > 5 AS BIGINT) AS y FROM scores, g),
k AS (SELECT w_rf, w_lgbm, w_xgb, sum(t * y) AS tp, sum((1 - t) * y) AS fp, sum(t * (1 - y)) AS fn, sum((1 - t) * (1 - y)) AS tn FROM h GROUP BY 1, 2, 3),
s AS (SELECT w_rf, w_lgbm, w_xgb, (2.0 * tp / (2.0 * tp + fp + fn) + 2.0 * tn / (2.0 * tn + fp + fn)) / 2 AS macro_f1 FROM k)"""


@query(with_sql("scores") + _SURFACE + " SELECT w_rf, w_lgbm, w_xgb, round(macro_f1, 6) + 0.0 AS macro_f1 FROM s")
def blend_surface(spark, sf_dir):
    s = B.weight_surface(score_rows(spark, sf_dir), MODELS)
    return s.select("w_rf", "w_lgbm", "w_xgb", R(F.col("macro_f1")).alias("macro_f1"))


@query(with_sql("scores") + _SURFACE + " SELECT w_rf, w_lgbm, w_xgb, round(macro_f1, 6) + 0.0 AS macro_f1 FROM s ORDER BY round(macro_f1, 9) DESC, w_rf, w_lgbm, w_xgb LIMIT 1")
def blend_best(spark, sf_dir):
    s = B.best_weights(B.weight_surface(score_rows(spark, sf_dir), MODELS), MODELS)
    return s.select("w_rf", "w_lgbm", "w_xgb", R(F.col("macro_f1")).alias("macro_f1"))


_IMPORTANCE = [("rf", "od_R", 3.0), ("rf", "entropy", 1.0), ("lgbm", "od_R", 10.0), ("lgbm", "entropy", 30.0), ("xgb", "od_R", 0.0), ("xgb", "entropy", 0.0)]


@query("WITH i(model, feature, v) AS (VALUES " + ", ".join(f"('{m}', '{f}', {v}::DOUBLE)" for m, f, v in _IMPORTANCE) + """), n AS (SELECT model, feature, CASE WHEN sum(v) OVER (PARTITION BY model) = 0 THEN v ELSE v / sum(v) OVER (PARTITION BY model) END AS v FROM i)
SELECT feature, round(avg(v), 6) + 0.0 AS mean_importance, row_number() OVER (ORDER BY avg(v) DESC, feature) AS rank FROM n GROUP BY 1""")
def importance_top(spark, sf_dir):
    from ..operators.models import normalised_importance, top_importances

    rows = spark.createDataFrame(_IMPORTANCE, "model string, feature string, v double")
    return top_importances(normalised_importance(rows), 10).select("feature", R(F.col("mean_importance")).alias("mean_importance"), F.col("rank").cast("long").alias("rank"))


@query(with_sql("gray") + """, i AS (SELECT image_id, avg(-ln(greatest(1, least(255, v)) / 255.0)) AS od, avg(CAST(v < 245 AS INT)) AS tissue FROM gray GROUP BY 1),
m AS (SELECT quantile_cont(od, 0.5) AS med FROM i)
SELECT image_id, round(od, 6) + 0.0 AS od, rk AS rank FROM (SELECT image_id, od, row_number() OVER (ORDER BY round(abs(od - med), 9), image_id) AS rk FROM i, m WHERE tissue >= 0.1) WHERE rk <= 30""")
def stain_reference_ranking(spark, sf_dir):
    from ..operators.stain import reference_ranking

    px = gray_pixels(spark, sf_dir).select("image_id", F.col("v").alias("red"), F.col("v").alias("green"), F.col("v").alias("blue"))
    return reference_ranking(px, 30).select("image_id", R(F.col("od")).alias("od"), F.col("rank").cast("long").alias("rank"))


_OD3 = ", od AS (SELECT image_id, " + ", ".join(f"-ln(greatest(1, least(255, {c})) / 255.0) AS {n}" for c, n in (("red", "x"), ("green", "y"), ("blue", "z"))) + " FROM rgb), tis AS (SELECT * FROM od WHERE greatest(x, y, z) > 0.15)"


@query(with_sql("rgb") + _OD3 + """ SELECT image_id, count(*) AS n, round(var_samp(x), 6) + 0.0 AS c00, round(covar_samp(x, y), 6) + 0.0 AS c01, round(covar_samp(x, z), 6) + 0.0 AS c02,
  round(var_samp(y), 6) + 0.0 AS c11, round(covar_samp(y, z), 6) + 0.0 AS c12, round(var_samp(z), 6) + 0.0 AS c22 FROM tis GROUP BY 1 HAVING count(*) >= 10""")
def stain_covariance(spark, sf_dir):
    from ..operators.stain import tissue_covariance

    out = tissue_covariance(rgb_pixels(spark, sf_dir))
    return out.select("image_id", "n", *(R(F.col(c)).alias(c) for c in ("c00", "c01", "c02", "c11", "c12", "c22")))


@query(with_sql("rgb") + """, l AS (SELECT image_id, r, c, red, green, blue, greatest(""" + ", ".join(f"-ln(greatest(0.000001, least(1, {c} / 255.0)))" for c in ("red", "green", "blue")) + """) > 0.15 AS t FROM rgb),
v AS (SELECT image_id, unnest([red, green, blue]) AS v FROM l WHERE t), p AS (SELECT image_id, quantile_cont(v, 0.95) AS q, count(*) // 3 AS n FROM v GROUP BY 1)
SELECT image_id, r, c, """ + ", ".join(f"CAST(CASE WHEN n > 10 AND q > 0 THEN floor(greatest(0, least(255, {c} * 255.0 / q))) ELSE {c} END AS BIGINT) AS {c}" for c in ("red", "green", "blue")) + " FROM l LEFT JOIN p USING (image_id)")
def stain_luminosity(spark, sf_dir):
    from ..operators.stain import standardise_luminosity

    return standardise_luminosity(rgb_pixels(spark, sf_dir))


@query()
def stain_normalised(spark, sf_dir):
    from ..operators.stain import StainNormaliser

    px = rgb_pixels(spark, sf_dir)
    return StainNormaliser.fit(px, candidates=30).transform(px)
