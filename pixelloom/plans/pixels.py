"""Registered queries: colour, labels, regions and pixel predicates over derived tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import labels as L
from ..sources.derived import SIDE, gray_pixels, mask_pixels, rgb_pixels, with_sql

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


_LIN = "(CASE WHEN {0} / 255.0 > 0.04045 THEN pow(({0} / 255.0 + 0.055) / 1.055, 2.4) ELSE {0} / 255.0 / 12.92 END)"
_F = "(CASE WHEN {0} > 0.008856 THEN pow({0}, 1.0::DOUBLE / 3) ELSE 7.787 * {0} + 16.0::DOUBLE / 116 END)"


@query(with_sql("mask") + """
SELECT CAST(inst_id > 0 AS BIGINT) AS label, count(*) AS n, round(avg(-ln(v / 255.0 + 0.000001)), 6) + 0.0 AS mean_od FROM mask GROUP BY 1""")
def px_od_by_label(spark, sf_dir):
    px = mask_pixels(spark, sf_dir)
    return px.groupBy((F.col("inst_id") > 0).cast("long").alias("label")).agg(F.count("*").alias("n"), R(F.avg(P.od_feature(F.col("v")))).alias("mean_od"))


@query(with_sql("rgb") + """
SELECT image_id, r, c, round(-ln(greatest(1, least(255, red)) / 255.0), 6) + 0.0 AS od_norm, round(-ln(red / 255.0 + 0.000001), 6) + 0.0 AS od_feat,
       round(-ln(greatest(0.000001, least(1, red / 255.0))), 6) + 0.0 AS od_lum,
       CAST(floor(greatest(0, least(255, 255.0 * (greatest(1, least(255, red)) / 255.0) + 0.25))) AS BIGINT) AS back
FROM rgb""")
def px_optical_density(spark, sf_dir):
    px, red = rgb_pixels(spark, sf_dir), F.col("red")
    # a quarter keeps the truncation clear of rounding errors in exp(-ln x)
    back = P.to_byte(255.0 * F.exp(-P.od_normaliser(red)) + 0.25)
    return px.select("image_id", "r", "c", R(P.od_normaliser(red)).alias("od_norm"), R(P.od_feature(red)).alias("od_feat"), R(P.od_luminosity(red)).alias("od_lum"), back.alias("back"))


@query(with_sql("rgb") + f""", lin AS (
  SELECT image_id, r, c, {_LIN.format('red')} AS a, {_LIN.format('green')} AS b, {_LIN.format('blue')} AS d FROM rgb
), xyz AS (
  SELECT image_id, r, c, (a * 0.412453 + b * 0.357580 + d * 0.180423) / 0.95047 AS x, (a * 0.212671 + b * 0.715160 + d * 0.072169) / 1.0 AS y,
         (a * 0.019334 + b * 0.119193 + d * 0.950227) / 1.08883 AS z FROM lin
), f AS (SELECT image_id, r, c, {_F.format('x')} AS x, {_F.format('y')} AS y, {_F.format('z')} AS z FROM xyz)
SELECT image_id, r, c, round(116.0 * y - 16.0, 4) + 0.0 AS l, round(500.0 * (x - y), 4) + 0.0 AS a, round(200.0 * (y - z), 4) + 0.0 AS b FROM f""")
def color_lab(spark, sf_dir):
    l, a, b = P.lab(F.col("red"), F.col("green"), F.col("blue"))
    return rgb_pixels(spark, sf_dir).select("image_id", "r", "c", R(l, 4).alias("l"), R(a, 4).alias("a"), R(b, 4).alias("b"))


@query(with_sql("rgb") + """, u AS (
  SELECT image_id, r, c, red / 255.0 AS x, green / 255.0 AS y, blue / 255.0 AS z FROM rgb
), m AS (SELECT *, greatest(x, y, z) AS v, greatest(x, y, z) - least(x, y, z) AS d FROM u),
h AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN x = v THEN (y - z) / d / 6.0 WHEN y = v THEN (2.0 + (z - x) / d) / 6.0 ELSE (4.0 + (x - y) / d) / 6.0 END AS t FROM m)
SELECT image_id, r, c, round(t - floor(t), 6) + 0.0 AS h, round(CASE WHEN d = 0 THEN 0.0 ELSE d / v END, 6) + 0.0 AS s, round(v, 6) + 0.0 AS v FROM h""")
def color_hsv(spark, sf_dir):
    h, s, v = P.hsv(F.col("red"), F.col("green"), F.col("blue"))
    return rgb_pixels(spark, sf_dir).select("image_id", "r", "c", R(h).alias("h"), R(s).alias("s"), R(v).alias("v"))


_LOGS = ", ".join(f"ln(greatest({c} / 255.0, 0.000001)) / ln(0.000001::DOUBLE) AS {n}" for c, n in (("red", "x"), ("green", "y"), ("blue", "z")))


@query(with_sql("rgb") + f""", u AS (SELECT image_id, r, c, {_LOGS} FROM rgb)
SELECT image_id, r, c, round(greatest(x * 0.65 + y * 0.07 + z * 0.27, 0), 6) + 0.0 AS h, round(greatest(x * 0.70 + y * 0.99 + z * 0.57, 0), 6) + 0.0 AS e,
       round(greatest(x * 0.29 + y * 0.11 + z * 0.78, 0), 6) + 0.0 AS d FROM u""")
def color_hed(spark, sf_dir):
    h, e, d = P.hed(F.col("red"), F.col("green"), F.col("blue"))
    return rgb_pixels(spark, sf_dir).select("image_id", "r", "c", R(h).alias("h"), R(e).alias("e"), R(d).alias("d"))


@query(with_sql("rgb") + """
SELECT image_id, count(*) AS n, sum(CAST(greatest(-ln(greatest(1, least(255, red)) / 255.0), -ln(greatest(1, least(255, green)) / 255.0), -ln(greatest(1, least(255, blue)) / 255.0)) > 0.15 AS BIGINT))::BIGINT AS tissue,
       round(avg(CAST(red < 245 OR green < 245 OR blue < 245 AS BIGINT)), 6) + 0.0 AS quality
FROM rgb GROUP BY 1 HAVING avg(CAST(red < 245 OR green < 245 OR blue < 245 AS BIGINT)) >= 0.10""")
def px_tissue(spark, sf_dir):
    od = [P.od_normaliser(F.col(c)) for c in ("red", "green", "blue")]
    dark = ((F.col("red") < 245) | (F.col("green") < 245) | (F.col("blue") < 245)).cast("long")
    out = rgb_pixels(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(P.is_tissue(*od).cast("long")).alias("tissue"), R(F.avg(dark)).alias("quality"))
    return out.where("quality >= 0.10")


@query(with_sql("gray") + """
SELECT image_id, r, c, round(least(least(r, 7 - r) / 8.0, least(c, 7 - c) / 8.0), 6) + 0.0 AS edge_dist, CAST(floor(v / 8) AS BIGINT) AS level,
       round(CASE WHEN v = 0 THEN 0.0 ELSE 255.0 / v END, 6) + 0.0 AS cleaned, CASE WHEN v = 0 THEN 1 ELSE 0 END AS was_infinite
FROM gray""")
def px_edge_quantise_clean(spark, sf_dir):
    v = F.col("v")
    ratio = F.when(v == 0, float("inf")).otherwise(255.0 / F.greatest(v, F.lit(1e-300)))
    return gray_pixels(spark, sf_dir).select(
        "image_id", "r", "c", R(P.edge_distance(F.col("r"), F.col("c"), SIDE, SIDE)).alias("edge_dist"), P.gray_level(v).alias("level"),
        R(P.zeroed(ratio)).alias("cleaned"), (P.bounded(ratio) >= P.FLOAT_MAX).cast("int").alias("was_infinite"),
    )


@query(with_sql("mask") + """
SELECT image_id, r, c, CAST(inst_id > 0 AND class_id < 5 AS BIGINT) AS label FROM mask""")
def label_binary(spark, sf_dir):
    return L.binary_labels(mask_pixels(spark, sf_dir))


_ERODED = """, own AS (SELECT * FROM mask WHERE inst_id > 0),
offsets AS (SELECT * FROM (VALUES {0}) t(dr, dc)),
eroded AS (
  SELECT o.image_id, o.r, o.c FROM own o JOIN offsets k ON o.r + dr BETWEEN 0 AND 7 AND o.c + dc BETWEEN 0 AND 7
  LEFT JOIN own n ON n.image_id = o.image_id AND n.class_id = o.class_id AND n.inst_id = o.inst_id AND n.r = o.r + dr AND n.c = o.c + dc
  GROUP BY 1, 2, 3 HAVING count(*) = count(n.r)
)"""


def _disk(radius: int) -> str:
    return ", ".join(f"({a}, {b})" for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius)


@query(with_sql("mask") + _ERODED.format(_disk(1)) + """
SELECT m.image_id, m.r, m.c, CASE WHEN e.r IS NOT NULL THEN 1 WHEN inst_id > 0 THEN 2 ELSE 0 END::BIGINT AS label
FROM mask m LEFT JOIN eroded e USING (image_id, r, c)""")
def label_three_class(spark, sf_dir):
    return L.three_class_labels(mask_pixels(spark, sf_dir), SIDE, SIDE, radius=1)


@query(with_sql("mask") + """
SELECT image_id, class_id, inst_id, count(*) AS area, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1,
       CASE class_id WHEN 0 THEN 'neoplastic' WHEN 1 THEN 'inflammatory' WHEN 2 THEN 'connective' WHEN 3 THEN 'dead' ELSE 'epithelial' END AS class_name
FROM mask WHERE inst_id > 0 AND class_id < 5 GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def region_instances(spark, sf_dir):
    return L.instances(mask_pixels(spark, sf_dir), least_area=5)


@query(with_sql("mask") + _ERODED.format(_disk(1)) + """, lab AS (
  SELECT m.image_id, CASE WHEN e.r IS NOT NULL THEN 1 WHEN inst_id > 0 THEN 2 ELSE 0 END AS label FROM mask m LEFT JOIN eroded e USING (image_id, r, c)
) SELECT image_id, round(avg(CAST(label = 0 AS INT)), 6) + 0.0 AS background, round(avg(CAST(label = 1 AS INT)), 6) + 0.0 AS interior,
         round(avg(CAST(label = 2 AS INT)), 6) + 0.0 AS boundary FROM lab GROUP BY 1""")
def label_fractions(spark, sf_dir):
    lab = L.three_class_labels(mask_pixels(spark, sf_dir), SIDE, SIDE, radius=1)
    share = lambda k: R(F.avg((F.col("label") == k).cast("int")))
    return lab.groupBy("image_id").agg(share(0).alias("background"), share(1).alias("interior"), share(2).alias("boundary"))


@query("\nUNION ALL ".join(
    f"SELECT {k}::BIGINT AS radius, * FROM (" + with_sql("mask") + _ERODED.format(_disk(k)) + " SELECT count(*) AS interior FROM eroded)" for k in (1, 2, 3)))
def label_erosion_sweep(spark, sf_dir):
    px = mask_pixels(spark, sf_dir)
    parts = [L.eroded(px, SIDE, SIDE, k).agg(F.count("*").alias("interior")).select(F.lit(k).cast("long").alias("radius"), "interior") for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_sql("mask") + """
SELECT class_id, round(avg(CAST(inst_id > 0 AS INT)), 6) + 0.0 AS nonzero, count(*) AS n FROM mask GROUP BY 1""")
def mask_channel_fractions(spark, sf_dir):
    return mask_pixels(spark, sf_dir).groupBy("class_id").agg(R(F.avg((F.col("inst_id") > 0).cast("int"))).alias("nonzero"), F.count("*").alias("n"))


@query(with_sql("mask", "rgb") + f""", u AS (SELECT image_id, r, c, {_LOGS} FROM rgb)
SELECT CAST(m.inst_id > 0 AS BIGINT) AS label, count(*) AS n, round(avg(greatest(x * 0.65 + y * 0.07 + z * 0.27, 0)), 6) + 0.0 AS mean_h
FROM u JOIN mask m ON m.image_id = 3 * u.image_id AND m.r = u.r AND m.c = u.c GROUP BY 1""")
def stain_contrast(spark, sf_dir):
    h, _, _ = P.hed(F.col("red"), F.col("green"), F.col("blue"))
    px = rgb_pixels(spark, sf_dir).select((F.col("image_id") * 3).alias("image_id"), "r", "c", h.alias("h"))
    return px.join(mask_pixels(spark, sf_dir), ["image_id", "r", "c"]).groupBy((F.col("inst_id") > 0).cast("long").alias("label")).agg(F.count("*").alias("n"), R(F.avg("h")).alias("mean_h"))


@query(with_sql("mask") + """, ring AS (
  SELECT DISTINCT n.image_id, n.inst_id, m.r, m.c, m.v FROM mask n JOIN mask m ON m.image_id = n.image_id AND n.inst_id > 0 AND m.inst_id <> n.inst_id
    AND (m.r - n.r) * (m.r - n.r) + (m.c - n.c) * (m.c - n.c) <= 4
) SELECT image_id, inst_id, count(*) AS n, round(avg(v), 6) + 0.0 AS mean_v FROM ring GROUP BY 1, 2""")
def region_context_ring(spark, sf_dir):
    return L.context_ring(mask_pixels(spark, sf_dir), radius=2).groupBy("image_id", "inst_id").agg(F.count("*").alias("n"), R(F.avg("v")).alias("mean_v"))


@query(with_sql("mask") + """, x AS (SELECT * FROM mask WHERE inst_id > 0)
SELECT image_id, class_id, inst_id, count(*) AS area, round(avg(r), 6) + 0.0 AS centre_r, round(avg(c), 6) + 0.0 AS centre_c, round(var_pop(r), 6) + 0.0 AS var_r, round(var_pop(c), 6) + 0.0 AS var_c,
       round(covar_pop(r, c), 6) + 0.0 AS cov_rc, round(avg(v), 6) + 0.0 AS mean_v, round(quantile_cont(v, 0.5), 6) + 0.0 AS median_v, min(v) AS min_v, max(v) AS max_v,
       round(count(*)::DOUBLE / ((max(r) - min(r) + 1) * (max(c) - min(c) + 1)), 6) + 0.0 AS extent FROM x GROUP BY 1, 2, 3""")
def region_features(spark, sf_dir):
    return L.region_features(mask_pixels(spark, sf_dir).where("inst_id > 0"))


@query(with_sql("mask") + """, p AS (SELECT image_id, label AS tissue, CAST(inst_id > 0 AS BIGINT) AS t, CAST(v >= 128 AS BIGINT) AS y FROM mask),
k AS (SELECT tissue, sum(t * y) AS tp, sum((1 - t) * y) AS fp, sum(t * (1 - y)) AS fn FROM p GROUP BY 1)
SELECT tissue, round(2.0 * tp / (2.0 * tp + fp + fn), 6) + 0.0 AS dice, round(tp::DOUBLE / (tp + fp + fn), 6) + 0.0 AS iou FROM k""")
def segmentation_by_tissue(spark, sf_dir):
    px = mask_pixels(spark, sf_dir).select(F.col("label").alias("tissue"), (F.col("inst_id") > 0).cast("long").alias("t"), (F.col("v") >= 128).cast("long").alias("y"))
    tp, fp, fn = F.sum(F.col("t") * F.col("y")), F.sum((1 - F.col("t")) * F.col("y")), F.sum(F.col("t") * (1 - F.col("y")))
    return px.groupBy("tissue").agg(R(2.0 * tp / (2.0 * tp + fp + fn)).alias("dice"), R(tp / (tp + fp + fn)).alias("iou"))


@query(with_sql("gray") + """
, bright AS (SELECT image_id, r, c FROM gray WHERE v >= 150),
reach AS (
  WITH RECURSIVE w(image_id, r, c, r0, c0) AS (
    SELECT image_id, r, c, r, c FROM bright
    UNION SELECT w.image_id, b.r, b.c, w.r0, w.c0 FROM w JOIN bright b ON b.image_id = w.image_id AND abs(b.r - w.r) + abs(b.c - w.c) = 1
  ) SELECT image_id, r, c, min(r0 * 8 + c0) AS root FROM w GROUP BY 1, 2, 3
)
SELECT image_id, root, count(*) AS area FROM reach GROUP BY 1, 2 HAVING count(*) >= 3""")
def region_connected(spark, sf_dir):
    px = gray_pixels(spark, sf_dir).where("v >= 150")
    return L.connected_regions(px, SIDE).groupBy("image_id", "root").agg(F.count("*").alias("area")).where("area >= 3")
