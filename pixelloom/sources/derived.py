"""Image-like and score-like tables derived from the shared test tables, by Spark and, as SQL text, by the oracle.

An embedding of 64 numbers is an 8x8 gray tile; three consecutive ones are the channels of a colour tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, v array<double>): one row per tile, row-major intensities 0-255."""
    level = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(127.5 + 255 * x.cast("double")).cast("double"))))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("label"), level.alias("v"))


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, r, c, v)"""
    px = gray_tiles(spark, sf_dir).select("image_id", "label", F.posexplode("v").alias("i", "v"))
    return px.select("image_id", "label", F.expr(f"i DIV {SIDE}").alias("r"), (F.col("i") % SIDE).cast("long").alias("c"), "v")


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, c, red, green, blue): one pivot per pixel of three gray tiles."""
    px = gray_pixels(spark, sf_dir).withColumn("k", F.expr("image_id DIV 3")).withColumn("ch", F.col("image_id") % 3)
    one = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("v")))
    out = px.groupBy(F.col("k").alias("image_id"), "r", "c").agg(one(0).alias("red"), one(1).alias("green"), one(2).alias("blue"))
    return out.where("red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL")


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, r, c, v, class_id, inst_id): nucleus pixels have inst_id 1-4 (the quadrant), others 0.

    A pixel belongs to a nucleus if it isn't darker than the tile's own 60th percentile.
    """
    tiles = gray_tiles(spark, sf_dir)
    # the exact interpolated percentile of 64 values, inside the row: no shuffle
    ranked = F.sort_array("v")
    at = 0.6 * (SIDE * SIDE - 1)
    low, part = int(at), at - int(at)
    q = F.get(ranked, F.lit(low)) + (F.get(ranked, F.lit(low + 1)) - F.get(ranked, F.lit(low))) * part
    px = tiles.withColumn("q", q).select("image_id", "label", "q", F.posexplode("v").alias("i", "v"))
    r, c = F.expr(f"i DIV {SIDE}"), (F.col("i") % SIDE).cast("long")
    quadrant = 1 + 2 * F.expr(f"i DIV {SIDE} DIV {SIDE // 2}") + F.expr(f"i % {SIDE} DIV {SIDE // 2}")
    return px.select("image_id", "label", r.alias("r"), c.alias("c"), "v", (F.col("label") % 5).alias("class_id"), F.when(F.col("v") >= F.col("q"), quadrant).otherwise(F.lit(0)).cast("long").alias("inst_id"))


FEATURES = ["f_quantity", "f_price", "f_discount", "f_tax", "f_unit", "f_net", "f_line", "f_days"]


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, f_*, label, grp): a dense numeric table with a binary label, from lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("f_quantity"), F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_discount"), F.col("l_tax").alias("f_tax"), (F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1.0))).alias("f_unit"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("f_net"), F.col("l_linenumber").cast("double").alias("f_line"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("f_days"),
        (F.col("l_returnflag") == "R").cast("long").alias("label"), F.col("l_linestatus").alias("grp"),
    )


def unit_hash(*cols):
    """A number in [0, 1) from the first eight hex digits of the MD5 of the joined columns: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / float(1 << 32)


MODELS = ("rf", "lgbm", "xgb")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, grp, rf, lgbm, xgb): pseudo-probabilities of class 1 that lean towards the label."""
    rows = feature_rows(spark, sf_dir).select("row_id", "label", "grp")
    lean = {"rf": 0.30, "lgbm": 0.40, "xgb": 0.36}
    p = lambda m: F.round((1 - lean[m]) * unit_hash(F.lit(m), F.col("row_id").cast("string")) + lean[m] * F.col("label"), 4)
    return rows.select("row_id", "label", "grp", *(p(m).alias(m) for m in MODELS))


_GRAY = """gray AS (
  SELECT vec_id AS image_id, CAST(label AS BIGINT) AS label, CAST((i - 1) // 8 AS BIGINT) AS r, CAST((i - 1) % 8 AS BIGINT) AS c,
         least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(127.5::DOUBLE + 255 * CAST(e AS DOUBLE)))) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""
_RGB = """rgb AS (
  SELECT image_id // 3 AS image_id, r, c, max(CASE WHEN image_id % 3 = 0 THEN v END) AS red, max(CASE WHEN image_id % 3 = 1 THEN v END) AS green,
         max(CASE WHEN image_id % 3 = 2 THEN v END) AS blue
  FROM gray GROUP BY 1, 2, 3 HAVING count(*) = 3
)"""
_MASK = """cut AS (SELECT image_id, quantile_cont(v, 0.6) AS q FROM gray GROUP BY 1),
mask AS (
  SELECT g.image_id, label, r, c, v, label % 5 AS class_id, CASE WHEN v >= q THEN 1 + 2 * (r // 4) + c // 4 ELSE 0 END AS inst_id
  FROM gray g JOIN cut USING (image_id)
)"""
_FEATURES = """feats AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity AS f_quantity, l_extendedprice AS f_price, l_discount AS f_discount, l_tax AS f_tax,
         l_extendedprice / greatest(l_quantity, 1.0::DOUBLE) AS f_unit, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS f_net,
         CAST(l_linenumber AS DOUBLE) AS f_line, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS f_days,
         CAST(l_returnflag = 'R' AS BIGINT) AS label, l_linestatus AS grp
  FROM lineitem
)"""


def unit_sql(*cols: str) -> str:
    joined = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


_SCORES = f"""scores AS (
  SELECT row_id, label, grp, round(0.7::DOUBLE * {unit_sql("'rf'", 'row_id')} + 0.3::DOUBLE * label, 4) AS rf,
         round(0.6::DOUBLE * {unit_sql("'lgbm'", 'row_id')} + 0.4::DOUBLE * label, 4) AS lgbm,
         round(0.64::DOUBLE * {unit_sql("'xgb'", 'row_id')} + 0.36::DOUBLE * label, 4) AS xgb
  FROM feats
)"""

_CTE = {"gray": ([], _GRAY), "rgb": (["gray"], _RGB), "mask": (["gray"], _MASK), "feats": ([], _FEATURES), "scores": (["feats"], _SCORES)}


def with_sql(*names: str) -> str:
    """WITH clause that defines the named tables; a statement, or further tables after a comma, can follow."""
    done: list[str] = []

    def add(name: str) -> None:
        for d in _CTE[name][0]:
            add(d)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(_CTE[n][1] for n in done)
