"""The flagship plan: tiles to labelled pixels to a seeded boundary sample to scaled statistics per label and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import scaling as C
from ..operators import stencil as N
from ..sources.derived import SIDE, gray_tiles, mask_pixels

FEATURES = ["od", "edge_dist", "box_mean", "box_std"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, feature, n, mean, std, outliers) of sampled pixels."""
    labels = L.three_class_labels(mask_pixels(spark, sf_dir), SIDE, SIDE, radius=1)
    drawn = S.boundary_sample(labels.withColumn("label", (F.col("label") > 0).cast("long")), per_class=10, distance=2, width=SIDE)
    px = N.tile_features(gray_tiles(spark, sf_dir), SIDE, SIDE, {"box_mean": N.box_mean(2), "box_std": N.box_std(2)})
    px = px.withColumn("pixel_idx", F.col("r") * SIDE + F.col("c")).withColumn("od", P.od_feature(F.col("v"))).withColumn("edge_dist", P.edge_distance(F.col("r"), F.col("c"), SIDE, SIDE))
    rows = drawn.select("image_id", "pixel_idx", "label").join(px.drop("label"), ["image_id", "pixel_idx"])
    kinds = {"od": "standard", "edge_dist": "pass", "box_mean": "robust", "box_std": "robust_wide"}
    scaled = C.fit(rows.select(*FEATURES), kinds).transform(rows.select("label", *FEATURES))
    cells = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("z")) for f in FEATURES)))
    return scaled.select("label", cells).groupBy("label", "feature").agg(
        F.count("*").alias("n"), P.rounded(F.avg("z")).alias("mean"), P.rounded(F.stddev_pop("z")).alias("std"), P.rounded(F.avg((F.abs("z") > 3).cast("int"))).alias("outliers")
    )
