"""Label maps, per-instance morphology and regions over sparse pixel tables (image_id, r, c, ...).

A pixel is a row, so a neighbourhood test is an equi-join on shifted coordinates: it is dealt out by image, row and column, and
no task needs a whole image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import rounded

#: The names of the nucleus classes in channel order.
CLASS_NAMES = ["neoplastic", "inflammatory", "connective", "dead", "epithelial"]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def shifted(px: DataFrame, offsets: list[tuple[int, int]], r: str = "nr", c: str = "nc") -> DataFrame:
    """px once for each offset, with the shifted coordinates; the offsets are a constant array."""
    at = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))
    return px.withColumn("_o", F.explode(at)).withColumn(r, F.col("r") + F.col("_o.dr")).withColumn(c, F.col("c") + F.col("_o.dc")).drop("_o")


def binary_labels(mask: DataFrame) -> DataFrame:
    """1 where any of the first five channels has an instance."""
    return mask.select("image_id", "r", "c", ((F.col("inst_id") > 0) & (F.col("class_id") < 5)).cast("long").alias("label"))


def eroded(mask: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """Pixels whose whole disk, as far as it lies inside the image, belongs to their own instance: instances that touch keep
    their borders.

    Each instance pixel votes for the pixels that it is a neighbour of; a pixel stays if it has as many votes as its disk has
    places in the image. One aggregation, no self-join.
    """
    own = mask.where((F.col("inst_id") > 0) & (F.col("class_id") < 5)).select("image_id", "class_id", "inst_id", "r", "c")
    votes = shifted(own, disk(radius)).groupBy("image_id", "class_id", "inst_id", "nr", "nc").agg(
        F.count("*").alias("votes"), F.max(((F.col("r") == F.col("nr")) & (F.col("c") == F.col("nc"))).cast("int")).alias("own")
    )
    need = sum((F.when(F.col("nr").between(-a, height - 1 - a) & F.col("nc").between(-b, width - 1 - b), 1).otherwise(0) for a, b in disk(radius)), F.lit(0))
    return votes.where((F.col("own") == 1) & (F.col("votes") == need)).select("image_id", F.col("nr").alias("r"), F.col("nc").alias("c"))


def three_class_labels(mask: DataFrame, height: int, width: int, radius: int = 2) -> DataFrame:
    """0 background, 1 interior (the union of the eroded instances), 2 boundary; interior wins."""
    inside = eroded(mask, height, width, radius).distinct().withColumn("inside", F.lit(1))
    nucleus = mask.groupBy("image_id", "r", "c").agg(F.max(((F.col("inst_id") > 0) & (F.col("class_id") < 5)).cast("int")).alias("nucleus"))
    label = F.when(F.col("inside") == 1, 1).when(F.col("nucleus") == 1, 2).otherwise(0).cast("long")
    return nucleus.join(inside, ["image_id", "r", "c"], "left").select("image_id", "r", "c", label.alias("label"))


def instances(mask: DataFrame, least_area: int = 10) -> DataFrame:
    """One row per instance: area, half-open bounding box and class name; smaller ones are dropped."""
    names = F.array(*map(F.lit, CLASS_NAMES))
    return (
        mask.where((F.col("inst_id") > 0) & (F.col("class_id") < 5)).groupBy("image_id", "class_id", "inst_id")
        .agg(F.count("*").alias("area"), F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"))
        .where(F.col("area") >= least_area).withColumn("class_name", F.get(names, F.col("class_id").cast("int")))
    )


def context_ring(mask: DataFrame, radius: int = 5) -> DataFrame:
    """(image_id, inst_id, r, c, v): pixels outside an instance within the radius of it."""
    near = [(a, b) for a, b in disk(radius) if (a, b) != (0, 0)]
    around = shifted(mask.where("inst_id > 0").select("image_id", "inst_id", "r", "c"), near).select("image_id", F.col("inst_id").alias("of"), F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
    return around.join(mask, ["image_id", "r", "c"]).where("inst_id != of").select("image_id", F.col("of").alias("inst_id"), "r", "c", "v")


def region_features(px: DataFrame) -> DataFrame:
    """Moments, intensity statistics and extent of each region from one aggregation."""
    box = (F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)
    return px.groupBy("image_id", "class_id", "inst_id").agg(
        F.count("*").alias("area"), rounded(F.avg("r")).alias("centre_r"), rounded(F.avg("c")).alias("centre_c"), rounded(F.var_pop("r")).alias("var_r"),
        rounded(F.var_pop("c")).alias("var_c"), rounded(F.covar_pop("r", "c")).alias("cov_rc"), rounded(F.avg("v")).alias("mean_v"),
        rounded(F.percentile("v", 0.5)).alias("median_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), rounded(F.count("*") / box).alias("extent"),
    )


def connected_regions(px: DataFrame, width: int) -> DataFrame:
    """(image_id, r, c, root): four-connected components within each image; root is the least flat index.

    An image is a bounded group (its pixels), so it is labelled in one grouped Arrow call.
    """

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(n).to_numpy() for n in ("r", "c"))
        flat = r * width + c
        parent = {int(i): int(i) for i in flat}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, col in zip(flat.tolist(), c.tolist()):
            for j in ((i - 1) if col else None, i - width):
                if j in parent:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        roots = np.array([find(int(i)) for i in flat], np.int64)
        return pa.table({"image_id": table.column("image_id"), "r": table.column("r"), "c": table.column("c"), "root": pa.array(roots)})

    return px.select("image_id", "r", "c").groupBy("image_id").applyInArrow(run, "image_id long, r long, c long, root long")
