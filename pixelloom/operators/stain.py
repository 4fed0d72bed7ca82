"""Stain normalisation: per-image statistics are aggregations; one small eigenproblem per image; pixels are projections.

Pixel tables have image_id, red, green, blue (0-255) and any key columns. The per-image parameters are a row per image, joined to
the pixels by image.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P

CHANNELS = ("red", "green", "blue")


def standardise_luminosity(px: DataFrame) -> DataFrame:
    """Scale each image so that the 95th percentile of its tissue values is 255; images of 10 tissue pixels or fewer stay."""
    tissue = P.is_tissue(*(P.od_luminosity(F.col(c)) for c in CHANNELS))
    values = px.where(tissue).select("image_id", F.explode(F.array(*CHANNELS)).alias("v"))
    top = values.groupBy("image_id").agg(F.percentile("v", 0.95).alias("_q"), F.count("*").alias("_n"))
    use = (F.col("_n") > 30) & (F.col("_q") > 0)
    out = px.join(top, "image_id", "left")
    scaled = [F.when(use, P.to_byte(F.col(c) * 255.0 / F.col("_q"))).otherwise(F.col(c).cast("long")).alias(c) for c in CHANNELS]
    return out.select(*(c for c in px.columns if c not in CHANNELS), *scaled)


def _od(px: DataFrame) -> DataFrame:
    return px.select("*", *(P.od_normaliser(F.col(c)).alias(f"_od{k}") for k, c in enumerate(CHANNELS)))


def tissue_covariance(px: DataFrame, least: int = 10) -> DataFrame:
    """(image_id, n, means, c00 ... c22): the sample covariance of the tissue pixels' optical densities."""
    t = _od(px).where(P.is_tissue(*(F.col(f"_od{k}") for k in range(3))))
    cov = [(F.var_samp(f"_od{i}") if i == j else F.covar_samp(f"_od{i}", f"_od{j}")).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)]
    return t.groupBy("image_id").agg(F.count("*").alias("n"), *cov).where(F.col("n") >= least)


def _plane(batches):
    """The two leading eigenvectors of each image's covariance, first components positive."""
    for b in batches:
        c = {n: b.column(n).to_numpy() for n in b.schema.names if n[0] == "c"}
        m = np.stack([np.stack([c["c00"], c["c01"], c["c02"]], -1), np.stack([c["c01"], c["c11"], c["c12"]], -1), np.stack([c["c02"], c["c12"], c["c22"]], -1)], -2)
        _, v = np.linalg.eigh(m)
        first, second = v[:, :, 2], v[:, :, 1]
        first, second = (x * np.where(x[:, :1] < 0, -1.0, 1.0) for x in (first, second))
        yield pa.RecordBatch.from_arrays([b.column("image_id"), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (first, second) for k in range(3))], names=["image_id", *(f"_{s}{k}" for s in "ab" for k in range(3))])


def stain_matrix(px: DataFrame) -> DataFrame:
    """(image_id, h0-h2, e0-e2): unit stain vectors from the extreme angles in the plane of largest variance."""
    cov = tissue_covariance(px)
    plane = cov.select("image_id", *(f"c{i}{j}" for i in range(3) for j in range(i, 3))).mapInArrow(_plane, "image_id long, " + ", ".join(f"_{s}{k} double" for s in "ab" for k in range(3)))
    t = _od(px).where(P.is_tissue(*(F.col(f"_od{k}") for k in range(3)))).join(plane, "image_id")
    dot = lambda s: sum((F.col(f"_od{k}") * F.col(f"_{s}{k}") for k in range(3)), F.lit(0.0))
    angle = F.atan2(dot("b"), dot("a"))
    ends = t.withColumn("_t", angle).groupBy("image_id", *(f"_{s}{k}" for s in "ab" for k in range(3))).agg(F.percentile("_t", [0.01, 0.99]).alias("_q"))
    vector = lambda at, k: F.cos(F.col("_q")[at]) * F.col(f"_a{k}") + F.sin(F.col("_q")[at]) * F.col(f"_b{k}")
    swap = vector(0, 0) < vector(1, 0)
    size = lambda at: F.sqrt(sum((vector(at, k) * vector(at, k) for k in range(3)), F.lit(0.0)))
    unit = lambda at, k: vector(at, k) / size(at)
    return ends.select("image_id", *(F.when(swap, unit(1, k)).otherwise(unit(0, k)).alias(f"h{k}") for k in range(3)), *(F.when(swap, unit(0, k)).otherwise(unit(1, k)).alias(f"e{k}") for k in range(3)))


def concentrations(px: DataFrame, matrix: DataFrame) -> DataFrame:
    """px with non-negative stain amounts _ch and _ce: least squares by the normal equations of two stains."""
    j = _od(px).join(matrix, "image_id", "left")
    sum3 = lambda f: sum((f(k) for k in range(3)), F.lit(0.0))
    hh, ee, he = (sum3(lambda k, a=a, b=b: F.col(f"{a}{k}") * F.col(f"{b}{k}")) for a, b in (("h", "h"), ("e", "e"), ("h", "e")))
    ho, eo = (sum3(lambda k, a=a: F.col(f"{a}{k}") * F.col(f"_od{k}")) for a in "he")
    det = hh * ee - he * he
    zero = F.lit(0.0)
    return j.withColumn("_ch", F.greatest(zero, F.try_divide(ee * ho - he * eo, det))).withColumn("_ce", F.greatest(zero, F.try_divide(hh * eo - he * ho, det)))


def reference_ranking(px: DataFrame, first: int = 30, least_tissue: float = 0.1) -> DataFrame:
    """(image_id, od, rank): images by the distance of their mean optical density from the median; enough tissue, if any has."""
    od = sum((P.od_normaliser(F.col(c)) for c in CHANNELS), F.lit(0.0)) / 3
    dark = F.greatest(*((F.col(c) < 245).cast("int") for c in CHANNELS))
    images = px.groupBy("image_id").agg(F.avg(od).alias("od"), F.avg(dark).alias("tissue"))
    middle = images.agg(F.percentile("od", 0.5).alias("med"), F.max("tissue").alias("most"))
    near = images.join(F.broadcast(middle), F.lit(True)).where((F.col("tissue") >= least_tissue) | (F.col("most") < least_tissue))
    near = near.withColumn("away", F.round(F.abs(F.col("od") - F.col("med")), 9)).orderBy("away", "image_id").limit(first)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("away", "image_id"))).select("image_id", "od", "rank")


class StainNormaliser:
    """Fitted target: stain vectors and the 99th percentile of each stain's amount in a reference image."""

    def __init__(self, matrix: list[float], top: list[float], image_id: int):
        self.matrix, self.top, self.image_id = matrix, top, image_id

    @staticmethod
    def fit(px: DataFrame, candidates: int = 30) -> StainNormaliser:
        """The best-ranked candidate that has enough tissue becomes the reference; ValueError if none has."""
        order = {r["image_id"]: r["rank"] for r in reference_ranking(px, candidates).collect()}
        some = standardise_luminosity(px.where(F.col("image_id").isin(list(order))))
        matrix = stain_matrix(some).persist()
        amounts = concentrations(some, matrix).where("h0 IS NOT NULL").groupBy("image_id").agg(F.percentile("_ch", 0.99).alias("h"), F.percentile("_ce", 0.99).alias("e"))
        found = {r["image_id"]: r for r in matrix.join(amounts, "image_id").collect()}
        matrix.unpersist()
        for i in sorted(order, key=order.get):
            if i in found and all(np.isfinite(x) for x in found[i]):
                r = found[i]
                return StainNormaliser([r[f"{s}{k}"] for s in "he" for k in range(3)], [r["h"], r["e"]], i)
        raise ValueError("no candidate image has enough tissue")

    def transform(self, px: DataFrame) -> DataFrame:
        """Pixels in the reference's stains; images without a stain matrix keep their standardised values."""
        std = standardise_luminosity(px)
        c = concentrations(std, stain_matrix(std))
        top = c.where("h0 IS NOT NULL").groupBy("image_id").agg(F.percentile("_ch", 0.99).alias("_th"), F.percentile("_ce", 0.99).alias("_te"))
        j = c.join(top, "image_id", "left")
        h, e = (F.col(f"_c{s}") * (t / (F.col(f"_t{s}") + 1e-6)) for s, t in zip("he", self.top))
        out = [F.coalesce(P.od_to_byte(h * self.matrix[k] + e * self.matrix[3 + k]), F.col(n).cast("long")).alias(n) for k, n in enumerate(CHANNELS)]
        return j.select(*(n for n in px.columns if n not in CHANNELS), *out)

    def to_json(self) -> str:
        return json.dumps({"matrix": self.matrix, "top": self.top, "image_id": self.image_id})

    @staticmethod
    def from_json(text: str) -> StainNormaliser:
        return StainNormaliser(**json.loads(text))
