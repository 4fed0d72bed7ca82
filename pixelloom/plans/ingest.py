"""Registered queries: sources, sinks and streaming ingestion."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import artefacts as A
from ..sources import npy
from ..sources.derived import gray_pixels, read, with_sql
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    """A new folder that executors share: under spark.checkpoint.dir, or local where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/pixelloom-{name}-{uuid.uuid4().hex}"


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_events(spark, sf_dir):
    """All events through a file stream with a checkpoint, written once whatever is retried, then aggregated."""
    out = ingest.ingest_parquet(spark, f"{sf_dir}/events.parquet", _folder(spark, "events"), "event_id")
    return out.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@query(with_sql("gray") + " SELECT image_id % 3 + 1 AS fold, count(DISTINCT image_id) AS tiles, count(*) AS n, sum(v)::DOUBLE AS total FROM gray GROUP BY 1")
def fold_partitions(spark, sf_dir):
    """Pixels written by fold and read back: a fold is a folder, which a filter prunes."""
    path = _folder(spark, "folds")
    gray_pixels(spark, sf_dir).withColumn("fold", F.col("image_id") % 3 + 1).write.partitionBy("fold").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count_distinct("image_id").alias("tiles"), F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT vec_id AS row, CAST(e AS DOUBLE) AS first FROM (SELECT vec_id, embedding[1] AS e FROM embeddings) WHERE vec_id < 50")
def npy_round_trip(spark, sf_dir):
    """Every vector is written and read back; the statement asks for fifty of them."""
    return npy_round_trip_all(spark, sf_dir).where("row < 50")


@query("SELECT vec_id AS row, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def npy_round_trip_all(spark, sf_dir):
    """Every vector written into .npy files by the executors and read back by the binary reader."""
    path = _folder(spark, "npy")
    npy.write_npy_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return npy.read_npy_rows(spark, path).select(F.col("key").cast("long").alias("row"), F.get("values", F.lit(0)).alias("first"))


@query("SELECT 1::BIGINT AS rank, 0::BIGINT AS idx, 'od_R' AS name UNION ALL SELECT 2, 85, 'entropy'")
def feature_list_files(spark, sf_dir):
    path = _folder(spark, "features")
    A.save_feature_list(spark, path, "mrmr", [0, 85], ["od_R", "entropy"])
    return A.load_feature_list(spark, path, "mrmr", 2)
