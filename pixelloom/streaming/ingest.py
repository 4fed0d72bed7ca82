"""Incremental ingestion: a file stream with a checkpoint; each micro-batch replaces its own folder, so a replayed batch changes
nothing. Batch and stream give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_stream(stream: DataFrame, path: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream until all that is there is taken in; `step` is applied to each micro-batch. Gives the table so far."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch=*")


def latest(table: DataFrame, key: str) -> DataFrame:
    """One row of each key of an ingested table: that of the last micro-batch."""
    return table.groupBy(key).agg(F.max_by(F.struct(*(c for c in table.columns if c != key)), "batch").alias("_row")).select(key, "_row.*").select(*table.columns)


def ingest_parquet(spark: SparkSession, source: str, path: str, key: str, per_batch: int = 64) -> DataFrame:
    """Take in the Parquet files of a folder (or one file), at most per_batch files in a micro-batch; resumes from path's checkpoint.

    Of rows with one key in a micro-batch one is kept; a key that comes again in a later one is kept by `latest`, not here."""
    schema = spark.read.parquet(source).schema
    # a single file is streamed from its folder, by name
    folder, _, name = source.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    single = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile()
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(source)
    return ingest_stream(stream, path, lambda df: df.dropDuplicates([key]))
