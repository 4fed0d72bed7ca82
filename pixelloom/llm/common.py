"""Shared helpers of the training-data operators: inputs, stored intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, the only case folding that the word-based operators apply.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same folding for bytes.translate.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col="text"):
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def fold_case(col):
    return F.translate(col, UPPER, LOWER)


def let(name: str, value: str, body: str) -> str:
    """A SQL expression: body with name bound to value, which is computed once a row. An expression that the body of a
    lambda refers to would be computed for every element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pixelloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/pixelloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark a *stored* table of `rows` counted rows for broadcast only up to `most`; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def frequency_cutoff(counts: DataFrame, col: str, most: int) -> int:
    """The least power of two such that at most `most` rows of counts have col >= it (64 rows reach the driver)."""
    rows = counts.groupBy(F.floor(F.log2(F.col(col))).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()
    total, best = 0, None
    for r in sorted(rows, key=lambda r: -r["e"]):
        total += r["n"]
        if total > most:
            break
        best = 1 << r["e"]
    return best if best is not None else 1 << 62
