"""Corpus pipeline: quality classifier, n-gram near duplicates, benchmark decontamination, best-fit packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs; extra columns are carried along. No stage
works on less than all rows that it gets; empty tables pass through. No stage can be written in SQL as a whole (a trained
model, an exact similarity join, a packing), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import shared_dir, table
from pixelloom.llm.decontaminate import contamination
from pixelloom.llm.ngram_join import one_of_each_group
from pixelloom.llm.packing import pack
from pixelloom.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score >= 0.3); null texts are scored as empty ones."""
    return accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more: the one with the least doc_id, null last.

    Rows of one doc_id are told apart by their text; of rows equal in both, one stays. Documents without words all stay.
    """
    return one_of_each_group(docs, words=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth lie in benchmark windows. Rows with a null doc_id are judged by text."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["gone_hash"])
    return docs.join(found, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=4096, end=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pixelloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
