"""Small artefacts: feature lists, parameters, checkpoints and reports as JSON, CSV and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_feature_list(spark: SparkSession, path: str, method: str, indexes: list[int], names: list[str]) -> str:
    """Write <path>/selected_features_<method>_<n>/{json,csv}; ValueError if the lists differ in length."""
    if len(indexes) != len(names):
        raise ValueError("as many names as indexes are needed")
    to = f"{path}/selected_features_{method}_{len(names)}"
    said = json.dumps({"method": method, "n_features": len(names), "indices": [int(i) for i in indexes], "names": list(names)})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/json")
    rows = [(k + 1, int(i), n) for k, (i, n) in enumerate(zip(indexes, names))]
    spark.createDataFrame(rows, "rank long, idx long, name string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{to}/csv")
    return to


def load_feature_list(spark: SparkSession, path: str, method: str, n: int) -> DataFrame:
    """(rank, idx, name) from the JSON form."""
    said = spark.read.text(f"{path}/selected_features_{method}_{n}/json").select(F.from_json("value", "method string, n_features int, indices array<long>, names array<string>").alias("s"))
    cells = said.select(F.posexplode(F.arrays_zip("s.indices", "s.names")).alias("k", "x"))
    return cells.select((F.col("k") + 1).cast("long").alias("rank"), F.col("x.indices").alias("idx"), F.col("x.names").alias("name"))


def save_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])


def save_table(df: DataFrame, path: str, header: bool = True) -> None:
    """A small evaluation table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", header).csv(path)


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """Markdown of small result tables."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) + " |" for r in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)
