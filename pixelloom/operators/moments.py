"""Sums of products of all columns by class, in one scan: what correlations, F statistics and covariances are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose products are summed at once.
ROWS = 1 << 14


def class_moments(df: DataFrame, names: list[str], label: str | None = None) -> dict[object, np.ndarray]:
    """By class: the (k + 1) x (k + 1) sums of products of the columns, less their overall means, and a last column of ones.

    Tasks multiply Arrow batches; Spark adds a row for each class, pair of columns and task. Classes are few, so what reaches
    the driver is bounded by the square of the columns. A null counts as the column's mean.
    """
    k = len(names)
    cols = [F.col("`" + n.replace("`", "``") + "`").cast("double") for n in names]
    means = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
    centred = df.select(*(F.coalesce(c - float(means[i] or 0.0), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)), (F.col(label) if label else F.lit(0)).cast("string").alias("y"))
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    i_at, j_at = (np.array(x, np.int32) for x in zip(*at))

    def run(batches):
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.column_stack([*(part.column(i).to_numpy(zero_copy_only=False) for i in range(k)), np.ones(part.num_rows)])
                codes = part.column(k).dictionary_encode()
                own = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(own).tolist():
                    y = codes.dictionary[c].as_py() if c >= 0 else None
                    rows = x[own == c]
                    sums[y] = sums.get(y, 0) + rows.T @ rows
        for y, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(at), pa.string()), pa.array(i_at), pa.array(j_at), pa.array(m[i_at, j_at])], names=["y", "i", "j", "v"])

    out: dict[object, np.ndarray] = {}
    for r in centred.mapInArrow(run, "y string, i int, j int, v double").groupBy("y", "i", "j").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r["y"], np.zeros((k + 1, k + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return out
