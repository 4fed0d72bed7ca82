"""Class balance and folds: SMOTE and stratified cross-validation."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import unit_hash
from .metrics import confusion, macro_f1
from .models import SEED, assembled


def _stored(df: DataFrame) -> DataFrame:
    """df written into the folder that executors share, spark.checkpoint.dir (a local one where that is unset), and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    df.write.parquet(path := f"{base}/pixelloom-smote-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


#: Points of a leaf of the split tree, about; the driver holds the tree, a split for each leaf.
LEAF = 1000


def _split_tree(points: np.ndarray, per_leaf: int) -> list[tuple]:
    """Median splits (axis, value, left, right) of a sample of points; a leaf is its number, negative less 1."""
    nodes: list[tuple] = []
    leaves = [0]

    def grow(x: np.ndarray) -> int:
        axis = int(np.ptp(x, 0).argmax()) if len(x) else 0
        if len(x) <= per_leaf or np.ptp(x[:, axis]) == 0:
            leaves[0] += 1
            return -leaves[0]
        at = float(np.median(x[:, axis]))
        at = at if (x[:, axis] < at).any() else float(x[x[:, axis] > at, axis].min())  # points under `at` go left
        nodes.append(())
        me, left = len(nodes) - 1, x[:, axis] < at
        nodes[me] = (axis, at, grow(x[left]), grow(x[~left]))
        return me

    top = grow(points)
    return [(0, -np.inf, top, top), *((a, v, *(n + 1 if n >= 0 else n for n in (lo, hi))) for a, v, lo, hi in nodes)] if top < 0 else nodes


def _leaves(nodes: list[tuple], x: np.ndarray, reach: float) -> list[int]:
    """Leaves within `reach` of point x; 0: the one that it is in."""
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        if k < 0:
            out.append(-k)
            continue
        axis, at, lo, hi = nodes[k]
        if x[axis] - reach < at:
            todo.append(lo)
        if x[axis] + reach >= at:
            todo.append(hi)
    return out


def nearest(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(x, mine, near): of each distinct point x (array of numbers) on `mine` rows, the nearest other rows' points, k at most.

    Exact, by Euclidean distance: rows on the same point come first, then other points by distance, each as often as it has rows. A
    point looks in its own leaf of a split tree, and then in every leaf within the distance of the k-th row found there.
    """
    distinct = _stored(points.groupBy("x").agg(F.count("*").alias("mine")))
    n = distinct.count()
    # the tree is drawn from a sample that gives each leaf some points; it decides how work is dealt, not which rows are near
    share = min(1.0, max(100_000, 32 * n / leaf) / max(n, 1))
    sample = np.array([r[0] for r in distinct.where(unit_hash(F.lit("tree"), F.col("x").cast("string")) < share).select("x").collect()], float)
    nodes = _split_tree(sample.reshape(len(sample), -1), max(1, int(leaf * share))) if len(sample) else [(0, -np.inf, -1, -1)]
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def placed(batches):
        for batch in batches:
            x = batch.column(0).to_pylist()
            at = [_leaves(tree.value, p, 0.0)[-1] for p in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["x", "mine", "leaf"])

    kind = "x array<double>, mine long"
    homes = _stored(distinct.mapInArrow(placed, f"{kind}, leaf long"))

    def found(asked: np.ndarray, own: np.ndarray, rows: np.ndarray):
        """Of each asked point the nearest other points of a leaf: (distance, point, rows), until they have k rows."""
        for a in range(0, len(asked), 256):
            part = asked[a : a + 256]
            d = np.sqrt(sum((part[:, None, i] - own[None, :, i]) ** 2 for i in range(own.shape[1])))
            least = np.argpartition(d, min(k, d.shape[1] - 1), 1)[:, : k + 1] if d.shape[1] > k + 1 else np.tile(np.arange(d.shape[1]), (len(part), 1))
            for i, cols in enumerate(least):
                yield [(float(d[i, c]), own[c].tolist(), int(rows[c])) for c in sorted(cols, key=lambda c: (d[i, c], *own[c])) if (part[i] != own[c]).any()][:k]

    def first(table: pa.Table) -> pa.Table:
        x, rows = np.array(table.column("x").to_pylist(), float), table.column("mine").to_numpy()
        out = {"x": [], "mine": [], "leaf": [], "reach": []}
        home = table.column("leaf")[0].as_py()
        for p, m, near in zip(x, rows, found(x, x, rows)):
            need, reach = k - (m - 1), 0.0
            for d, _, c in near:
                if need <= 0:
                    break
                need, reach = need - c, d
            # points with too few rows in their leaf look everywhere
            out["x"].append(p.tolist()), out["mine"].append(int(m)), out["leaf"].append(home), out["reach"].append(float("inf") if need > 0 else reach)
        return pa.table(out)

    def sent(batches):
        for batch in batches:
            x, mine, reach = (batch.column(i).to_pylist() for i in (0, 1, 3))
            to = [(p, m, at) for p, m, r in zip(x, mine, reach) for at in (_leaves(tree.value, p, r))]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in to], pa.list_(pa.float64())), pa.array([t[1] for t in to], pa.int64()), pa.array([t[2] for t in to], pa.int64())], names=["x", "mine", "leaf"])

    one = "struct<d: double, p: array<double>, c: long>"

    def second(asked: pa.Table, own: pa.Table) -> pa.Table:
        shape = pa.schema([("x", pa.list_(pa.float64())), ("mine", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("p", pa.list_(pa.float64())), ("c", pa.int64())])))])
        if not asked.num_rows or not own.num_rows:
            return shape.empty_table()
        x = np.array(asked.column("x").to_pylist(), float)
        near = found(x, np.array(own.column("x").to_pylist(), float), own.column("mine").to_numpy())
        return pa.table({"x": asked.column("x"), "mine": asked.column("mine"), "near": [[{"d": d, "p": p, "c": c} for d, p, c in n] for n in near]}, schema=shape)

    reached = homes.groupBy("leaf").applyInArrow(first, f"{kind}, leaf long, reach double").mapInArrow(sent, f"{kind}, leaf long")
    answers = reached.groupBy("leaf").cogroup(homes.groupBy("leaf")).applyInArrow(second, f"{kind}, near array<{one}>")
    merged = answers.groupBy("x", "mine").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    each = F.flatten(F.transform("near", lambda s: F.array_repeat(s["p"], F.least(s["c"], F.lit(k)).cast("int"))))
    own = F.array_repeat(F.col("x"), F.least(F.col("mine") - 1, F.lit(k)).cast("int"))
    return merged.select("x", "mine", F.slice(F.concat(own, each), 1, k).alias("near"))


def smote(df: DataFrame, names: list[str], minority: int, neighbours: int = 5, label: str = "label", key: str = "row_id") -> DataFrame:
    """df (key, label, names) with `synthetic` and one new minority row for each minority row, between it and one of its nearest.

    The `neighbours` nearest minority rows are exact, in columns divided by their standard deviations; a null counts as the mean
    there. The only row of a class has no neighbour and is repeated.
    """
    base = df.select(key, label, *names)
    few = base.where(F.col(label) == minority)
    stats = few.agg(*(F.avg(n).alias(f"{n}|m") for n in names), *(F.stddev_pop(n).alias(f"{n}|s") for n in names)).first()
    mean, sd = [float(stats[f"{n}|m"] or 0.0) for n in names], [float(stats[f"{n}|s"] or 0.0) or 1.0 for n in names]
    x = F.array(*((F.coalesce(F.col(n).cast("double"), F.lit(m)) - m) / s + 0.0 for n, m, s in zip(names, mean, sd)))
    few = few.withColumn("x", x)
    u = lambda salt: unit_hash(F.lit(salt), F.col(key).cast("string"))
    found = few.join(nearest(few.select("x"), neighbours).select("x", "near"), "x")
    pick = F.coalesce(F.get("near", F.floor(u("pick") * F.size("near")).cast("int")), F.col("x"))
    made = found.withColumn("_to", pick).withColumn("_g", u("gap"))
    value = lambda i, n: F.col(n) + F.col("_g") * (F.get("_to", F.lit(i)) - F.get("x", F.lit(i))) * sd[i]
    made = made.select(key, label, *(value(i, n).alias(n) for i, n in enumerate(names)), F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(made)


def stratified_folds(df: DataFrame, folds: int = 3, label: str = "label", key: str = "row_id") -> DataFrame:
    """df with `fold`: by hash, so that each label is spread alike in expectation, without a sort."""
    return df.withColumn("fold", F.floor(unit_hash(F.lit("fold"), F.col(label).cast("string"), F.col(key).cast("string")) * folds).cast("int"))


def cross_validated_f1(df: DataFrame, names: list[str], folds: int = 3, label: str = "label", key: str = "row_id") -> DataFrame:
    """(fold, macro_f1) of a small forest that is trained on the other folds."""
    data = assembled(stratified_folds(df, folds, label, key), names).persist()
    rows = []
    try:
        for k in range(folds):
            model = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=5, maxDepth=4, seed=SEED).fit(data.where(F.col("fold") != k))
            out = model.transform(data.where(F.col("fold") == k)).select(F.col(label).cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"))
            rows.append((k, macro_f1(confusion(out)).first()[0] or 0.0))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, macro_f1 double")
