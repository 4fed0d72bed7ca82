"""Evaluation tables. Curves are made from counts per distinct score, so a scored table is aggregated once and never sorted whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted", *by: str) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(cm: DataFrame, *by: str) -> DataFrame:
    """(class, precision, recall, f1, support) from counts (truth, predicted, n); 0 where a ratio is undefined."""
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cm.select(*by, F.inline(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), right.alias("ok")),
                                            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("ok")))))
    per = sides.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("p"), F.sum("ok").alias("ok"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return per.select(*by, "class", zero(F.try_divide(F.col("ok"), F.col("p"))).alias("precision"), zero(F.try_divide(F.col("ok"), F.col("support"))).alias("recall"),
                      zero(F.try_divide(2 * F.col("ok"), F.col("p") + F.col("support"))).alias("f1"), "support")


def macro_f1(cm: DataFrame, *by: str) -> DataFrame:
    return class_report(cm, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def binary_macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Macro-F1 of two classes from their counts."""
    one = lambda a, b, c: F.coalesce(F.try_divide(2.0 * a, 2.0 * a + b + c), F.lit(0.0))
    return (one(tp, fp, fn) + one(tn, fn, fp)) / 2


def _by_score(df: DataFrame, score: str, truth: str, buckets: int) -> DataFrame:
    """(score, pos, neg, tp, fp, p, n) per distinct score, the running counts from the highest score down.

    Running sums are taken per bucket of the score range and added to the totals of higher buckets, so that no single task
    has to sort all distinct scores; the bucket totals are `buckets` rows.
    """
    each = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    each = each.withColumn("_b", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col("score") * buckets))).cast("int"))
    totals = each.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select("_b", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"), F.sum("_p").over(every).alias("p"), F.sum("_n").over(every).alias("n"))
    run = Window.partitionBy("_b").orderBy(F.col("score").desc())
    return each.join(F.broadcast(totals), "_b").select("score", "pos", "neg", (F.sum("pos").over(run) + F.col("_pa")).alias("tp"), (F.sum("neg").over(run) + F.col("_na")).alias("fp"), "p", "n")


def roc_curve(df: DataFrame, score: str, truth: str = "label", buckets: int = 1024) -> DataFrame:
    """(score, fpr, tpr): one point for each distinct score."""
    return _by_score(df, score, truth, buckets).select("score", F.try_divide(F.col("fp"), F.col("n")).alias("fpr"), F.try_divide(F.col("tp"), F.col("p")).alias("tpr"))


def roc_auc(df: DataFrame, score: str, truth: str = "label", buckets: int = 1024) -> DataFrame:
    """(auc): trapezoids; equal scores are one step."""
    c = _by_score(df, score, truth, buckets)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return c.agg(F.try_divide(area, F.max("p").cast("double") * F.max("n")).alias("auc"))


def pr_curve(df: DataFrame, score: str, truth: str = "label", buckets: int = 1024) -> DataFrame:
    c = _by_score(df, score, truth, buckets)
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("p")).alias("recall"))


def average_precision(df: DataFrame, score: str, truth: str = "label", buckets: int = 1024) -> DataFrame:
    """(ap): precision at each distinct score, weighted by the recall that it adds."""
    c = _by_score(df, score, truth, buckets)
    return c.agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def calibration(df: DataFrame, score: str, truth: str = "label", bins: int = 10) -> DataFrame:
    """(bin, pred, true, n) of uniform bins; empty ones are absent."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.avg(score).alias("pred"), F.avg(F.col(truth).cast("double")).alias("true"), F.count("*").alias("n"))


def grouped_f1(df: DataFrame, by: str, truth: str = "label", predicted: str = "predicted", least: int = 10) -> DataFrame:
    """(by, n, macro_f1) of groups with at least so many rows."""
    cm = confusion(df, truth, predicted, by)
    sizes = cm.groupBy(by).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sizes.join(macro_f1(cm, by), by).select(by, "n", "macro_f1")
