"""Feature selection: class statistics and correlations from one scan, greedy choice on a features-by-features table."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import class_moments

METHODS = ("mrmr", "anova", "rfe")

# The names of the 93 features and their order, which stored tables and models go by.
_SPACES = [f"color_{s}_c{c}_r{r}_{k}" for s, c, r, k in product(("lab", "hsv", "hed"), range(3), (3, 7, 15), ("mean", "std"))]


def feature_names() -> list[str]:
    """The 93 feature names in canonical order."""
    gabor = [f"gabor_f{f}_t{t}" for f, t in product(("0.1", "0.2", "0.4"), ("0", "pi_4", "pi_2", "3pi_4"))]
    rest = ["gradient_sobel_h", "gradient_sobel_v", "gradient_sobel_mag", "gradient_log_s2", "gradient_log_s4", "struct_ev1", "struct_ev2", "struct_anisotropy", "dog_s1_s2",
            "dog_s2_s4", "dog_s4_s8", "superpixel_hed_h", "superpixel_lab_l", "entropy", "edge_dist"]
    glcm = [f"glcm_{p}" for p in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")]
    return ["od_R", "od_G", "od_B", *_SPACES, "lbp_r1", "lbp_r2", "lbp_r3", *gabor, *rest, *glcm]


def feature_group(name: str) -> str:
    return name.split("_")[0]


def f_values(moments: dict[object, np.ndarray]) -> list[float | None]:
    """One-way F of every column over the classes: 0 or infinity without variance inside them; None where it has no meaning."""
    k = next((len(m) - 1 for m in moments.values()), 0)
    n = {y: m[-1, -1] for y, m in moments.items()}
    total, out = sum(n.values()), []
    for i in range(k):
        square, whole = sum(m[i, i] for m in moments.values()), sum(m[i, -1] for m in moments.values())
        means = sum(m[i, -1] ** 2 / n[y] for y, m in moments.items())
        between, within = means - whole**2 / total, square - means
        if within > 0:
            out.append(None if len(n) < 2 or total == len(n) else float(between / (len(n) - 1) / (within / (total - len(n)))))
        else:
            out.append(float("inf") if between > 0 else 0.0)
    return out


def correlation_matrix(moments: dict[object, np.ndarray]) -> np.ndarray:
    """|Pearson| of all pairs of columns, 0 where one is constant, 1 on the diagonal."""
    m = sum(moments.values())
    x = m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) / m[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(x), 0))
    r = np.abs(np.divide(x, np.outer(scale, scale), out=np.zeros_like(x), where=np.outer(scale, scale) > 0))
    np.fill_diagonal(r, 1.0)
    return np.minimum(r, 1.0)


def anova_f(df: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """(feature, f): one-way F of every column over the label's classes, from one scan; the classes are few.

    A column without variance inside the classes has F 0 if the class means agree, else infinity.
    """
    return df.sparkSession.createDataFrame(list(zip(names, f_values(class_moments(df, names, label)))), "feature string, f double")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for all pairs a < b in column order: |Pearson|, 0 where a column is constant. One scan, whatever the columns."""
    found = class_moments(df, names)
    r = correlation_matrix(found) if found else np.zeros((len(names), len(names)))
    return df.sparkSession.createDataFrame([(names[i], names[j], float(r[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))], "a string, b string, r double")


def high_pairs(df: DataFrame, names: list[str], over: float = 0.8) -> DataFrame:
    return correlations(df, names).where(F.col("r") > over)


def anova_top(df: DataFrame, names: list[str], k: int, label: str = "label") -> DataFrame:
    """(rank, idx, feature, f): the k largest F; of ties the later column comes first."""
    idx = F.array_position(F.array(*map(F.lit, names)), F.col("feature")) - 1
    top = anova_f(df, names, label).withColumn("idx", idx)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("f").desc(), F.col("idx").desc()))).where(F.col("rank") <= k).select("rank", "idx", "feature", "f")


def mrmr(df: DataFrame, names: list[str], k: int, label: str = "label") -> list[int]:
    """Indexes in order of choice: most relevance (min-max F) less mean redundancy (|r| with those chosen); ties to the lower."""
    if not 0 < k <= len(names):
        raise ValueError("k must be between 1 and the number of columns")
    found = class_moments(df, names, label)  # relevance and redundancy from the same scan
    rel = np.nan_to_num(np.array(f_values(found), float), nan=0.0, posinf=np.finfo(float).max / 4)
    if rel.max() > rel.min():
        rel = (rel - rel.min()) / (rel.max() - rel.min())
    corr = correlation_matrix(found)
    chosen = [int(rel.argmax())]
    while len(chosen) < k:
        value = rel - corr[:, chosen].mean(1)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def rfe(df: DataFrame, names: list[str], k: int, label: str = "label", step: int = 5, iterations: int = 100) -> list[int]:
    """Recursive elimination: drop the columns of least squared logistic coefficients, `step` at a time; ascending indexes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if not 0 < k <= len(names):
        raise ValueError("k must be between 1 and the number of columns")
    left = list(range(len(names)))
    df = df.persist()
    try:
        while len(left) > k:
            data = VectorAssembler(inputCols=[names[i] for i in left], outputCol="_x", handleInvalid="keep").transform(df)
            model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, standardization=True).fit(data)
            weight = (model.coefficientMatrix.toArray() ** 2).sum(0)
            drop = min(step, len(left) - k)
            gone = set(np.argsort(weight, kind="stable")[:drop].tolist())
            left = [x for i, x in enumerate(left) if i not in gone]
    finally:
        df.unpersist()
    return left


def select(df: DataFrame, names: list[str], k: int, method: str = "mrmr", label: str = "label") -> list[int]:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if method == "mrmr":
        return mrmr(df, names, k, label)
    if method == "anova":
        return [r["idx"] for r in anova_top(df, names, k, label).orderBy("rank").collect()]
    return rfe(df, names, k, label)


def jaccard(sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all pairs of rows (method, names array), each with itself too; methods are few."""
    a = sets.select(F.col("method").alias("a"), F.col("names").alias("x"))
    b = sets.select(F.col("method").alias("b"), F.col("names").alias("y"))
    either = F.size(F.array_union("x", "y"))
    return a.join(F.broadcast(b), F.lit(True)).select("a", "b", F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / either).alias("jaccard"))


def elbow(scores: DataFrame, least: int = 15, gain: float = 0.002, default: int = 20) -> DataFrame:
    """(method, n): the first n >= least at which the score gains less than `gain` over the size before, else the default."""
    before = F.lag("f1").over(Window.partitionBy("method").orderBy("n"))
    hit = F.when((F.col("n") >= least) & (F.col("f1") - F.col("before") < gain), F.col("n"))
    return scores.withColumn("before", before).groupBy("method").agg(F.coalesce(F.min(hit), F.lit(default)).alias("n"))
