import numpy as np
from pyspark.sql import functions as F

from pixelloom.operators import balance


def test_every_minority_row_gets_one_between_it_and_a_nearest_row(spark):
    g = np.random.default_rng(7)
    x = np.concatenate([g.normal(size=(150, 2)), g.normal(size=(1, 2)) + 50, np.repeat(g.normal(size=(3, 2)), 4, 0)]).round(3)
    few = spark.createDataFrame([(p.tolist(),) for p in x], "x array<double>")
    for leaf in (5, 1000):  # many leaves, and one
        near = {tuple(r["x"]): r["near"] for r in balance.nearest(few, 3, leaf).collect()}
        assert set(near) == {tuple(p) for p in x}
        for i, p in enumerate(x):
            want = np.sort(np.sqrt(((np.delete(x, i, 0) - p) ** 2).sum(1)))[:3]
            assert np.allclose(np.sqrt(((np.array(near[tuple(p)]) - p) ** 2).sum(1)), want)
    rows = spark.createDataFrame([(i, 1, *map(float, p)) for i, p in enumerate(x)] + [(1000 + i, 0, 0.0, 0.0) for i in range(9)], "row_id long, label long, a double, b double")
    made = {r["row_id"]: r for r in balance.smote(rows, ["a", "b"], 1, 3).where("synthetic").collect()}
    assert set(made) == set(range(len(x)))
    sd = x.std(0)
    for i, p in enumerate(x):
        z = (x - p) / sd
        d = np.sqrt((z**2).sum(1))
        d[i] = np.inf
        reach = np.sort(d)[2] + 1e-9
        to = np.array([made[i]["a"], made[i]["b"]])
        gaps = [np.abs(np.cross(np.append((q - p) / sd, 0), np.append((to - p) / sd, 0))).max() for q, e in zip(x, d) if e <= reach]
        assert min(gaps) < 1e-6 and np.sqrt((((to - p) / sd) ** 2).sum()) <= reach


def test_a_lone_row_is_repeated(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (2, 0, 3.0)], "row_id long, label long, a double")
    assert [r["a"] for r in balance.smote(rows, ["a"], 1).where(F.col("synthetic")).collect()] == [2.0]
