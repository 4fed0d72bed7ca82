import math

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import pixels as P


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_optical_densities_differ_in_their_floors(spark):
    x = F.lit(0.0)
    r = one(spark, a=P.od_normaliser(x), b=P.od_feature(x), c=P.od_luminosity(x))
    assert r["a"] == pytest.approx(math.log(255)) and r["b"] == pytest.approx(-math.log(1e-6)) and r["c"] == pytest.approx(-math.log(1e-6))


def test_white_and_gray_colours(spark):
    w = F.lit(255.0)
    (l, a, b), (h, s, v) = P.lab(w, w, w), P.hsv(F.lit(10.0), F.lit(10.0), F.lit(10.0))
    r = one(spark, l=l, a=a, b=b, h=h, s=s, v=v)
    assert r["l"] == pytest.approx(100, abs=0.01) and abs(r["a"]) < 0.02 and abs(r["b"]) < 0.02
    assert (r["h"], r["s"]) == (0, 0) and r["v"] == pytest.approx(10 / 255)


def test_red_hue_wraps(spark):
    h, _, _ = P.hsv(F.lit(255.0), F.lit(0.0), F.lit(51.0))
    assert one(spark, h=h)["h"] == pytest.approx(1 - 0.2 / 6)


def test_clip_truncates(spark):
    r = one(spark, a=P.to_byte(F.lit(300.0)), b=P.to_byte(F.lit(-3.0)), c=P.to_byte(F.lit(1.99)))
    assert tuple(r) == (255, 0, 1)


def test_cleaning_policies(spark):
    r = one(spark, a=P.zeroed(F.lit(float("nan"))), b=P.zeroed(F.lit(float("-inf"))), c=P.bounded(F.lit(float("inf"))), d=P.bounded(F.lit(float("nan"))))
    assert tuple(r) == (0.0, 0.0, P.FLOAT_MAX, 0.0)


def test_ties_go_to_class_0_by_argmax_and_1_by_threshold(spark):
    r = one(spark, a=P.argmax_label(F.lit(0.5), F.lit(0.5)), b=P.threshold_label(F.lit(0.5)))
    assert tuple(r) == (0, 1)


def test_memory_budget_priorities():
    from pixelloom.functions.memory import MemoryBudget

    assert MemoryBudget(16_000).batch_size() == 426 and MemoryBudget(16_000, share=0.5).batch_size() == 213
    assert MemoryBudget(16_000, max_mb=600).batch_size([20, 40]) == 15 and MemoryBudget(100).batch_size() == 5
    assert MemoryBudget(10**6).batch_size() == 500 and MemoryBudget(100, batch=7).batch_size() == 7
    with pytest.raises(ValueError):
        MemoryBudget(0)
