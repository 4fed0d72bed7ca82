"""Column expressions over pixels: optical densities, colour spaces, cleaning, quantising. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ (D65), the D65 white point, stain vectors, luminance floor and tissue threshold.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
OD_FLOOR, TISSUE_OD = 1e-6, 0.15
FLOAT_MAX = 3.4028234663852886e38


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(lit(high), F.greatest(lit(low), x))


def to_byte(x: Column) -> Column:
    """Clip to 0-255 and drop the fraction."""
    return F.floor(clip(x, 0, 255)).cast("long")


def od_normaliser(x: Column) -> Column:
    return -F.ln(clip(x, 1, 255) / 255.0)


def od_feature(x: Column) -> Column:
    return -F.ln(x / 255.0 + OD_FLOOR)


def od_luminosity(x: Column) -> Column:
    return -F.ln(clip(x / 255.0, OD_FLOOR, 1))


def od_to_byte(od: Column) -> Column:
    return to_byte(255.0 * F.exp(-od))


def is_tissue(*od: Column) -> Column:
    return F.greatest(*od) > TISSUE_OD


def _linear(x: Column) -> Column:
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, lit(2.4))).otherwise(x / 12.92)


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, lit(1 / 3))).otherwise(7.787 * t + 16 / 116)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of 0-255 sRGB under D65."""
    lin = [_linear(c / 255.0) for c in (r, g, b)]
    x, y, z = (_lab_f((lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2]) / w) for m, w in zip(RGB_TO_XYZ, WHITE))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation, value in 0-1; gray has hue 0."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    turn = F.when(r == v, (g - b) / d).when(g == v, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    hue = F.when(d == 0, 0.0).otherwise(turn - F.floor(turn))
    return hue, F.when(d == 0, 0.0).otherwise(d / v), v


def hed(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Stain separation by the fixed matrix as it is given."""
    logs = [F.ln(F.greatest(c / 255.0, lit(OD_FLOOR))) / math.log(OD_FLOOR) for c in (r, g, b)]
    return tuple(F.greatest(logs[0] * STAINS[0][k] + logs[1] * STAINS[1][k] + logs[2] * STAINS[2][k], lit(0)) for k in range(3))


def edge_distance(r: Column, c: Column, height: int, width: int) -> Column:
    """Distance to the nearest border, as a share of height or width."""
    return F.least(F.least(r, height - 1 - r) / float(height), F.least(c, width - 1 - c) / float(width))


def zeroed(x: Column) -> Column:
    """NaN and both infinities become 0; null stays null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def bounded(x: Column) -> Column:
    """NaN becomes 0 and infinities the largest float of their sign."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), FLOAT_MAX).when(x == float("-inf"), -FLOAT_MAX).otherwise(x)


def gray_level(v: Column, step: int = 8) -> Column:
    """Quantised gray level of a 0-255 value."""
    return F.floor(F.floor(v) / step).cast("long")


def gradient_magnitude(h: Column, v: Column) -> Column:
    return F.sqrt(h * h + v * v)


def anisotropy(large: Column, small: Column) -> Column:
    return (large - small) / (large + small + 1e-8)


def argmax_label(p0: Column, p1: Column) -> Column:
    """A tie is class 0."""
    return (p1 > p0).cast("long")


def threshold_label(p1: Column, at: float = 0.5) -> Column:
    """A tie is class 1."""
    return (p1 >= at).cast("long")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    return F.round(x, digits) + 0.0
