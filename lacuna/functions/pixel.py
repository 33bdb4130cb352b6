"""Differences between pixels and feature vectors, as Columns over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
HALF_PI = 3.14 / 2  # the value that angle comparison is defined with


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def absolute(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def absolute_n(a: Column, b: Column, n: int) -> Column:
    return absolute(F.slice(a, 1, n), F.slice(b, 1, n))


def _weighted(a: Column, b: Column, w: list[float], f) -> Column:
    weights = F.array(*[F.lit(float(x)) for x in w])
    sound = F.when((F.size(a) == len(w)) & (F.size(b) == len(w)), F.zip_with(F.zip_with(a, b, f), weights, lambda d, x: d * x))
    return total(F.coalesce(sound, F.raise_error(F.lit("weights and pixels differ in size")).cast("array<double>")))


def weighted_absolute(a: Column, b: Column, w: list[float]) -> Column:
    return _weighted(a, b, w, lambda p, q: F.abs(p - q))


def weighted_squared(a: Column, b: Column, w: list[float]) -> Column:
    return _weighted(a, b, w, lambda p, q: (p - q) * (p - q))


def hue(p: Column, q: Column) -> Column:
    """The shorter way round between two hues of 0 to 1."""
    return F.least(F.abs(p - q), 1 - F.abs(p - q))


def hsv_squared(a: Column, b: Column, w: list[float] | None = None) -> Column:
    """Cyclic in the first component; weights, if given, also say how many components count."""
    w = w or [1.0, 1.0, 1.0]
    out = F.lit(float(w[0])) * F.pow(hue(a[0], b[0]), 2)
    for i in range(1, len(w)):
        out = out + F.lit(float(w[i])) * (a[i] - b[i]) * (a[i] - b[i])
    return out


def norm(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def feature(a: Column, b: Column, same: Column, sound: Column, w: list[float] | None = None) -> Column:
    """L1, weighted if asked; infinite for a vector and itself or if either is not valid."""
    return F.when(same | ~sound, F.lit(INF)).otherwise(absolute(a, b) if w is None else weighted_absolute(a, b, w))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def angle(a: Column, b: Column) -> Column:
    """acos of the inner product of unit vectors, less a quarter turn where it is more than that."""
    t = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))
    return F.when(t > HALF_PI, t - HALF_PI).otherwise(t)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.sqrt(dot(a, a)))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of sRGB components of 0 to 255. The numbers are the standard's fixed values."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92) * 100.0

    r, g, b = linear(r), linear(g), linear(b)

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, 1.0 / 3.0)).otherwise(7.787 * t + 16.0 / 116.0)

    x = f((r * 0.4124 + g * 0.3576 + b * 0.1805) / 95.047)
    y = f((r * 0.2126 + g * 0.7152 + b * 0.0722) / 100.0)
    z = f((r * 0.0193 + g * 0.1192 + b * 0.9505) / 108.883)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of 0 to 1 for components of 0 to 1; hue 0 where there is none."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    return F.when(h < 0, h + 1.0).otherwise(h), F.when(top == 0, 0.0).otherwise(d / top), top


def rotated(gx: Column, gy: Column) -> tuple[Column, Column]:
    return -gy, gx


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.30 * r + 0.59 * g + 0.11 * b
