"""Densities on a grid as array columns: integrals, quantiles, smoothing. All are higher-order functions, evaluated inside the JVM and inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value), value being computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(first: int, x: Column) -> Column:
    """first .. size(x); empty if there are none."""
    return F.when(F.size(x) >= first, F.sequence(F.lit(first), F.size(x))).otherwise(F.array().cast("array<int>"))


def strip(y: Column, x: Column, i: Column) -> Column:
    """Area between the knots i - 1 and i."""
    return (F.element_at(y, i) + F.element_at(y, i - 1)) / 2.0 * (F.element_at(x, i) - F.element_at(x, i - 1))


def trapezoid(y: Column, x: Column) -> Column:
    return F.aggregate(places(2, x), F.lit(0.0), lambda s, i: s + strip(y, x, i))


def summed(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda s, v: s + v)


def quantile(y: Column, x: Column, q: float | Column) -> Column:
    """Where the running trapezoid integral of y passes q of its total, linear between knots; on a flat stretch its right end. NaN for a density of 0."""
    want = q if isinstance(q, Column) else F.lit(float(q))
    nothing = F.lit(None).cast("double")

    def fold(all_: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            area = strip(y, x, i)
            inside = (s["acc"] <= want * all_) & (want * all_ < s["acc"] + area)
            here = F.element_at(x, i - 1) + (want * all_ - s["acc"]) / F.when(area > 0, area) * (F.element_at(x, i) - F.element_at(x, i - 1))
            return F.struct((s["acc"] + area).alias("acc"), F.when(inside, here).otherwise(s["at"]).alias("at"))

        found = F.aggregate(places(2, x), F.struct(F.lit(0.0).alias("acc"), nothing.alias("at")), step, lambda s: s["at"])
        return F.when(all_ > 0, F.coalesce(found, F.element_at(x, -1))).otherwise(F.lit(float("nan")))

    return bind(trapezoid(y, x), fold)


def mean(y: Column, x: Column) -> Column:
    """Mean of x weighted by y over the knots, which is no integral. NaN for a density of 0."""
    return bind(summed(y), lambda s: F.when(s > 0, summed(F.zip_with(x, y, lambda a, b: a * b)) / F.when(s > 0, s)).otherwise(F.lit(float("nan"))))


def mode(y: Column, x: Column) -> Column:
    """The first knot of the greatest density."""
    return F.element_at(x, F.array_position(y, F.array_max(y)).cast("int"))


def silverman(y: Column, x: Column) -> Column:
    """Bandwidth 0.9 min(deviation, interquartile range / 1.34) n**-0.2, n being the effective number of knots."""

    def width(s: Column) -> Column:
        m = summed(F.zip_with(x, y, lambda a, b: a * b)) / s
        return bind(m, lambda c: F.lit(0.9) * F.least(F.sqrt(summed(F.zip_with(x, y, lambda a, b: (a - c) * (a - c) * b)) / s), (quantile(y, x, 0.75) - quantile(y, x, 0.25)) / F.lit(1.34)) * F.pow(s * s / summed(F.transform(y, lambda v: v * v)), F.lit(-0.2)))

    return bind(summed(y), width)


def gaussian(x: Column, width: Column) -> Column:
    """A kernel over the grid's odd number of knots, around the middle one."""
    n = F.size(x) - (1 - F.size(x) % 2)
    middle = F.element_at(x, ((n - 1) / 2).cast("int") + 1)
    return F.transform(F.slice(x, 1, n), lambda z: F.exp(F.lit(-0.5) * F.pow((z - middle) / width, F.lit(2.0))))


def smoothed(y: Column, kernel: Column) -> Column:
    """Convolution of y with a kernel of odd length, as long as y, over the kernel's sum; what reaches over the ends is lost."""

    def at_all(k: Column) -> Column:
        def one(i: Column) -> Column:
            half = ((F.size(k) - 1) / 2).cast("int")
            low, high = F.greatest(F.lit(1), i - half), F.least(F.size(y), i + half)
            return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, j: s + F.element_at(y, j) * F.element_at(k, i - j + half + 1))

        return bind(summed(k), lambda w: F.transform(places(1, y), lambda i: one(i) / w))

    return bind(kernel, at_all)
