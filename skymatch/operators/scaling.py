"""Free flux scales: the factor of a reference object's fluxes that a target likes best, under a prior."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.photometry import error, flux, total


@dataclass(frozen=True)
class Prior:
    """1 between low and high, 0 elsewhere."""

    low: float = -math.inf
    high: float = math.inf

    @property
    def fixed(self) -> bool:
        return self.low == self.high

    @classmethod
    def parse(cls, text: str) -> Prior:
        """`uniform`, `tophat LOW HIGH` or `delta VALUE`."""
        name, *args = text.split()
        values = [float(a) for a in args]
        if name == "uniform" and not values:
            return cls()
        if name == "tophat" and len(values) == 2 and values[0] <= values[1]:
            return cls(*values)
        if name == "delta" and len(values) == 1:
            return cls(values[0], values[0])
        raise ValueError(f"the prior {text!r} isn't known")


def solved(f: list[np.ndarray], e: list[np.ndarray], g: list[np.ndarray], s: list[np.ndarray], prior: Prior, max_iter: int = 20, rtol: float = 1e-8) -> np.ndarray:
    """Scales of pairs: fluxes and errors of objects (f, e) and targets (g, s), band by band, each an array of pairs.

    The guess ignores the object's errors. Where it lies outside the prior the bound is the answer; elsewhere the secant method follows the derivative of
    half the chi-squared from just below the guess. A flat prior adds nothing to the derivative. Pairs that have arrived take no more part.
    """
    if prior.fixed:
        return np.full(len(f[0]), prior.low)
    cross, square = np.zeros(len(f[0])), np.zeros(len(f[0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        for fb, gb, sb in zip(f, g, s):
            v = sb**2
            cross += fb * gb / v
            square += fb**2 / v
        guess = np.where(square > 0, cross / square, 1.0)

    def slope(a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        with np.errstate(divide="ignore", invalid="ignore"):
            for fb, eb, gb, sb in zip(f, e, g, s):
                n, v = a * fb - gb, (a * eb) ** 2 + sb**2
                out += np.where(np.isfinite(v) & (v > 0), fb * n / v - a * eb * eb * n * n / (v * v), 0.0)
        return out

    def kept(going: np.ndarray) -> list:
        return [[x[going] for x in band] for band in (f, e, g, s)]

    out, at = guess, np.flatnonzero((guess > prior.low) & (guess < prior.high))
    if len(at) < len(out):
        f, e, g, s = kept(at)
    x1 = guess[at]
    x0 = x1 - 1e-4
    y0, y1 = slope(x0), slope(x1)
    for _ in range(max_iter):
        if not len(at):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            step = y1 * (x1 - x0) / (y1 - y0)
        step = np.where(np.isfinite(step), step, 0.0)
        x0, y0, x1 = x1, y1, x1 - step
        out[at] = x1
        going = np.abs(step) > rtol * np.abs(x1)
        if not going.all():
            at, x0, y0, x1 = at[going], x0[going], y0[going], x1[going]
            f, e, g, s = kept(going)
        y1 = slope(x1)
    return np.clip(out, prior.low, prior.high)


def chi2_of_pairs(f: list[np.ndarray], e: list[np.ndarray], g: list[np.ndarray], s: list[np.ndarray], scale: np.ndarray) -> np.ndarray:
    """Distances of pairs as `solved` takes them, bands added one by one."""
    out = np.zeros(len(scale))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for fb, eb, gb, sb in zip(f, e, g, s):
            n, v = (scale * fb - gb) ** 2, (scale * eb) ** 2 + sb**2
            out += np.where(v == 0, np.where(n == 0, 0.0, np.inf), n / v)
    return out


def best_scales(t: np.ndarray, r: np.ndarray, prior: Prior, max_iter: int = 20, rtol: float = 1e-8) -> np.ndarray:
    """t[targets, bands, 2], r[objects, bands, 2]: scales [targets, objects], as `solved`."""
    pairs = [[np.repeat(t[:, b, j], len(r)) for b in range(t.shape[1])] for j in range(2)]
    objects = [[np.tile(r[:, b, j], len(t)) for b in range(t.shape[1])] for j in range(2)]
    return solved(*objects, *pairs, prior, max_iter, rtol).reshape(len(t), len(r))


def within_reach(f: list[np.ndarray], e: list[np.ndarray], g: np.ndarray | list[np.ndarray], s: np.ndarray | list[np.ndarray], limit: float | np.ndarray, prior: Prior) -> np.ndarray:
    """Places of the objects that some scale of the prior may bring as near as a limit to a target (g, s): the scales at which each band alone is within it have one in common. Bands whose scales aren't an interval decide nothing, so what is left out is certain. For pairs g[band], s[band] and the limit are arrays, too; a limit that is NaN leaves nothing out.

    A band is within the limit where (a f - g)^2 <= limit (a^2 e^2 + s^2), a quadratic inequality in the scale a.
    """
    at = np.arange(len(f[0]))
    low, high = np.full(len(at), prior.low), np.full(len(at), prior.high)
    wide = limit * (1 + 1e-6) + 1e-9  # roundings lose nothing
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for fb, eb, gb, sb in zip(f, e, g, s):
            fb, eb, gb, sb, w = (x[at] if np.ndim(x) else x for x in (fb, eb, gb, sb, wide))
            a, b, c = fb * fb - w * (eb * eb), fb * gb, gb * gb - w * (sb * sb)
            root = b * b - a * c
            closed = a > 1e-9 * fb * fb  # an interval, and not by rounding
            half = np.sqrt(np.maximum(root, 0)) + 1e-9 * np.abs(b)
            low = np.where(closed, np.fmax(low, (b - half) / a), low)
            high = np.where(closed, np.fmin(high, (b + half) / a), high)
            keep = ~(low > high) & ~(closed & (root < -1e-9 * b * b))
            at, low, high = at[keep], low[keep], high[keep]
    return at


def beyond_reach(f: list[np.ndarray], e: list[np.ndarray], g: list[np.ndarray], s: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Whether no scale brings a pair, as `solved` takes them, as near as its limit; where it isn't certain it is False.

    With (p, q) on the unit circle for (a, 1) a distance is a sum of (p f - q g)^2 / (p^2 e^2 + q^2 s^2), at least that of (p f - q g)^2 / max(e^2, s^2): a quadratic form, whose lesser eigenvalue is the bound. It is closest
    where both sides are of one size, so they are divided by theirs, which changes no distance.
    """
    wide = limit * (1 + 1e-6) + 1e-9  # roundings lose nothing
    a, b, ff, gg, fg = (np.zeros(len(limit)) for _ in range(5))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for fb, gb in zip(f, g):
            a += fb * fb
            b += gb * gb
        for fb, eb, gb, sb in zip(f, e, g, s):
            w = np.minimum(a / (eb * eb), b / (sb * sb))
            ff += w * (fb * fb / a)
            gg += w * (gb * gb / b)
            fg += w * (fb * gb / np.sqrt(a * b))
        return (ff > wide) & (gg > wide) & ((ff - wide) * (gg - wide) - fg * fg > 1e-12 * ff * gg)


def with_units(df: DataFrame, bands: list[str], prefix: str = "") -> DataFrame:
    """df with what `may_come_near` compares: fluxes u over their size, m that is 1 for bands of a finite error and 0 for others, which don't count, whether all do, and the largest squared error v over the size. Objects without a finite size have no band that counts. Nothing is null."""
    df = df.withColumns({f"{prefix}m_{b}": F.when(F.abs(error(b, prefix)) < float("inf"), F.lit(1.0)).otherwise(F.lit(0.0)) for b in bands})
    size = total([F.when(F.col(f"{prefix}m_{b}") > 0, flux(b, prefix) * flux(b, prefix)).otherwise(F.lit(0.0)) for b in bands])
    df = df.withColumn("_size", F.when((size > 1e-100) & (size < float("inf")), size))
    ok = {b: F.col("_size").isNotNull() & (F.col(f"{prefix}m_{b}") > 0) for b in bands}
    out = {f"{prefix}u_{b}": F.coalesce(F.when(x, flux(b, prefix) / F.sqrt("_size")), F.lit(0.0)) for b, x in ok.items()}
    out |= {f"{prefix}m_{b}": F.when(x, F.lit(1.0)).otherwise(F.lit(0.0)) for b, x in ok.items()}
    out[f"{prefix}all"] = reduce(and_, ok.values())
    out[f"{prefix}v"] = F.greatest(F.lit(0.0), *(F.coalesce(F.when(x, error(b, prefix) * error(b, prefix) / F.col("_size")), F.lit(0.0)) for b, x in ok.items()))
    return df.withColumns(out).drop("_size")


def may_come_near(bands: list[str], wide: Column, ref: str = "n_", target: str = "") -> Column:
    """`beyond_reach` negated, with the largest error for all errors: weaker, but short enough to be compiled as a join's condition. Each band adds to the distance, so some bands decide as well."""
    ru, rm, tu, tm = ([F.col(f"{x}{c}_{b}") for b in bands] for x in (ref, target) for c in "um")
    far = wide * F.when(F.col(f"{ref}v") > F.col(f"{target}v"), F.col(f"{ref}v")).otherwise(F.col(f"{target}v"))
    ff, gg, fg = total([x * x * m for x, m in zip(ru, tm)]), total([x * x * m for x, m in zip(tu, rm)]), total([x * y for x, y in zip(ru, tu)])
    whole = F.abs(fg) >= F.lit(1.0 - 1e-12) - far  # both sums of squares are 1
    return F.when(F.col(f"{ref}all") & F.col(f"{target}all"), whole).otherwise(~((ff > far) & (gg > far) & ((ff - far) * (gg - far) - fg * fg > 1e-12)))


def best_scale(f: list[Column], e: list[Column], g: list[Column], s: list[Column], prior: Prior, max_iter: int = 20, rtol: float = 1e-8) -> Column:
    """best_scales as an expression: fluxes and errors of an object (f, e) and a target (g, s), band by band. It stays in the JVM, as a fold over an array of bands inside a fold over the iterations."""
    low, high = F.lit(float(prior.low)), F.lit(float(prior.high))
    if prior.fixed:
        return low
    bands = F.array(*(F.struct(*(c.cast("double").alias(n) for n, c in zip("fegs", b))) for b in zip(f, e, g, s)))
    zero = F.lit(0.0)
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)  # noqa: E731 (also null for NaN, which is above all numbers)

    def slope(bands: Column, a: Column) -> Column:
        def term(total: Column, b: Column) -> Column:
            n, v = a * b["f"] - b["g"], (a * b["e"]) * (a * b["e"]) + b["s"] * b["s"]
            v = F.when(v > 0, finite(v))
            return total + F.coalesce(b["f"] * n / v - a * b["e"] * b["e"] * n * n / (v * v), zero)

        return F.aggregate(bands, zero, term)

    def solved(bands: Column) -> Column:
        def sums(t: Column, b: Column) -> Column:
            v = b["s"] * b["s"]
            v = F.when(v > 0, v)
            return F.struct((t["cross"] + F.coalesce(b["f"] * b["g"] / v, zero)).alias("cross"), (t["square"] + F.coalesce(b["f"] * b["f"] / v, zero)).alias("square"))

        guess = F.aggregate(bands, F.struct(zero.alias("cross"), zero.alias("square")), sums, lambda t: F.coalesce(t["cross"] / F.when(t["square"] > 0, t["square"]), F.lit(1.0)))

        def follow(x: Column) -> Column:
            below = x - 1e-4

            def step(t: Column, _: Column) -> Column:
                rise = t["y1"] - t["y0"]
                move = F.when(t["going"], F.coalesce(finite(t["y1"] * (t["x1"] - t["x0"]) / F.when(rise != 0, rise)), zero)).otherwise(zero)

                def moved(m: Column) -> Column:
                    x1 = t["x1"] - m
                    going = t["going"] & (F.abs(m) > rtol * F.abs(x1))
                    pick = lambda a, b: F.when(t["going"], t[a]).otherwise(t[b])
                    return F.struct(pick("x1", "x0").alias("x0"), x1.alias("x1"), pick("y1", "y0").alias("y0"), F.when(going, slope(bands, x1)).otherwise(t["y1"]).alias("y1"), going.alias("going"))

                return bind(move, moved)

            start = F.struct(below.alias("x0"), x.alias("x1"), slope(bands, below).alias("y0"), slope(bands, x).alias("y1"), ((x > low) & (x < high)).alias("going"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), start, step, lambda t: F.greatest(F.least(t["x1"], high), low))

        return bind(guess, follow)

    return bind(bands, solved)
