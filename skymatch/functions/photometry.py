"""Column expressions over bands. A band b of a table stands in columns <prefix>f_b (flux) and <prefix>e_b (error)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the weight at distance 0, the largest 32-bit float.
LARGEST = 3.4028234663852886e38
#: The least positive normal 32-bit float: smaller weights count as none.
LEAST_WEIGHT = 1.1754943508222875e-38


def flux(band: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}f_{band}")


def error(band: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}e_{band}")


def total(terms: list[Column]) -> Column:
    """The terms from left to right, so that other engines add up alike."""
    return reduce(add, terms)


def ratio(x: Column, y: Column, otherwise: float = float("inf")) -> Column:
    """x / y, or a given value where y is 0."""
    return F.when(y == 0, F.lit(otherwise)).otherwise(x / F.when(y != 0, y))


def euclidean(bands: list[str], ref: str = "n_", target: str = "", scale: Column | None = None) -> Column:
    a = (lambda c: c) if scale is None else (lambda c: scale * c)
    return F.sqrt(total([(a(flux(b, ref)) - flux(b, target)) * (a(flux(b, ref)) - flux(b, target)) for b in bands]))


def chi2(bands: list[str], ref: str = "n_", target: str = "", scale: Column | None = None) -> Column:
    """Sum of squared flux differences over summed squared errors. An infinite error drops its band."""
    a = (lambda c: c) if scale is None else (lambda c: scale * c)

    def term(b: str) -> Column:
        d, r, t = a(flux(b, ref)) - flux(b, target), a(error(b, ref)), error(b, target)
        n, v = d * d, r * r + t * t
        return F.when(v == 0, F.when(n == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(n / F.when(v != 0, v))

    return total([term(b) for b in bands])


class InSpark:
    """What a metric's formula may call beside + - * and comparisons, for columns."""

    sqrt, abs = staticmethod(F.sqrt), staticmethod(F.abs)

    @staticmethod
    def where(condition: Column, a: Column | float, b: Column | float) -> Column:
        a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
        return F.when(condition, a).otherwise(b)

    @staticmethod
    def divide(a: Column, b: Column, otherwise: float) -> Column:
        """a / b, or a value where b is 0."""
        return ratio(a, b, otherwise)


class InArrays:
    """The same for numpy arrays."""

    sqrt, abs, where = staticmethod(np.sqrt), staticmethod(np.abs), staticmethod(np.where)

    @staticmethod
    def divide(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b == 0, otherwise, a / b)


@dataclass(frozen=True)
class Metric:
    """A distance: term(x, f, e, g, s) of a band (the object's flux and error, the target's) is summed over bands, and finish(x, sum) is the distance. x is InSpark or InArrays, so that one formula serves every plan."""

    term: Callable
    finish: Callable | None = None

    def column(self, bands: list[str], ref: str = "n_", target: str = "", scale: Column | None = None) -> Column:
        a = (lambda c: c) if scale is None else (lambda c: scale * c)
        out = total([self.term(InSpark, a(flux(b, ref)), a(error(b, ref)), flux(b, target), error(b, target)) for b in bands])
        return self.finish(InSpark, out) if self.finish else out

    def arrays(self, t: np.ndarray, r: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
        """[targets, objects] of t[targets, bands, 2] and r[objects, bands, 2]."""
        out = np.zeros((len(t), len(r)))
        for b in range(t.shape[1]):
            f, e = r[None, :, b, 0], r[None, :, b, 1]
            if scale is not None:
                f, e = scale * f, scale * e
            out = out + self.term(InArrays, f, e, t[:, None, b, 0], t[:, None, b, 1])
        return self.finish(InArrays, out) if self.finish else out


#: name -> builder of a distance column; register_metric adds to them.
DISTANCES: dict[str, Callable[..., Column]] = {"euclidean": euclidean, "chi2": chi2}
#: name -> metric, for those that users add. The two above have array versions of their own (operators.knn).
METRICS: dict[str, Metric] = {}


def register_metric(name: str, term: Callable, finish: Callable | None = None) -> Metric:
    """Makes a distance known to all plans of brute-force and combined search under a name."""
    if name in DISTANCES and name not in METRICS:
        raise ValueError(f"{name} is built in")
    METRICS[name] = Metric(term, finish)
    DISTANCES[name] = METRICS[name].column
    return METRICS[name]


def reddening_factor(k: float | Column, ebv: Column) -> Column:
    """What de-reddening multiplies a flux with."""
    return F.pow(F.lit(10.0), (k if isinstance(k, Column) else F.lit(float(k))) * ebv / F.lit(2.5))


def ebv_factor(correction: Column, ebv: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-0.4) * correction * ebv)


def shift_factor(c0: Column, c1: Column, shift: Column) -> Column:
    return c0 * shift * shift + c1 * shift + F.lit(1.0)
