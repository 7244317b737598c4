"""Probability densities of targets: neighbours' densities added up, smoothed, and what is read off them.

A density is an array over a grid that all objects share. The fold over a target's neighbours keeps k arrays a target at most and explodes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.random import uniform


def grid(bins: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(b)!r}D' for b in bins)})")  # one call, however many bins


def coadded(pairs: DataFrame, densities: DataFrame, bins: list[float], weight: str = "weight") -> DataFrame:
    """target_id, pdf: sum of weights times densities over the sum of weights, clipped at 0, its trapezoid integral being 1. densities: ref_id, p."""
    rows = pairs.select("target_id", "rank", "ref_id", weight).join(densities.select("ref_id", "p"), "ref_id")
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col(weight).alias("w"), "p")))
    n, z = len(bins), grid(bins)

    def fold(part: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), n)
        added = F.aggregate(part, zero, lambda s, x: F.zip_with(s, x["p"], lambda a, b: a + x["w"] * b))
        return A.bind(F.aggregate(part, F.lit(0.0), lambda s, x: s + x["w"]), lambda w: F.transform(added, lambda v: F.greatest(F.when(w != 0, v / F.when(w != 0, w)).otherwise(F.lit(0.0)), F.lit(0.0))))

    def normal(p: Column) -> Column:
        return A.bind(A.trapezoid(p, z), lambda area: F.transform(p, lambda v: F.when(area > 0, v / F.when(area > 0, area)).otherwise(F.lit(0.0))))

    return rows.groupBy("target_id").agg(parts.alias("_parts")).select("target_id", A.bind(fold(F.col("_parts")), normal).alias("pdf"))


def smoothed(df: DataFrame, bins: list[float], bandwidth: float | None = None, pdf: str = "pdf", keep_kernel: bool = False) -> DataFrame:
    """pdf convolved with a Gaussian of that bandwidth, by default Silverman's. It isn't normalised again. keep_kernel: also the kernel, of odd length."""
    z = grid(bins)

    def convolved(p: Column) -> Column:
        width = F.lit(float(bandwidth)) if bandwidth else A.silverman(p, z)
        return A.bind(width, lambda w: A.bind(A.gaussian(z, w), lambda k: F.struct(A.smoothed(p, k).alias("p"), k.alias("kernel"), w.alias("width"))))

    rows = df.withColumn("_s", A.bind(F.col(pdf), convolved)).withColumn(pdf, F.col("_s.p"))
    return rows.withColumns({f"{pdf}_kernel": F.col("_s.kernel"), f"{pdf}_bandwidth": F.col("_s.width")}).drop("_s") if keep_kernel else rows.drop("_s")


def on_grid(f, z: Column):
    return lambda p: f(p, z)


def point_estimates(df: DataFrame, bins: list[float], which: list[str], pdf: str = "pdf") -> DataFrame:
    z = grid(bins)
    made = {"mean": A.mean, "mode": A.mode, "median": lambda y, x: A.quantile(y, x, 0.5)}
    return df.withColumns({f"{pdf}_{w}": A.bind(F.col(pdf), on_grid(made[w], z)) for w in which})


def quantiles(df: DataFrame, bins: list[float], qs: list[float], pdf: str = "pdf") -> DataFrame:
    """<pdf>_quantiles, an array. The list of quantiles goes into the column's metadata."""
    z = grid(bins)
    return df.withColumn(f"{pdf}_quantiles", A.bind(F.col(pdf), lambda p: F.array(*(A.quantile(p, z, q) for q in qs)))).withMetadata(f"{pdf}_quantiles", {"quantiles": list(qs)})


def samples(df: DataFrame, bins: list[float], n: int, seed: int = 0, pdf: str = "pdf") -> DataFrame:
    """<pdf>_mc, n draws by the inverse distribution; draws hang on target_id and seed only."""
    z = grid(bins)
    draw = lambda i: uniform(seed, F.col("target_id"), i)
    return df.withColumn(f"{pdf}_mc", A.bind(F.col(pdf), lambda p: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: A.quantile(p, z, draw(i)))))
