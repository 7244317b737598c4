"""Weights of neighbours, with a fallback where all of a target's are none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.photometry import LARGEST, LEAST_WEIGHT, chi2, euclidean

#: Bits of a target's flags.
ALTERNATIVE_WEIGHT = 1
FLAGS = {"alternative_weight": ALTERNATIVE_WEIGHT}


def inverse(distance: Column) -> Column:
    return F.when(distance == 0, F.lit(LARGEST)).otherwise(1.0 / F.when(distance != 0, distance))


#: name (lower case) -> builder of a weight column from the bands of pairs; users add their own.
METHODS: dict[str, Callable[[list[str]], Column]] = {
    "euclidean": lambda bands: inverse(euclidean(bands)),
    "chi2": lambda bands: inverse(chi2(bands)),
    "likelihood": lambda bands: F.exp(F.lit(-0.5) * chi2(bands)),
}


def weighted(pairs: DataFrame, bands: list[str], method: str = "likelihood", alternative: str = "euclidean", absolute: str | None = None, flags: str = "flags") -> DataFrame:
    """Adds weight, and sets a bit of flags for targets whose weights by `method` are all below the least 32-bit float and so come by `alternative`. absolute: a column to multiply with, after that."""
    first, second = (METHODS[m.lower()](bands) for m in (method, alternative))
    rows = pairs.withColumn("_w", first)
    none = F.max("_w").over(Window.partitionBy("target_id")) < LEAST_WEIGHT
    rows = rows.withColumn("_none", F.coalesce(none, F.lit(False)))
    w = F.when(F.col("_none"), second).otherwise(F.col("_w"))
    before = F.col(flags) if flags in pairs.columns else F.lit(0)
    rows = rows.withColumn("weight", w * F.coalesce(F.col(absolute).cast("double"), F.lit(1.0)) if absolute else w)
    return rows.withColumn(flags, before.cast("int").bitwiseOR(F.when(F.col("_none"), F.lit(ALTERNATIVE_WEIGHT)).otherwise(F.lit(0)))).drop("_w", "_none")


def flag_columns(df: DataFrame, flags: str = "flags") -> DataFrame:
    """A boolean column for each flag in place of the bits."""
    return df.withColumns({f"flag_{n}": F.col(flags).bitwiseAND(F.lit(bit)) != 0 for n, bit in FLAGS.items()}).drop(flags)


def mean_photometry(pairs: DataFrame, bands: list[str], prefix: str = "n_", weight: str = "weight") -> DataFrame:
    """target_id, <band>_mean, <band>_mean_err: weighted means of neighbours' fluxes and errors; all weights count 1 where their sum is 0."""
    none = F.sum(weight) == 0
    aggs = []
    for b in bands:
        for x, name in (("f", f"{b}_mean"), ("e", f"{b}_mean_err")):
            c = F.col(f"{prefix}{x}_{b}")
            aggs.append(F.when(none, F.avg(c)).otherwise(F.try_divide(F.sum(F.col(weight) * c), F.sum(weight))).alias(name))
    return pairs.groupBy("target_id").agg(*aggs)


def neighbor_list(pairs: DataFrame) -> DataFrame:
    """target_id and arrays of ids, weights and scales in the order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "ref_id", "weight", "scale")))
    return pairs.groupBy("target_id").agg(rows.alias("_n")).select("target_id", *(F.col(f"_n.{c}").alias(n) for c, n in (("ref_id", "neighbor_ids"), ("weight", "neighbor_weights"), ("scale", "neighbor_scaling"))))
