"""Monte-Carlo samples of targets: neighbours' samples drawn anew by their weights, and statistics of the draws.

Draws are made first, as (neighbour, sample number), then joined with the samples, so that only chosen samples are read. A target whose weights have no
positive finite sum draws nothing, and all its samples are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import uniform


def draws(pairs: DataFrame, n: int, samples_each: int, seed: int | None = None, weight: str = "weight") -> DataFrame:
    """target_id, draw (0 .. n - 1), ref_id, sample_no; the last two are null for targets without weight.

    The bag holds samples_each samples of each neighbour, each with the neighbour's weight. Without a seed draws are stratified: the middle of
    each n-th of the summed weights. With one they are independent, and hang on target_id, draw and seed only.
    """
    parts = F.array_sort(F.collect_list(F.struct("rank", "ref_id", F.col(weight).alias("w"))))
    rows = pairs.groupBy("target_id").agg(parts.alias("_p"))
    rows = rows.withColumn("_total", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x["w"]))
    rows = rows.withColumn("_total", F.when((F.col("_total") > 0) & (F.col("_total") < float("inf")) & ~F.isnan("_total"), F.col("_total")))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = (F.col("draw") + 0.5) / F.lit(float(n)) if seed is None else uniform(seed, F.col("target_id"), F.col("draw"))
    rows = rows.withColumn("_u", u * F.col("_total"))

    def step(s: Column, x: Column) -> Column:
        hit = s["ref"].isNull() & (F.col("_u") < s["acc"] + x["w"])
        no = F.least(F.floor((F.col("_u") - s["acc"]) / F.when(x["w"] > 0, x["w"]) * samples_each), F.lit(samples_each - 1)).cast("int")
        return F.struct((s["acc"] + x["w"]).alias("acc"), F.when(hit, x["ref_id"]).otherwise(s["ref"]).alias("ref"), F.when(hit, no).otherwise(s["no"]).alias("no"))

    start = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("long").alias("ref"), F.lit(None).cast("int").alias("no"))
    rows = rows.withColumn("_hit", F.aggregate("_p", start, step))
    return rows.select("target_id", "draw", F.col("_hit.ref").alias("ref_id"), F.col("_hit.no").alias("sample_no"))


def drawn(drawn_pairs: DataFrame, samples: DataFrame, parameters: list[str]) -> DataFrame:
    """target_id, draw and the parameters. samples: ref_id and an array of structs s. Nothing drawn gives zeros."""
    rows = drawn_pairs.join(samples.select("ref_id", "s"), "ref_id", "left").withColumn("_s", F.get("s", F.col("sample_no")))
    kinds = {f.name: f.dataType for f in samples.schema["s"].dataType.elementType}
    return rows.select("target_id", "draw", *(F.coalesce(F.col(f"_s.{p}"), F.lit(0).cast(kinds[p])).alias(p) for p in parameters))


def sample_columns(rows: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """target_id and mc_samples_<p> arrays in the order of draws; all parameters by default."""
    parameters = parameters or [c for c in rows.columns if c not in ("target_id", "draw")]
    return rows.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("draw", *parameters))).alias("_s")).select("target_id", *(F.col(f"_s.{p}").alias(f"mc_samples_{p}") for p in parameters))


def bucket(x: Column, edges: list[float]) -> Column:
    """0-based bin of x; the last bin is closed on the right; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        out = F.when((x >= lo) & ((x < hi) if i < len(edges) - 2 else (x <= hi)), F.lit(i)).otherwise(out)
    return out


def _counts(rows: DataFrame, cells: dict[str, tuple[Column, int]]) -> DataFrame:
    """target_id and counts of each cell of a grid (0 for empty ones), in long form: no group is collected."""
    counted = rows.select("target_id", *(b.alias(n) for n, (b, _) in cells.items())).groupBy("target_id", *cells).agg(F.count("*").alias("n"))
    inside = counted.where(" AND ".join(f"{n} IS NOT NULL" for n in cells))
    full = counted.select("target_id").distinct()
    for n, (_, size) in cells.items():
        full = full.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return full.join(inside, ["target_id", *cells], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pdf_1d(rows: DataFrame, parameter: str, edges: list[float]) -> DataFrame:
    """target_id, bin, density (of the samples inside the edges)."""
    c = _counts(rows, {"bin": (bucket(F.col(parameter), edges), len(edges) - 1)})
    width = F.element_at(F.array(*(F.lit(float(b) - float(a)) for a, b in zip(edges, edges[1:]))), F.col("bin") + 1)
    total = F.sum("n").over(Window.partitionBy("target_id"))
    return c.select("target_id", "bin", F.when(total > 0, F.col("n") / (F.when(total > 0, total) * width)).otherwise(0.0).alias("density"))


def pdf_2d(rows: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """target_id, bin_x, bin_y, density."""
    c = _counts(rows, {"bin_x": (bucket(F.col(x), x_edges), len(x_edges) - 1), "bin_y": (bucket(F.col(y), y_edges), len(y_edges) - 1)})
    wx = F.element_at(F.array(*(F.lit(float(b) - float(a)) for a, b in zip(x_edges, x_edges[1:]))), F.col("bin_x") + 1)
    wy = F.element_at(F.array(*(F.lit(float(b) - float(a)) for a, b in zip(y_edges, y_edges[1:]))), F.col("bin_y") + 1)
    total = F.sum("n").over(Window.partitionBy("target_id"))
    return c.select("target_id", "bin_x", "bin_y", F.when(total > 0, F.col("n") / (F.when(total > 0, total) * wx * wy)).otherwise(0.0).alias("density"))


def count_values(rows: DataFrame, parameter: str, values: list[int]) -> DataFrame:
    """target_id, value, n: how often each of the values, which follow one another, was drawn."""
    kind = dict(rows.dtypes)[parameter]
    if kind not in ("tinyint", "smallint", "int", "bigint", "boolean"):
        raise TypeError(f"{parameter} isn't an integer")
    low = sorted(values)[0]
    if sorted(values) != list(range(low, low + len(values))):
        raise ValueError("values must follow one another")
    place = F.col(parameter).cast("long") - low
    c = _counts(rows, {"bin": (F.when((place >= 0) & (place < len(values)), place.cast("int")), len(values))})
    return c.select("target_id", (F.col("bin") + low).cast("long").alias("value"), "n")


def medians(rows: DataFrame, parameter: str) -> DataFrame:
    return rows.groupBy("target_id").agg(F.percentile(parameter, F.lit(0.5)).alias("median"))


def interval(rows: DataFrame, parameter: str, percent: float) -> DataFrame:
    """target_id, low, high: the middle `percent` of the samples."""
    lo, hi = 0.5 - percent / 200, 0.5 + percent / 200
    return rows.groupBy("target_id").agg(F.percentile(parameter, F.array(F.lit(lo), F.lit(hi))).alias("_q")).select("target_id", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def half_sample_mode(x: np.ndarray) -> float:
    """Of distinct values: the shortest stretch that spans (n + 1) // 2 steps, again and again, until three or fewer values are left, whose mean it is. The first of equal ones wins; the last start isn't tried."""
    x = np.sort(x)
    while len(x) > 3:
        steps = (len(x) + 1) // 2
        i = int(np.argmin(x[steps : 2 * steps - 1] - x[: steps - 1]))
        x = x[i : i + steps + 1]
    return float(x.mean())


def modes(rows: DataFrame, parameter: str) -> DataFrame:
    """target_id, mode: the most frequent value, the least of several; where all differ the half-sample mode."""
    counted = rows.groupBy("target_id", F.col(parameter).cast("double").alias("v")).agg(F.count("*").alias("n"))
    top = counted.groupBy("target_id").agg(F.max("n").alias("most"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))

    def hsm(x: pd.Series) -> float:
        return half_sample_mode(x.to_numpy(float))

    single = rows.join(top.where("most = 1").select("target_id"), "target_id", "left_semi")
    dense = single.groupBy("target_id").agg(F.pandas_udf(hsm, "double")(F.col(parameter).cast("double")).alias("dense"))
    return top.join(dense, "target_id", "left").select("target_id", F.coalesce("dense", "mode").alias("mode"))


#: Aggregates that a slice can be given by name; users add their own: a function of a column.
AGGREGATES = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def slice_aggregate(rows: DataFrame, target: str, sliced: str, edges: list[float], aggregate=F.avg) -> DataFrame:
    """target_id, slice, value: an aggregate (built in, or a grouped pandas function) of one parameter over half-open slices of another; -99 for empty slices."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((F.col(sliced) >= float(edges[i])) & (F.col(sliced) < float(edges[i + 1])), F.lit(i)).otherwise(out)
    parts = rows.withColumn("slice", out).where("slice IS NOT NULL").groupBy("target_id", "slice").agg(aggregate(F.col(target)).alias("value"))
    full = rows.select("target_id").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return full.join(parts, ["target_id", "slice"], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(-99.0)))


def bin_centres(spark: SparkSession, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, (float(a) + float(b)) / 2) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, centre double")


def bin_centres_2d(spark: SparkSession, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """x-major."""
    x, y = bin_centres(spark, x_edges), bin_centres(spark, y_edges)
    return x.select(F.col("bin").alias("bin_x"), F.col("centre").alias("x")).crossJoin(y.select(F.col("bin").alias("bin_y"), F.col("centre").alias("y")))
