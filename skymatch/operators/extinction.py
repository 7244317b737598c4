"""Dust: a published extinction law by its formula, and coefficients of many spectra in many bands as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the law of Cardelli, Clayton and Mathis (1989): infrared, powers of x - 1.82 (optical), and ultraviolet with its rise beyond 5.9.
INFRARED = (0.574, -0.527, 1.61)
OPTICAL_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
OPTICAL_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)
ULTRAVIOLET_A = (1.752, -0.316, -0.104, 4.67, 0.341)
ULTRAVIOLET_B = (-3.090, 1.825, 1.206, 4.62, 0.263)
RISE_A, RISE_B = (-0.04473, -0.009779), (0.2130, 0.1207)


def ccm89(wavelength: Column, r_v: float = 3.1) -> Column:
    """Magnitudes of extinction for E(B-V) = 1 at a wavelength in angstrom, from 1250 to 33,333; null outside."""
    x = F.lit(1e4) / wavelength
    y = x - 1.82

    def powers(of: Column, c: tuple[float, ...]) -> Column:
        return reduce(lambda s, v: s * of + F.lit(v), reversed(c[:-1]), F.lit(c[-1]))

    def ultraviolet(c: tuple[float, ...], rise: tuple[float, float]) -> Column:
        d, u = x - c[3], x - 5.9
        return c[0] + c[1] * x + F.lit(c[2]) / (d * d + c[4]) + F.when(u > 0, u * u * (rise[0] + rise[1] * u)).otherwise(0.0)

    far = F.pow(x, F.lit(INFRARED[2]))
    a = F.when(x < 1.1, INFRARED[0] * far).when(x < 3.3, powers(y, OPTICAL_A)).otherwise(ultraviolet(ULTRAVIOLET_A, RISE_A))
    b = F.when(x < 1.1, INFRARED[1] * far).when(x < 3.3, powers(y, OPTICAL_B)).otherwise(ultraviolet(ULTRAVIOLET_B, RISE_B))
    return F.when((x >= 0.3) & (x <= 8), F.lit(r_v) * a + b)


def law(spark: SparkSession, low: float = 3000.0, high: float = 11_000.0, step: float = 10.0, r_v: float = 3.1) -> DataFrame:
    """wl, a: the law on an even grid."""
    n = int((high - low) / step) + 1
    wl = F.lit(float(low)) + F.col("id") * F.lit(float(step))
    return spark.range(n).select(wl.alias("wl")).withColumn("a", ccm89(F.col("wl"), r_v))


def top_hats(spark: SparkSession, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """band, wl, tr: filters that let everything between two wavelengths pass."""
    return spark.createDataFrame([(b, float(w), t) for b, (low, high) in bands.items() for w, t in ((low - 1, 0.0), (low, 1.0), (high, 1.0), (high + 1, 0.0))], "band string, wl double, tr double")


def interpolated(curves: DataFrame, keys: list[str], value: str, grid: DataFrame) -> DataFrame:
    """keys, wl, value of each curve (keys, wl, value) at the wavelengths of a grid (a column wl, which is sent to all tasks, so a curve's worth of rows): linear between knots, 0 outside them. Knots and grid are merged by a sort."""
    asked = curves.select(*keys).distinct().crossJoin(F.broadcast(grid.select("wl"))).withColumn("_asked", F.lit(True))
    knots = curves.select(*keys, "wl", F.lit(False).alias("_asked"), F.struct("wl", F.col(value).alias("y")).alias("_knot"))
    rows = knots.unionByName(asked.withColumn("_knot", F.lit(None).cast(knots.schema["_knot"].dataType)))
    order = Window.partitionBy(*keys).orderBy("wl", "_asked")
    a, b = F.col("_a"), F.col("_b")
    rows = rows.withColumn("_a", F.last("_knot", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_knot", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    between = a["y"] + (b["y"] - a["y"]) * (F.col("wl") - a["wl"]) / F.when(b["wl"] != a["wl"], b["wl"] - a["wl"])
    y = F.when(a["wl"] == F.col("wl"), a["y"]).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(between)
    return rows.where("_asked").select(*keys, "wl", y.alias(value))


def band_coefficients(seds: DataFrame, filters: DataFrame, extinction: DataFrame, ebv: float = 0.02) -> DataFrame:
    """sed, band, k: how much each spectrum (sed, wl, f) dims through each filter (band, wl, tr) under an extinction curve (wl, a), in magnitudes for E(B-V) = 1, measured at a small one. null where the two don't meet within the curve.

    All is put on the extinction's grid; filters and the curve are small and sent to all tasks, spectra are dealt by their id.
    """
    through = interpolated(filters, ["band"], "tr", extinction)
    seen = interpolated(seds, ["sed"], "f", extinction).join(F.broadcast(through), "wl").join(F.broadcast(extinction.select("wl", "a")), "wl")
    seen = seen.select("sed", "band", "wl", (F.col("f") * F.col("tr")).alias("whole"), (F.col("f") * F.col("tr") * F.pow(F.lit(10.0), F.lit(-0.4 * ebv) * F.col("a"))).alias("dimmed"))
    before = Window.partitionBy("sed", "band").orderBy("wl")
    strip = lambda c: (F.col(c) + F.lag(c).over(before)) / 2.0 * (F.col("wl") - F.lag("wl").over(before))
    sums = seen.select("sed", "band", strip("whole").alias("whole"), strip("dimmed").alias("dimmed")).groupBy("sed", "band").agg(F.sum("whole").alias("whole"), F.sum("dimmed").alias("dimmed"))
    ratio = F.col("dimmed") / F.when(F.col("whole") > 0, F.col("whole"))
    return sums.select("sed", "band", (F.log10(ratio) * F.lit(-2.5 / ebv)).alias("k"))
