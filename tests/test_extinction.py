"""The extinction law against published values, and coefficients of many spectra against those of one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.operators import extinction
from skymatch.operators.correction import band_coefficient


def test_law(spark):
    """A(V) is R_V at 5494.5 angstrom (x = 1.82), A(B) - A(V) is near 1, the bump at 2175 stands out, and pieces join."""
    a = {round(r["wl"], 2): r["a"] for r in spark.createDataFrame([(w,) for w in (1e4 / 1.82, 4400.0, 2175.0, 1900.0, 2600.0, 1e4 / 1.1001, 1e4 / 1.0999, 1e4 / 3.3001, 1e4 / 3.2999, 1e4 / 5.9001, 1e4 / 5.8999, 1200.0, 40_000.0)], "wl double").withColumn("a", extinction.ccm89(F.col("wl"))).collect()}
    assert a[5494.51] == pytest.approx(3.1) and a[4400.0] - a[5494.51] == pytest.approx(1, abs=0.1)
    assert a[2175.0] > a[1900.0] and a[2175.0] > a[2600.0] and a[1200.0] is None and a[40_000.0] is None
    for x in (1.1, 3.3, 5.9):
        assert a[round(1e4 / (x + 1e-4), 2)] == pytest.approx(a[round(1e4 / (x - 1e-4), 2)], rel=0.02)
    grid = extinction.law(spark, 3000, 4000, 100).orderBy("wl").collect()
    assert [r["wl"] for r in grid] == [3000.0 + 100 * i for i in range(11)] and all(x["a"] > y["a"] for x, y in zip(grid, grid[1:]))


def test_interpolation(spark):
    r = np.random.default_rng(3)
    curves = {k: (np.sort(r.choice(np.arange(0, 1000, 5), 12, replace=False)).astype(float), r.normal(0, 1, 12)) for k in "abc"}
    grid = np.unique(np.concatenate([np.arange(-20.0, 1020, 7), curves["a"][0]]))
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (xs, ys) in curves.items() for x, y in zip(xs, ys)], "id string, wl double, y double")
    out = extinction.interpolated(df, ["id"], "y", spark.createDataFrame([(float(g),) for g in grid], "wl double")).collect()
    assert len(out) == 3 * len(grid)
    for row in out:
        assert row["y"] == pytest.approx(np.interp(row["wl"], *curves[row["id"]], left=0, right=0), abs=1e-12)


def test_coefficients_are_those_of_one_spectrum(spark):
    r = np.random.default_rng(4)
    seds = {i: np.column_stack([np.linspace(2500, 9500, 30), r.uniform(0.1, 2, 30)]) for i in range(20)}
    bands = {"b": np.array([[3900.0, 0], [4200, 0.9], [4700, 0.8], [5000, 0]]), "r": np.array([[5500.0, 0], [6000, 1], [7000, 1], [7200, 0]]), "beyond": np.array([[12_000.0, 0], [12_500, 1], [13_000, 0]])}
    law = extinction.law(spark, 3000, 9000, 20)
    curve = np.array([(x["wl"], x["a"]) for x in law.orderBy("wl").collect()])
    s = spark.createDataFrame([(i, *map(float, k)) for i, x in seds.items() for k in x], "sed int, wl double, f double").repartition(5)
    f = spark.createDataFrame([(b, *map(float, k)) for b, x in bands.items() for k in x], "band string, wl double, tr double")
    out = {(x["sed"], x["band"]): x["k"] for x in extinction.band_coefficients(s, f, law).collect()}
    assert len(out) == 60 and all(out[i, "beyond"] is None for i in seds)
    for i in seds:
        for b in ("b", "r"):
            assert out[i, b] == pytest.approx(band_coefficient(curve, bands[b], seds[i]), rel=1e-9)
    hat = extinction.top_hats(spark, {"v": (5000, 6000)})
    k = extinction.band_coefficients(s.where("sed = 0"), hat, law).first()["k"]
    assert 2.6 < k < 3.6
