"""Places in a global order, and uniforms that other engines draw alike."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skymatch.errors import MissingData
from skymatch.functions.random import uniform
from skymatch.operators.ordering import checked_order, numbered, out_of_order


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered(spark, parts):
    df = spark.range(500).select((F.col("id") * 37 % 503).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g")).repartition(parts)
    rows = numbered(df, [F.col("g").desc_nulls_last(), "k"], "place").collect()
    want = sorted(rows, key=lambda r: (r["g"] is None, -(r["g"] or 0), r["k"]))
    assert [r["place"] for r in want] == list(range(500))
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_hot_ranges_are_ranked_apart(spark):
    """No window holds all rows: the plan ranks inside ranges."""
    plan = numbered(spark.range(1000), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and plan.count("Window") >= 2


def test_orders_are_compared(spark):
    a = spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "k string, position long")
    b = spark.createDataFrame([(k, i) for i, k in enumerate("acbde")], "k string, position long")
    assert sorted(map(tuple, out_of_order(a, b, "k").collect())) == [(1, "b", "c"), (2, "c", "b"), (4, None, "e")]
    assert checked_order(a, a, "k") is a
    with pytest.raises(MissingData, match="at 1 "):
        checked_order(a, b, "k")


def test_uniforms(spark):
    rows = spark.range(2000).select("id", uniform(7, F.col("id"), F.lit("x")).alias("u")).collect()
    for r in rows[:50]:
        assert r["u"] == (int(hashlib.md5(f"{r['id']}:x:7".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    u = [r["u"] for r in rows]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03 and len(set(u)) == len(u)
