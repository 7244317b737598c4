"""Every registered query against its SQL, and the plans of those that need no Python."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def tidy(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([tidy(r[c]) for c in cols] for r in df.collect()), key=repr)
    res = db.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(([tidy(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["target_id", "z_mean", "n"] and out.count() > 0
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["knn_chi2", "knn_combined", "weights_likelihood", "pdz_quantiles", "mc_pdf1d", "mean_photometry"])
def test_plans(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|Python|MapInArrow", plan)


@pytest.mark.parametrize("name", ["knn_kdtree_index", "knn_combined_index"])
def test_plans_of_the_index(spark, sf, name):
    """Leaves meet targets by their numbers, and the reference table is read when the index is built only."""
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_leaf" in plan and "MapInArrow" in plan and not re.search("CartesianProduct|NestedLoop", plan)
    assert not [f for f in df.inputFiles() if f.endswith("embeddings.parquet")] or name == "knn_combined_index"


@pytest.mark.parametrize("name", ["catalog_scan_missing_all", "band_subset_all"])
def test_scans_read_whole_tables(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
