"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import correction, densities, extinction, knn, montecarlo, weights
from ..operators.kdindex import KdIndex
from ..operators.knn import Search
from ..operators.ordering import numbered, out_of_order
from ..operators.scaling import Prior
from ..sources import catalog, sample
from ..sources.scratch import folder
from ..streaming.neighbors import stream_neighbors, write_indexed_neighbors
from . import oracle as O
from . import run as R
from . import views as V
from .config import Config
from .views import BANDS, BINS, SAMPLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- catalogues


def _embedding_catalog(spark: SparkSession, sf: str, rows: str = "vec_id % 5 = 0", **how) -> DataFrame:
    e = V.table(spark, sf, "embeddings").where(rows)
    f0 = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("embedding")[0].cast("double"))
    f1 = F.when(F.col("vec_id") % 7 == 1, F.lit(-99.0)).otherwise(F.col("embedding")[1].cast("double"))
    rows = e.select("vec_id", f0.alias("flux_0"), f1.alias("flux_1"), F.col("embedding")[2].cast("double").alias("flux_2"), F.lit(0.5).alias("err"))
    c = catalog.TargetCatalog("", {"b0": ("flux_0", "err"), "b1": ("flux_1", "err"), "b2": ("flux_2", "err")}, "vec_id", **how)
    out = catalog.prepared(rows, c)
    return out.drop(*[x for x in out.columns if x.startswith("in_")])


@query("""SELECT vec_id AS target_id, round(CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE 1e3 * CAST(embedding[1] AS DOUBLE) END, 6) + 0e0 AS f_b0, CASE WHEN vec_id % 3 = 0 THEN CAST('inf' AS DOUBLE) ELSE 5e2 END AS e_b0,
round(CASE WHEN vec_id % 7 = 1 THEN 0e0 ELSE 1e3 * CAST(embedding[2] AS DOUBLE) END, 6) + 0e0 AS f_b1, CASE WHEN vec_id % 7 = 1 THEN CAST('inf' AS DOUBLE) ELSE 5e2 END AS e_b1,
round(1e3 * CAST(embedding[3] AS DOUBLE), 6) + 0e0 AS f_b2, 5e2 AS e_b2 FROM embeddings WHERE vec_id % 5 = 0""")
def catalog_scan_missing(spark, sf):
    return rounded(_embedding_catalog(spark, sf, missing=(-99.0,), unit="mJy"), "f_b0", "f_b1", "f_b2")


@query("SELECT vec_id AS target_id, round(CAST(embedding[3] AS DOUBLE), 6) + 0e0 AS f_b2, 5e-1 AS e_b2, round(CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE CAST(embedding[1] AS DOUBLE) END, 6) + 0e0 AS f_b0, CASE WHEN vec_id % 3 = 0 THEN CAST('inf' AS DOUBLE) ELSE 5e-1 END AS e_b0 FROM embeddings WHERE vec_id % 5 = 0")
def band_subset(spark, sf):
    return rounded(_embedding_catalog(spark, sf, enabled="b2;b[0]"), "f_b0", "f_b2")


@query(ORACLE_SQL["catalog_scan_missing"].removesuffix(" WHERE vec_id % 5 = 0"))
def catalog_scan_missing_all(spark, sf):
    return rounded(_embedding_catalog(spark, sf, "true", missing=(-99.0,), unit="mJy"), "f_b0", "f_b1", "f_b2")


@query(ORACLE_SQL["band_subset"].removesuffix(" WHERE vec_id % 5 = 0"))
def band_subset_all(spark, sf):
    return rounded(_embedding_catalog(spark, sf, "true", enabled="b2;b[0]"), "f_b0", "f_b2")


@query("SELECT vec_id AS target_id, round(CAST(embedding[3] AS DOUBLE), 6) + 0e0 AS f_b2, 5e-1 AS e_b2 FROM embeddings WHERE vec_id % 5 = 0 ORDER BY vec_id LIMIT 25")
def input_limit(spark, sf):
    return rounded(_embedding_catalog(spark, sf, enabled="b2", limit=25), "f_b2")


@query("SELECT vec_id AS target_id, round(CAST(embedding[1] AS DOUBLE) * 1018e-3, 6) + 0e0 AS ebv, round(CAST(embedding[2] AS DOUBLE), 6) + 0e0 AS shift_b2, vec_id AS in_vec_id FROM embeddings")
def colorspace_columns(spark, sf):
    """Dust and filter shifts of targets by the columns that are named, and an input column that is copied."""
    rows = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[2].alias("flux"), F.lit(1.0).alias("err"), F.col("embedding")[0].cast("double").alias("dust"), F.col("embedding")[1].cast("double").alias("shift"))
    out = catalog.prepared(rows, catalog.TargetCatalog("", {"b2": ("flux", "err")}, "vec_id", ebv="dust", shifts={"b2": "shift"}))
    return rounded(out.select("target_id", "ebv", F.col("shifts.b2").alias("shift_b2"), "in_vec_id"), "ebv", "shift_b2")


@query(f"{O.BASE} SELECT target_id, {O.dereddened()} FROM targets")
def colorspace_deredden(spark, sf):
    out = correction.dereddened(V.coloured_targets(spark, sf), V.COEFFICIENTS)
    return rounded(out, *(f"f_{b}" for b in BANDS)).select("target_id", *(f"f_{b}" for b in BANDS))


@query(f"{O.BASE} SELECT target_id, " + ", ".join(O.r(f"f_{b}", f"f_{b}") for b in BANDS) + " FROM targets")
def redden_roundtrip(spark, sf):
    out = correction.reddened(correction.dereddened(V.coloured_targets(spark, sf), V.COEFFICIENTS), V.COEFFICIENTS)
    return rounded(out, *(f"f_{b}" for b in BANDS)).select("target_id", *(f"f_{b}" for b in BANDS))


# ---- neighbours


def _ccm89(wl: str) -> str:
    """The law of operators.extinction between 3031 and 9090 angstrom."""
    powers = lambda c: " + ".join(f"({v!r}e0) * pow(1e4 / {wl} - 182e-2, {i})" for i, v in enumerate(c))
    return f"(31e-1 * ({powers(extinction.OPTICAL_A)}) + {powers(extinction.OPTICAL_B)})"


@query(
    f"{O.BASE}, g AS (SELECT 3100 + 50 * i AS wl, {_ccm89('(31e2 + 5e1 * i)')} AS a FROM range(0, 85) r(i)), "
    "s AS (SELECT ref_id, wl, a, least(CAST(floor((wl - 3000) / 15e2) AS BIGINT), 2) AS i FROM refs CROSS JOIN g), "
    "f AS (SELECT ref_id, wl, a, (1 + (ref_id + i) % 5) + ((ref_id + i + 1) % 5 - (ref_id + i) % 5) * (wl - 3000 - 1500 * i) / 15e2 AS f FROM s), "
    "p AS (SELECT ref_id, b, wl, f * greatest(0e0, 1e0 - abs(wl - 4000 - 1000 * b) / 5e2) AS y, a FROM f CROSS JOIN range(0, 3) r(b)), "
    "q AS (SELECT ref_id, b, wl, y, y * pow(1e1, -8e-3 * a) AS d FROM p), "
    "t AS (SELECT ref_id, b, (y + lag(y) OVER o) / 2e0 * 5e1 AS y, (d + lag(d) OVER o) / 2e0 * 5e1 AS d FROM q WINDOW o AS (PARTITION BY ref_id, b ORDER BY wl)) "
    f"SELECT ref_id AS sed, 'b' || b AS band, {O.r('-25e-1 / 2e-2 * log10(sum(d) / sum(y))', 'k')} FROM t GROUP BY ref_id, b"
)
def band_coefficients(spark, sf):
    """How each object's spectrum dims in three bands under a published law."""
    knots = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.lit(1.0) + (F.col("ref_id") + i) % 5).cast("double"))).alias("i", "f")
    seds = V.refs(spark, sf).select(F.col("ref_id").alias("sed"), knots).select("sed", (F.lit(3000.0) + F.col("i") * F.lit(1500.0)).alias("wl"), "f")
    bands = spark.createDataFrame([(f"b{b}", 4000.0 + 1000 * b + d, t) for b in range(3) for d, t in ((-500.0, 0.0), (0.0, 1.0), (500.0, 0.0))], "band string, wl double, tr double")
    return rounded(extinction.band_coefficients(seds, bands, extinction.law(spark, 3100, 7300, 50)), "k")


def _found(spark: SparkSession, sf: str, search: Search, refs=V.refs, plan: str = "auto") -> DataFrame:
    return knn.neighbors(V.targets(spark, sf), refs(spark, sf), BANDS, search, plan)


def _kept_index(spark: SparkSession, sf: str, search: Search) -> DataFrame:
    """Neighbours by an index that is stored first and then opened again."""
    path = folder(spark)
    KdIndex.fit(V.refs(spark, sf), BANDS, path, search.leaf_rows)
    return KdIndex.open(spark, path).query(V.targets(spark, sf), search)


def _long(df: DataFrame) -> DataFrame:
    return rounded(df, "distance", "scale")


_KNN = {
    "knn_chi2": (Search(K), f"{O.BASE}, {O.knn()} {O.LONG}"),
    "knn_euclidean": (Search(K, "euclidean"), f"{O.BASE}, {O.knn(O.euclidean())} {O.LONG}"),
    "knn_kdtree": (Search(K, method="kdtree", leaf_rows=64), f"{O.BASE}, {O.knn(O.euclidean())} {O.LONG}"),
    "knn_combined": (Search(K, method="combined", batch=40, leaf_rows=64), f"{O.BASE}, near AS (SELECT * FROM (SELECT t.target_id, r.ref_id, row_number() OVER (PARTITION BY t.target_id ORDER BY {O.euclidean()}, r.ref_id) AS n FROM targets t CROSS JOIN refs r) WHERE n <= 40), {O.knn(source='near JOIN targets t ON t.target_id = near.target_id JOIN refs r ON r.ref_id = near.ref_id')} {O.LONG}"),
    "knn_scaled_delta": (Search(K, prior=Prior.parse("delta 1.5")), f"{O.BASE}, {O.knn(O.chi2('15e-1'), scale='15e-1')} {O.LONG}"),
}
for _name, (_search, _sql) in _KNN.items():
    query(_sql, _name)(lambda spark, sf, s=_search: _long(_found(spark, sf, s)))
    if _search.method != "brute":
        query(_sql, f"{_name}_index")(lambda spark, sf, s=_search: _long(_kept_index(spark, sf, s)))
    query(_sql, f"{_name}_blocks")(lambda spark, sf, s=_search: _long(_found(spark, sf, s, plan="blocks")))

_BEST = "(" + " + ".join(f"r.f_{b} * t.f_{b} / (t.e_{b} * t.e_{b})" for b in BANDS) + ") / (" + " + ".join(f"r.f_{b} * r.f_{b} / (t.e_{b} * t.e_{b})" for b in BANDS) + ")"
_SCALED = f"{O.BASE}, scaled AS (SELECT t.target_id AS tid, r.ref_id AS rid, {{best}} AS s FROM targets t CROSS JOIN refs r), {O.knn(' + '.join(f'(sc.s * r.f_{b} - t.f_{b}) * (sc.s * r.f_{b} - t.f_{b}) / (t.e_{b} * t.e_{b})' for b in BANDS), scale='sc.s', source='scaled sc JOIN targets t ON t.target_id = sc.tid JOIN refs r ON r.ref_id = sc.rid')} {O.LONG}"


@query(_SCALED.format(best=_BEST))
def knn_scaled_uniform_noerr(spark, sf):
    return _long(_found(spark, sf, Search(K, prior=Prior.parse("uniform")), V.exact_refs, "blocks"))


@query(_SCALED.format(best=f"greatest(least({_BEST}, 2e0), 5e-1)"))
def knn_scaled_tophat(spark, sf):
    return _long(_found(spark, sf, Search(K, prior=Prior.parse("tophat 0.5 2")), V.exact_refs, "blocks"))


def _slope(a: str) -> str:
    """The derivative of half the chi-squared of fluxes times a."""
    parts = []
    for b in BANDS:
        n, v = f"({a} * r.f_{b} - t.f_{b})", f"(({a} * r.e_{b}) * ({a} * r.e_{b}) + t.e_{b} * t.e_{b})"
        parts.append(f"r.f_{b} * {n} / {v} - {a} * r.e_{b} * r.e_{b} * {n} * {n} / ({v} * {v})")
    return " + ".join(parts)


_SECANT = (
    f"{O.BASE}, guess AS (SELECT t.target_id AS tid, r.ref_id AS rid, {_BEST} AS x FROM targets t CROSS JOIN refs r), "
    f"it AS (SELECT tid, rid, 0 AS n, x - 1e-4 AS x0, x AS x1, {_slope('(x - 1e-4)')} AS y0, {_slope('x')} AS y1, true AS going FROM guess JOIN targets t ON t.target_id = tid JOIN refs r ON r.ref_id = rid "
    f"UNION ALL SELECT tid, rid, n + 1, x1, x2, y1, {_slope('x2')}, abs(x1 - x2) > 1e-8 * abs(x2) FROM (SELECT *, x1 - CASE WHEN y1 = y0 THEN 0e0 ELSE y1 * (x1 - x0) / (y1 - y0) END AS x2 FROM it WHERE going AND n < 20) "
    "JOIN targets t ON t.target_id = tid JOIN refs r ON r.ref_id = rid), scaled AS (SELECT tid, rid, arg_max(x1, n) AS s FROM it GROUP BY tid, rid), "
    f"{O.knn(O.chi2('sc.s'), scale='sc.s', source='scaled sc JOIN targets t ON t.target_id = sc.tid JOIN refs r ON r.ref_id = sc.rid')} "
    f"SELECT target_id, CAST(rank AS INT) AS rank, ref_id, {O.r('distance', 'distance')}, round(scale / (1e0 + abs(scale)), 4) AS squashed_scale FROM knn"
)


def _squashed(df: DataFrame) -> DataFrame:
    """Large scales are known to a relative error only, so engines agree on scale / (1 + |scale|)."""
    return rounded(df, "distance").select("target_id", "rank", "ref_id", "distance", F.round(F.col("scale") / (F.lit(1.0) + F.abs("scale")), 4).alias("squashed_scale"))


@query(_SECANT)
def knn_scaled_uniform(spark, sf):
    return _squashed(_found(spark, sf, Search(K, prior=Prior.parse("uniform")), plan="blocks"))


@query(_SECANT)
def knn_scaled_uniform_join(spark, sf):
    """The same by a join of the pairs that may come near, whose scales are solved in Arrow batches."""
    return _squashed(_found(spark, sf, Search(K, prior=Prior.parse("uniform")), plan="join"))


def _bulk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = V.bulk_photometry(spark, sf)
    return rows.withColumnRenamed("l_orderkey", "target_id"), rows.where("l_orderkey % 20 = 0").withColumnRenamed("l_orderkey", "ref_id")


_BULK = ["b0", "b1", "b2", "b3"]


@query(
    "WITH g AS (SELECT l_orderkey AS id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e6 AS f_b0, sum(CAST(round(l_quantity) AS BIGINT)) / 1e1 AS f_b1, CAST(count(*) AS DOUBLE) AS f_b2, sum(l_partkey % 97) / 1e1 AS f_b3 FROM lineitem GROUP BY l_orderkey), "
    "p AS (SELECT *, " + ", ".join(f"1e-1 + 5e-2 * abs(f_{b}) AS e_{b}" for b in _BULK) + " FROM g), "
    "k AS (SELECT t.id AS target_id, r.id AS ref_id, " + " + ".join(f"(r.f_{b} - t.f_{b}) * (r.f_{b} - t.f_{b}) / (r.e_{b} * r.e_{b} + t.e_{b} * t.e_{b})" for b in _BULK) + " AS d FROM p t CROSS JOIN p r WHERE r.id % 20 = 0) "
    "SELECT target_id, CAST(rank AS INT) AS rank, ref_id, round(d, 6) + 0e0 AS distance, 1e0 AS scale FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, ref_id) AS rank FROM k) WHERE rank <= 5"
)
def knn_bulk(spark, sf):
    t, r = _bulk(spark, sf)
    return rounded(knn.neighbors(t, r, _BULK, Search(5), "blocks", 2 * spark.sparkContext.defaultParallelism), "distance")


@query(
    "WITH g AS (SELECT l_orderkey AS id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e6 AS f_b0, sum(CAST(round(l_quantity) AS BIGINT)) / 1e1 AS f_b1, CAST(count(*) AS DOUBLE) AS f_b2, sum(l_partkey % 97) / 1e1 AS f_b3 FROM lineitem GROUP BY l_orderkey), "
    "p AS (SELECT *, " + ", ".join(f"1e-1 + 5e-2 * abs(f_{b}) AS e_{b}" for b in _BULK) + " FROM g), "
    "k AS (SELECT t.id AS target_id, r.id AS ref_id, " + " + ".join(f"(r.f_{b} - t.f_{b}) * (r.f_{b} - t.f_{b}) / (r.e_{b} * r.e_{b} + t.e_{b} * t.e_{b})" for b in _BULK) + " AS d FROM p t CROSS JOIN p r WHERE t.id % 50 = 0) "
    "SELECT target_id, CAST(rank AS INT) AS rank, ref_id, round(d, 6) + 0e0 AS distance, 1e0 AS scale FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, ref_id) AS rank FROM k) WHERE rank <= 5"
)
def knn_bulk_all(spark, sf):
    """Against all orders; targets are those whose id is divisible by 50."""
    rows = V.bulk_photometry(spark, sf)
    t, r = rows.where("l_orderkey % 50 = 0").withColumnRenamed("l_orderkey", "target_id"), rows.withColumnRenamed("l_orderkey", "ref_id")
    return rounded(knn.neighbors(t, r, _BULK, Search(5), "blocks", 2 * spark.sparkContext.defaultParallelism), "distance")


@query(_KNN["knn_chi2"][1])
def stream_knn(spark, sf):
    """Targets of a stream, run to its end."""
    t = V.table(spark, sf, "embeddings")
    stream = V.photometry(spark.readStream.schema(t.schema).parquet(f"{sf}/embeddings*.parquet").where("vec_id % 5 = 0"), "target_id")
    path = folder(spark)
    q = stream_neighbors(stream, V.refs(spark, sf), BANDS, Search(K)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return _long(spark.read.schema(knn.RESULT).parquet(f"{path}/out"))


@query(_KNN["knn_combined"][1])
def stream_knn_index(spark, sf):
    """Targets of a stream against a stored index, two looks a micro-batch."""
    path, schema = folder(spark), V.table(spark, sf, "embeddings").schema
    index = KdIndex.fit(V.refs(spark, sf), BANDS, f"{path}/index", 64)
    stream = V.photometry(spark.readStream.schema(schema).parquet(f"{sf}/embeddings*.parquet").where("vec_id % 5 = 0"), "target_id")
    write_indexed_neighbors(stream, index, _KNN["knn_combined"][0], f"{path}/out", f"{path}/state", availableNow=True).awaitTermination()
    return _long(spark.read.schema(knn.RESULT).parquet(f"{path}/out").drop("batch"))


def _pairs(spark: SparkSession, sf: str, targets=V.targets, refs=V.refs) -> DataFrame:
    found = knn.neighbors(V.targets(spark, sf), V.refs(spark, sf), BANDS, Search(K))
    return knn.with_photometry(found, targets(spark, sf), refs(spark, sf), BANDS)


# ---- corrections and weights

_N = ", ".join(f"n_f_{b}, n_e_{b}" for b in BANDS)
_NCOLS = [f"n_{x}_{b}" for b in BANDS for x in "fe"]


@query(f"{O.BASE}, {O.knn()} SELECT k.target_id, k.ref_id, " + ", ".join(O.r(f"r.{x}_{b} * pow(1e1, -4e-1 * r.ebv_{b} * t.ebv)", f"n_{x}_{b}") for b in BANDS for x in "fe") + " FROM knn k JOIN targets t ON t.target_id = k.target_id JOIN refs r ON r.ref_id = k.ref_id")
def correct_ebv(spark, sf):
    out = correction.projected(_pairs(spark, sf, V.coloured_targets, V.corrected_refs), BANDS, ebv="ebv")
    return rounded(out.select("target_id", "ref_id", *_NCOLS), *_NCOLS)


@query(f"{O.BASE}, {O.knn()} SELECT k.target_id, k.ref_id, " + ", ".join(O.r(f"r.{x}_{b}" + (f" * (r.c0 * t.s_{b} * t.s_{b} + r.c1 * t.s_{b} + 1e0)" if b in BANDS[:4] else ""), f"n_{x}_{b}") for b in BANDS for x in "fe") + " FROM knn k JOIN targets t ON t.target_id = k.target_id JOIN refs r ON r.ref_id = k.ref_id")
def correct_shift(spark, sf):
    out = correction.projected(_pairs(spark, sf, V.coloured_targets, V.corrected_refs), BANDS, shifts="shifts")
    return rounded(out.select("target_id", "ref_id", *_NCOLS), *_NCOLS)


def _weighted(spark, sf, **how) -> DataFrame:
    return weights.weighted(_pairs(spark, sf), BANDS, **how)


def _wsql(**how) -> str:
    return f"{O.BASE}, {O.knn()}, {O.weighted(**how)} SELECT target_id, ref_id, {O.r('weight', 'weight')}, flags FROM w"


_W = {
    "weights_euclid": (dict(method="euclidean"), _wsql(first="1e0 / {euclidean}")),
    "weights_chi2": (dict(method="chi2"), _wsql(first="1e0 / {chi2}")),
    "weights_likelihood": (dict(method="likelihood"), _wsql()),
    "weights_absolute": (dict(method="chi2", absolute="ref_weight"), _wsql(first="1e0 / {chi2}", absolute="r.weight")),
}
for _name, (_how, _sql) in _W.items():
    query(_sql, _name)(lambda spark, sf, h=_how: rounded(_weighted(spark, sf, **h), "weight").select("target_id", "ref_id", "weight", "flags"))


def _sharp(spark, sf) -> DataFrame:
    """Errors so small that likelihoods of most targets vanish."""
    pairs = _pairs(spark, sf)
    pairs = pairs.withColumns({f"{p}e_{b}": F.col(f"{p}e_{b}") / F.lit(8.0) for b in BANDS for p in ("", "n_")})
    return weights.weighted(pairs, BANDS, "likelihood")


_SHARP = f"{O.BASE}, {O.knn()}, {O.weighted(first='exp(-5e-1 * 64e0 * {chi2})')}"


@query(f"{_SHARP} SELECT target_id, ref_id, {O.r('weight', 'weight')}, flags FROM w")
def weights_fallback_flag(spark, sf):
    return rounded(_sharp(spark, sf), "weight").select("target_id", "ref_id", "weight", "flags")


@query(f"{_SHARP} SELECT DISTINCT target_id, flags = 1 AS flag_alternative_weight FROM w")
def flags_in_columns(spark, sf):
    return weights.flag_columns(_sharp(spark, sf).groupBy("target_id").agg(F.max("flags").alias("flags")))


_LIST = "SELECT target_id, CAST(rank AS INT) AS rank, ref_id, round(weight, 6) + 0e0 AS weight, scale FROM w"


@query(f"{O.WEIGHTS} {_LIST}")
def neighbor_list(spark, sf):
    """The arrays of the output, row by row."""
    out = R.ids_to_neighbors(weights.neighbor_list(_weighted(spark, sf)), V.refs(spark, sf))
    return rounded(out, "weight").select("target_id", "rank", "ref_id", "weight", "scale")


@query("WITH a AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS position FROM (SELECT DISTINCT l_orderkey FROM lineitem)) SELECT l_orderkey, position FROM a")
def order_positions(spark, sf):
    """Places of all orders in the order of their ids, found in two levels."""
    return numbered(V.table(spark, sf, "lineitem").select("l_orderkey").distinct(), ["l_orderkey"])


@query(
    "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) "
    "SELECT a.p AS position, a.o_orderkey AS \"left\", b.o_orderkey AS \"right\" FROM a JOIN b ON a.p = b.p WHERE a.o_orderkey <> b.o_orderkey"
)
def order_differences(spark, sf):
    """Where the orders by id and the orders by price aren't the same."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return out_of_order(numbered(orders, ["o_orderkey"]), numbered(orders, ["o_totalprice", "o_orderkey"]), "o_orderkey")


@query(f"{O.WEIGHTS}, ix AS (SELECT ref_id, row_number() OVER (ORDER BY ref_id) - 1 AS ref_index FROM refs) SELECT target_id, CAST(rank AS INT) AS rank, ref_index FROM w JOIN ix USING (ref_id)")
def id_patch(spark, sf):
    """Places of neighbours in the reference's order instead of their ids."""
    index = numbered(V.refs(spark, sf).select("ref_id"), ["ref_id"], "ref_index")
    return R.ids_to_neighbors(weights.neighbor_list(_weighted(spark, sf)), V.refs(spark, sf)).join(index, "ref_id").select("target_id", "rank", "ref_index")


@query(f"{O.WEIGHTS} SELECT target_id, " + ", ".join(O.r(f"sum(weight * n_{x}_{b}) / sum(weight)", f"{b}_mean{s}") for b in BANDS for x, s in (("f", ""), ("e", "_err"))) + " FROM w GROUP BY target_id")
def mean_photometry(spark, sf):
    out = weights.mean_photometry(_weighted(spark, sf), BANDS)
    return rounded(out, *out.columns[1:])


@query(f"{O.WEIGHTS} SELECT target_id, {O.r('any_value(f_b0) * sum(weight * n_f_b1 / n_f_b0) / sum(weight)', 'a_corr')}, 0e0 AS a_corr_err, {O.r('any_value(f_b2) * sum(weight * n_f_b2 / n_f_b2) / sum(weight)', 'b_corr')}, 0e0 AS b_corr_err FROM w GROUP BY target_id")
def uniform_photometry(spark, sf):
    rest = V.refs(spark, sf).select("ref_id", F.col("f_b1").alias("rest_f_b1"), F.col("f_b2").alias("rest_f_b2"))
    return rounded(correction.uniform_photometry(_weighted(spark, sf).join(rest, "ref_id"), {"a": ("b1", "b0"), "b": ("b2", "b2")}), "a_corr", "b_corr")


# ---- densities


def _pdf(spark, sf) -> DataFrame:
    return densities.coadded(_weighted(spark, sf), V.densities(spark, sf), BINS)


def _by_bin(df: DataFrame, value: str = "pdf") -> DataFrame:
    rows = df.select("target_id", F.posexplode(value).alias("pos", "p"))
    return rounded(rows.select("target_id", (F.col("pos") - 8).cast("long").alias("bin"), "p"), "p")


@query(f"{O.PDZ} SELECT target_id, bin, {O.r('p', 'p')} FROM pdf")
def pdz_coadd(spark, sf):
    return _by_bin(_pdf(spark, sf))


@query(f"{O.PDZ} SELECT target_id, {O.r('sum(zb * p) / sum(p)', 'pdf_mean')} FROM pdf GROUP BY target_id")
def pdz_mean(spark, sf):
    return rounded(densities.point_estimates(_pdf(spark, sf), BINS, ["mean"]).drop("pdf"), "pdf_mean")


@query(f"{O.PDZ}, {O.steps('pdf')} SELECT target_id, {O.r('v', 'pdf_median')} FROM ({O.quantile('5e-1')})")
def pdz_median(spark, sf):
    return rounded(densities.point_estimates(_pdf(spark, sf), BINS, ["median"]).drop("pdf"), "pdf_median")


@query(f"{O.PDZ} SELECT target_id, {O.r('first(zb ORDER BY round(p, 12) DESC, bin)', 'pdf_mode')} FROM pdf GROUP BY target_id")
def pdz_mode(spark, sf):
    tidy = _pdf(spark, sf).withColumn("pdf", F.transform("pdf", lambda v: F.round(v, 12)))
    return rounded(densities.point_estimates(tidy, BINS, ["mode"]).drop("pdf"), "pdf_mode")


_QS = (0.025, 0.25, 0.75, 0.975)


@query(f"{O.PDZ}, {O.steps('pdf')} " + " UNION ALL ".join(f"SELECT target_id, {q}e0 AS q, {O.r('v', 'v')} FROM ({O.quantile(f'{q}e0')})" for q in _QS))
def pdz_quantiles(spark, sf):
    out = densities.quantiles(_pdf(spark, sf), BINS, list(_QS))
    rows = out.select("target_id", F.posexplode("pdf_quantiles").alias("n", "v"))
    return rounded(rows.select("target_id", F.element_at(F.array(*map(F.lit, _QS)), F.col("n") + 1).alias("q"), "v"), "v")


def _smooth_sql(width: str, extra: str = "") -> str:
    return (
        f"{O.PDZ}{extra}, ker AS (SELECT x.target_id, b AS off, exp(-5e-1 * pow(b * 25e-2 / x.width, 2e0)) AS k FROM ({width}) x CROSS JOIN range(-32, 33) g(b)), "
        f"ks AS (SELECT target_id, sum(k) AS s FROM ker GROUP BY target_id) SELECT a.target_id, a.bin, {O.r('sum(b.p * ker.k) / any_value(ks.s)', 'p')} FROM pdf a JOIN pdf b ON a.target_id = b.target_id JOIN ker ON ker.target_id = a.target_id AND ker.off = a.bin - b.bin JOIN ks ON ks.target_id = a.target_id GROUP BY a.target_id, a.bin"
    )


@query(_smooth_sql("SELECT DISTINCT target_id, 6e-1 AS width FROM pdf"))
def pdz_smooth_fixed(spark, sf):
    return _by_bin(densities.smoothed(_pdf(spark, sf), BINS, 0.6))


@query(
    _smooth_sql(
        "SELECT target_id, 9e-1 * least(sqrt(var), (q3.v - q1.v) / 134e-2) * pow(n, -2e-1) AS width FROM mom JOIN q1 USING (target_id) JOIN q3 USING (target_id)",
        f", {O.steps('pdf')}, q1 AS ({O.quantile('25e-2')}), q3 AS ({O.quantile('75e-2')}), mean_ AS (SELECT target_id, sum(zb * p) / sum(p) AS m FROM pdf GROUP BY target_id), "
        "mom AS (SELECT target_id, sum((zb - m) * (zb - m) * p) / sum(p) AS var, sum(p) * sum(p) / sum(p * p) AS n FROM pdf JOIN mean_ USING (target_id) GROUP BY target_id)",
    )
)
def pdz_smooth_auto(spark, sf):
    return _by_bin(densities.smoothed(_pdf(spark, sf), BINS))


@query(
    f"{O.PDZ}, {O.steps('pdf')}, u AS (SELECT target_id, n AS draw, {uniform_sql(0, 'target_id', 'n')} AS q FROM (SELECT DISTINCT target_id FROM cdf) CROSS JOIN range(1, 51) g(n)) "
    f"SELECT u.target_id, CAST(u.draw AS INT) AS draw, {O.r('pz + (q * tot - cp) / (c - cp) * (zb - pz)', 'z')} FROM u JOIN cdf ON cdf.target_id = u.target_id AND cp <= q * tot AND q * tot < c"
)
def pdz_mc(spark, sf):
    out = densities.samples(_pdf(spark, sf), BINS, 50).select("target_id", F.posexplode("pdf_mc").alias("draw", "z"))
    return rounded(out.withColumn("draw", F.col("draw") + 1), "z")


# ---- Monte-Carlo


def _drawn(spark, sf, seed=None) -> DataFrame:
    return montecarlo.drawn(montecarlo.draws(_weighted(spark, sf), 40, SAMPLES, seed), V.samples(spark, sf), ["p1", "p2", "i1"])


_E1, _E2 = [-2.0, 0.0, 1.0, 2.5, 4.0, 6.0, 9.0, 12.0], [0.0, 1.0, 2.0, 3.0]


@query(f"{O.DRAWS} SELECT target_id, draw, {O.r('p1', 'p1')}, {O.r('p2', 'p2')}, i1 FROM drawn")
def mc_samples(spark, sf):
    cols = montecarlo.sample_columns(_drawn(spark, sf))
    rows = cols.select("target_id", F.posexplode(F.arrays_zip("mc_samples_p1", "mc_samples_p2", "mc_samples_i1")).alias("draw", "x"))
    return rounded(rows.select("target_id", F.col("draw").cast("long").alias("draw"), F.col("x.mc_samples_p1").alias("p1"), F.col("x.mc_samples_p2").alias("p2"), F.col("x.mc_samples_i1").alias("i1")), "p1", "p2")


@query(
    f"{O.DRAWS}, c AS (SELECT target_id, {O.bucket('p1', _E1)} AS bin, count(*) AS n FROM drawn GROUP BY ALL), t AS (SELECT target_id, sum(n) AS tot FROM c WHERE bin IS NOT NULL GROUP BY target_id) "
    f"SELECT a.target_id, CAST(g.b AS INT) AS bin, {O.r('coalesce(c.n, 0) / (t.tot * ' + str(_E1).replace('.0', '.0e0').replace('2.5', '2.5e0') + '[g.b + 2] - t.tot * ' + str(_E1).replace('.0', '.0e0').replace('2.5', '2.5e0') + '[g.b + 1])', 'density')} "
    f"FROM (SELECT DISTINCT target_id FROM drawn) a CROSS JOIN range(0, {len(_E1) - 1}) g(b) JOIN t ON t.target_id = a.target_id LEFT JOIN c ON c.target_id = a.target_id AND c.bin = g.b"
)
def mc_pdf1d(spark, sf):
    return rounded(montecarlo.pdf_1d(_drawn(spark, sf), "p1", _E1), "density")


@query(
    f"{O.DRAWS}, c AS (SELECT target_id, {O.bucket('p1', [-2.0, 2.0, 6.0, 10.0])} AS bx, {O.bucket('p2', _E2)} AS by_, count(*) AS n FROM drawn GROUP BY ALL), t AS (SELECT target_id, sum(n) AS tot FROM c WHERE bx IS NOT NULL AND by_ IS NOT NULL GROUP BY target_id) "
    f"SELECT a.target_id, CAST(x.b AS INT) AS bin_x, CAST(y.b AS INT) AS bin_y, {O.r('coalesce(c.n, 0) / (t.tot * 4e0)', 'density')} FROM (SELECT DISTINCT target_id FROM drawn) a CROSS JOIN range(0, 3) x(b) CROSS JOIN range(0, 3) y(b) JOIN t ON t.target_id = a.target_id LEFT JOIN c ON c.target_id = a.target_id AND c.bx = x.b AND c.by_ = y.b"
)
def mc_pdf2d(spark, sf):
    return rounded(montecarlo.pdf_2d(_drawn(spark, sf), "p1", "p2", [-2.0, 2.0, 6.0, 10.0], _E2), "density")


@query(f"{O.DRAWS} SELECT a.target_id, v.b AS value, count(d.draw) AS n FROM (SELECT DISTINCT target_id FROM drawn) a CROSS JOIN range(1, 7) v(b) LEFT JOIN drawn d ON d.target_id = a.target_id AND d.i1 = v.b GROUP BY ALL")
def mc_count(spark, sf):
    return montecarlo.count_values(_drawn(spark, sf), "i1", [1, 2, 3, 4, 5, 6])


@query(f"{O.DRAWS} SELECT target_id, {O.r('quantile_cont(p1, 0.5)', 'median')} FROM drawn GROUP BY target_id")
def mc_median(spark, sf):
    return rounded(montecarlo.medians(_drawn(spark, sf), "p1"), "median")


@query(f"{O.DRAWS} SELECT target_id, {O.r('quantile_cont(p1, 0.16)', 'low')}, {O.r('quantile_cont(p1, 0.84)', 'high')} FROM drawn GROUP BY target_id")
def mc_interval(spark, sf):
    return rounded(montecarlo.interval(_drawn(spark, sf), "p1", 68.0), "low", "high")


@query(f"{O.DRAWS} SELECT target_id, round(first(p2 ORDER BY n DESC, p2), 6) + 0e0 AS mode FROM (SELECT target_id, p2, count(*) AS n FROM drawn GROUP BY ALL) GROUP BY target_id")
def mc_mode(spark, sf):
    return rounded(montecarlo.modes(_drawn(spark, sf), "p2"), "mode")


@query(f"{O.DRAWS} SELECT a.target_id, CAST(g.b AS INT) AS slice, {O.r('coalesce(avg(d.p1), -99e0)', 'value')} FROM (SELECT DISTINCT target_id FROM drawn) a CROSS JOIN range(0, 3) g(b) LEFT JOIN drawn d ON d.target_id = a.target_id AND d.p2 >= g.b AND d.p2 < g.b + 1 GROUP BY ALL")
def mc_slice_agg(spark, sf):
    return rounded(montecarlo.slice_aggregate(_drawn(spark, sf), "p1", "p2", _E2), "value")


_DENSE = "p1 + draw * 1e-3"


@query(
    f"{O.DRAWS}, v AS (SELECT target_id, list_sort(list({_DENSE})) AS l FROM drawn GROUP BY target_id), "
    "h AS (SELECT target_id, l FROM v UNION ALL SELECT target_id, l[spot:spot + (len(l) + 1) // 2] FROM (SELECT target_id, l, list_position(gaps, list_min(gaps)) AS spot FROM (SELECT target_id, l, list_transform(range(1, (len(l) + 1) // 2), lambda i: l[i + (len(l) + 1) // 2] - l[i]) AS gaps FROM h WHERE len(l) > 3))) "
    f"SELECT target_id, {O.r('list_avg(l)', 'mode')} FROM h WHERE len(l) <= 3"
)
def mc_mode_dense(spark, sf):
    """Draws that all differ, so that the mode is that of the densest half, again and again."""
    return rounded(montecarlo.modes(_drawn(spark, sf).withColumn("v", F.col("p1") + F.col("draw") * F.lit(1e-3)), "v"), "mode")


@query(f"{O.DRAWS} SELECT a.target_id, CAST(g.b AS INT) AS slice, {O.r('coalesce(max(d.p1), -99e0)', 'highest')}, {O.r('coalesce(stddev_pop(d.p1), -99e0)', 'spread')} FROM (SELECT DISTINCT target_id FROM drawn) a CROSS JOIN range(0, 3) g(b) LEFT JOIN drawn d ON d.target_id = a.target_id AND d.p2 >= g.b AND d.p2 < g.b + 1 GROUP BY ALL")
def mc_slices_by_name(spark, sf):
    rows = _drawn(spark, sf)
    of = lambda name, as_: montecarlo.slice_aggregate(rows, "p1", "p2", _E2, montecarlo.AGGREGATES[name]).withColumnRenamed("value", as_)
    return rounded(of("max", "highest").join(of("std", "spread"), ["target_id", "slice"]), "highest", "spread")


@query(f"{O.DRAWS.replace('(g.n + 5e-1) / 4e1 * tot', uniform_sql(11, 'target_id', 'g.n') + ' * tot')} SELECT target_id, draw, {O.r('p1', 'p1')}, {O.r('p2', 'p2')}, i1 FROM drawn")
def mc_random(spark, sf):
    return rounded(_drawn(spark, sf, seed=11), "p1", "p2")


def _edges(spark, sf, column: str, n: int) -> list[float]:
    """n bins of equal width over what a column of the reference holds: two numbers come to the driver."""
    a, b = V.refs(spark, sf).agg(F.min(column), F.max(column)).first()
    return [a + (b - a) * i / n for i in range(n + 1)]


def _middle(column: str, i: str, n: int) -> str:
    return f"(SELECT (min({column}) + (max({column}) - min({column})) * {i} / {n}e0 + min({column}) + (max({column}) - min({column})) * ({i} + 1) / {n}e0) / 2e0 FROM refs)"


@query(f"{O.BASE} SELECT CAST(b AS INT) AS bin, {O.r(_middle('f_b0', 'b', 7), 'centre')} FROM range(0, 7) g(b)")
def bins_1d(spark, sf):
    return rounded(montecarlo.bin_centres(spark, _edges(spark, sf, "f_b0", 7)), "centre")


@query(f"{O.BASE} SELECT CAST(g.b AS INT) AS bin_x, {O.r(_middle('f_b0', 'g.b', 3), 'x')}, CAST(h.b AS INT) AS bin_y, {O.r(_middle('f_b1', 'h.b', 3), 'y')} FROM range(0, 3) g(b) CROSS JOIN range(0, 3) h(b)")
def bins_2d(spark, sf):
    return rounded(montecarlo.bin_centres_2d(spark, _edges(spark, sf, "f_b0", 3), _edges(spark, sf, "f_b1", 3)), "x", "y")


# ---- reference samples


def _seds(spark, sf) -> DataFrame:
    knots = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.lit(1000.0) + i * F.lit(500.0)).alias("wl"), (F.lit(1.0) + (F.col("ref_id") + i) % 5).cast("double").alias("f")))
    return V.refs(spark, sf).select("ref_id", knots.alias("knots"))


@query(f"{O.BASE} SELECT ref_id, z.z, g.i AS knot, (1e3 + g.i * 5e2) * (1e0 + z.z) AS wl, round((1e0 + (ref_id + g.i) % 5) / ((1e0 + z.z) * (1e0 + z.z)), 6) + 0e0 AS f FROM refs CROSS JOIN range(0, 4) g(i) CROSS JOIN (VALUES (0e0), (5e-1), (1e0)) z(z)")
def sed_redshift(spark, sf):
    zs = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "z double")
    rows = sample.redshifted(_seds(spark, sf), zs).select("ref_id", "z", F.posexplode("knots").alias("knot", "k"))
    return rounded(rows.select("ref_id", "z", F.col("knot").cast("long").alias("knot"), "k.wl", "k.f"), "f")


@query(f"{O.BASE}, a AS (SELECT ref_id, CAST(weight AS FLOAT) AS weight FROM refs WHERE ref_id % 2 = 0), b AS (SELECT ref_id, ref_id * 2 AS extra FROM refs WHERE ref_id % 3 = 0) SELECT coalesce(a.ref_id, b.ref_id) AS ref_id, a.weight, b.extra FROM a FULL OUTER JOIN b ON a.ref_id = b.ref_id")
def index_merge(spark, sf):
    r = V.refs(spark, sf)
    a = r.where("ref_id % 2 = 0").select("ref_id", F.col("weight").cast("float").alias("weight"))
    return sample.merge_index(a, r.where("ref_id % 3 = 0").select("ref_id", (F.col("ref_id") * 2).alias("extra")))


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def index_duplicates(spark, sf):
    return catalog.duplicates(V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query(f"{O.BASE} SELECT ref_id, CAST(weight AS FLOAT) AS weight, CASE WHEN ref_id % 2 = 0 THEN round(exp(-5e-1 * pow((0e0 - z) / 7e-1, 2e0)), 6) + 0e0 END AS p_at_0 FROM refs")
def reference_union(spark, sf):
    """A sample that imports another: objects with their weights, and data."""
    r, p = V.refs(spark, sf), V.densities(spark, sf)
    one, other = (sample.ReferenceSample.create(spark, folder(spark), {"pdz": "pdz"}) for _ in range(2))
    one.add_objects(r.where("ref_id % 2 <> 0"))
    other.add_objects(r.where("ref_id % 2 = 0"))
    other.add_data("pdz", p.where("ref_id % 2 = 0"), BINS)
    one.import_sample(other)
    return rounded(one.joined().select("ref_id", "weight", F.get("pdz.p", F.lit(8)).alias("p_at_0")), "p_at_0")


@query(f"{O.BASE} SELECT ref_id, {O.r('f_b0', 'f_b0')} FROM refs WHERE ref_id % 4 = 1 ORDER BY ref_id")
def reorder_to_ids(spark, sf):
    r = V.refs(spark, sf)
    ids = r.where("ref_id % 4 = 1").select("ref_id", F.col("ref_id").alias("position"))
    return rounded(catalog.in_order(r, ids).select("ref_id", "f_b0"), "f_b0")


@query(f"{O.BASE} SELECT ref_id, " + ", ".join(O.r(f"{x}_{b}", f"{x}_{b}") for b in BANDS[:2] for x in ("f", "e")) + f", {O.r('ebv_b0', 'ebv_b0')}, {O.r('c0', 'c0_b1')}, {O.r('c1', 'c1_b1')}, 0e0 AS c1_b0 FROM refs")
def reference_photometry(spark, sf):
    r = V.corrected_refs(spark, sf)
    table = r.select(F.col("ref_id").alias("ID"), F.col("f_b0").alias("b0"), F.col("e_b0").alias("b0_ERR"), F.col("ebv_b0").alias("b0_EBV_CORR"), F.col("f_b1").alias("b1"), F.col("e_b1").alias("b1_ERR"), F.array("c0_b1", "c1_b1").alias("b1_SHIFT_CORR"))
    cols = ["f_b0", "e_b0", "f_b1", "e_b1", "ebv_b0", "c0_b1", "c1_b1", "c1_b0"]
    return rounded(catalog.reference_photometry(table), *cols).select("ref_id", *cols)


@query(f"{O.BASE} SELECT ref_id FROM refs WHERE ref_id NOT IN (SELECT ref_id FROM refs WHERE ref_id % 3 = 0)")
def index_difference(spark, sf):
    """Objects of a sample without densities."""
    s = sample.ReferenceSample.create(spark, folder(spark), {"pdz": "pdz"})
    s.add_objects(V.refs(spark, sf).select("ref_id"))
    s.add_data("pdz", V.densities(spark, sf).where("ref_id % 3 = 0"), BINS)
    return s.lacking("pdz")


@query(
    f"{O.BASE} SELECT ref_id, CAST(1 AS FLOAT) AS weight, CASE WHEN ref_id % 2 = 0 THEN {len(BINS)} END AS n_bins, round(CASE WHEN ref_id % 2 = 0 THEN exp(-5e-1 * pow((0e0 - z) / 7e-1, 2e0)) END, 6) + 0e0 AS p_at_0, "
    f"CASE WHEN ref_id % 3 = 0 THEN {SAMPLES} END AS n_samples, round(CASE WHEN ref_id % 3 = 0 THEN z + CAST((ref_id * 7 + 13) % 41 - 20 AS DOUBLE) / 1e1 END, 6) + 0e0 AS p1_of_1 FROM refs WHERE ref_id % 2 = 0 OR ref_id % 3 = 0"
)
def reference_sample(spark, sf):
    """A sample that is written in parts, opened again, and read with all its providers side by side."""
    s = sample.ReferenceSample.create(spark, folder(spark), {"pdz": "pdz", "pp": "mc"})
    p = V.densities(spark, sf)
    s.add_data("pdz", p.where("ref_id % 4 = 0"), BINS)
    s.add_data("pdz", p.where("ref_id % 4 = 2"))
    s.add_data("pp", V.samples(spark, sf).where("ref_id % 3 = 0"))
    s.check()
    rows = sample.ReferenceSample.open(spark, s.path).joined()
    out = rows.select("ref_id", "weight", F.when(F.col("pdz").isNotNull(), F.size("pdz.p")).alias("n_bins"), F.get("pdz.p", F.lit(8)).alias("p_at_0"), F.when(F.col("pp").isNotNull(), F.size("pp.s")).alias("n_samples"), F.get("pp.s", F.lit(1))["p1"].alias("p1_of_1"))
    return rounded(out, "p_at_0", "p1_of_1")


@query(f"{O.BASE} SELECT ref_id, g.n AS sample_no, {O.r('z + CAST((ref_id * 7 + g.n * 13) % 41 - 20 AS DOUBLE) / 1e1', 'p1')}, CAST((ref_id + g.n * 5) % 8 AS INT) AS i1 FROM refs CROSS JOIN range(0, {SAMPLES}) g(n)")
def complete_sample(spark, sf):
    """Posterior samples in long form, gathered by object."""
    long = V.samples(spark, sf).select("ref_id", F.posexplode("s").alias("sample_no", "x")).select("ref_id", "sample_no", "x.p1", "x.i1")
    rows = sample.complete(long.repartition("sample_no"), ["p1", "i1"]).select("ref_id", F.posexplode("s").alias("sample_no", "x"))
    return rounded(rows.select("ref_id", F.col("sample_no").cast("long").alias("sample_no"), "x.p1", "x.i1"), "p1")


@query(f"{O.WEIGHTS} SELECT target_id, ref_id, {O.r('weight', 'weight')}, flags FROM w")
def neighbor_catalog(spark, sf):
    """Neighbours stored between the stages, each stage reading what the one before wrote."""
    path = folder(spark)
    _found(spark, sf, Search(K)).write.parquet(f"{path}/found")
    pairs = knn.with_photometry(spark.read.parquet(f"{path}/found"), V.targets(spark, sf), V.refs(spark, sf), BANDS)
    pairs.write.parquet(f"{path}/corrected")
    out = weights.weighted(spark.read.parquet(f"{path}/corrected"), BANDS, "likelihood")
    return rounded(out, "weight").select("target_id", "ref_id", "weight", "flags")


@query(f"{O.TARGETS.replace('targets AS', 'WITH RECURSIVE all_ AS', 1)}, targets AS (SELECT * REPLACE (CASE WHEN target_id % 2 = 0 THEN CAST('inf' AS DOUBLE) ELSE e_b0 END AS e_b0) FROM all_), {O.REFS}, {O.knn()} {O.LONG}")
def knn_missing_band(spark, sf):
    """Targets of which half lack a band."""
    t = V.targets(spark, sf).withColumn("e_b0", F.when(F.col("target_id") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("e_b0")))
    return _long(knn.neighbors(t, V.refs(spark, sf), BANDS, Search(K), "blocks"))


# ---- whole runs


@query(f"{O.WEIGHTS} SELECT target_id, {O.r('sum(weight * z) / sum(weight)', 'z_mean')}, count(*) AS n FROM w GROUP BY target_id")
def knn_chi2_pdz_mean(spark, sf):
    """Chi-squared neighbours, likelihood weights, weighted mean of the neighbours' label."""
    rows = _weighted(spark, sf)
    out = rows.groupBy("target_id").agg((F.sum(F.col("weight") * F.col("ref_z")) / F.sum("weight")).alias("z_mean"), F.count("*").alias("n"))
    return rounded(out, "z_mean")


CONFIG = {
    "reference_sample_phot_filters": BANDS,
    "neighbor_method": "BruteForce",
    "neighbors_no": K,
    "weight_method": "Likelihood",
    "neighbor_info_output": True,
    "flags_in_separate_columns": True,
    "pdz_kernel": "gaussian",
    "pdz_quantiles": [0.1, 0.9],
    "pdz_point_estimates": ["mean", "median", "mode"],
    "pdz_mc_samples": 10,
    "reference_sample_out_mean_phot_filters": ["b0", "b1"],
    "corrected_photometry": {"c0": ("b0", "b1")},
    "mc_samples": {"pp": ["p1"]},
    "mc_1d_pdf": {"pp": [["p1", _E1, 68]]},
    "mc_2d_pdf": {"pp": [[["p1", "p2"], _E1, _E2]]},
    "mc_count": {"pp": [["i1", [0, 1, 2, 3]]]},
    "mc_slice_aggregate": {"pp": [["p1", "p2", _E2]]},
}


@query()
def full_run(spark, sf):
    """All stages and outputs of a configured run, with reddened and shifted targets."""
    i = R.Inputs(V.coloured_targets(spark, sf), V.corrected_refs(spark, sf), V.COEFFICIENTS, V.densities(spark, sf), BINS, {"pp": V.samples(spark, sf)})
    return R.run(i, Config.parse(CONFIG))


@query(
    f"{O.BASE}, g AS (SELECT min(f_b0) AS a, max(f_b0) AS b FROM refs), k AS (SELECT DISTINCT CAST(z AS BIGINT) AS v FROM refs) "
    f"SELECT 'bins_mc_count_z' AS name, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS place, CAST(v AS DOUBLE) AS value FROM k "
    f"UNION ALL SELECT 'bins_mc_slice_aggregate_p1_f', CAST(i AS INT), {O.r('a + (b - a) * i / 4e0', 'value')} FROM g CROSS JOIN range(0, 5) r(i)"
)
def side_tables(spark, sf):
    """Grids of a run's array columns, whose values are what the reference holds."""
    refs = V.refs(spark, sf)
    values = [int(r[0]) for r in refs.select("z").distinct().orderBy("z").collect()]  # the labels
    asked = CONFIG | {"mc_count": {"pp": [["z", values]]}, "mc_slice_aggregate": {"pp": [["p1", "f", _edges(spark, sf, "f_b0", 4)]]}}
    tables = R.extension_tables(R.Inputs(V.targets(spark, sf), refs, bins=BINS), Config.parse(asked))
    parts = [tables[n].select(F.lit(n).alias("name"), F.col(tables[n].columns[-1]).cast("double").alias("value")) for n in ("bins_mc_count_z", "bins_mc_slice_aggregate_p1_f")]
    rows = parts[0].unionByName(parts[1])
    return rounded(rows.select("name", (F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1).alias("place"), "value"), "value")


@query(
    f"{O.PDZ}, m AS (SELECT target_id, sum(weight * n_f_b0) / sum(weight) AS f, sum(weight * n_e_b0) / sum(weight) AS e, count(*) AS n, max(flags) = 1 AS flag FROM w GROUP BY target_id), z AS (SELECT target_id, sum(zb * p) / sum(p) AS v FROM pdf GROUP BY target_id) "
    f"SELECT m.target_id, {O.r('f', 'b0_mean')}, {O.r('e', 'b0_mean_err')}, {O.r('v', 'pdf_mean')}, CAST(n AS INT) AS n, flag AS flag_alternative_weight FROM m JOIN z ON z.target_id = m.target_id"
)
def full_run_means(spark, sf):
    """All stages of a configured run whose outputs are all determined."""
    i = R.Inputs(V.targets(spark, sf), V.refs(spark, sf).drop("weight"), pdz=V.densities(spark, sf), bins=BINS)
    asked = {k: CONFIG[k] for k in ("reference_sample_phot_filters", "neighbor_method", "neighbors_no", "weight_method", "neighbor_info_output", "flags_in_separate_columns")}
    out = R.run(i, Config.parse(asked | {"pdz_output": False, "pdz_point_estimates": ["mean"], "reference_sample_out_mean_phot_filters": ["b0"]}))
    return rounded(out.select("target_id", "b0_mean", "b0_mean_err", "pdf_mean", F.size("neighbor_ids").alias("n"), "flag_alternative_weight"), "b0_mean", "b0_mean_err", "pdf_mean")
