"""The index, file parameters and programs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch import __main__ as programs
from skymatch.errors import MissingData, WrongFormat
from skymatch.operators import kdindex, knn, montecarlo
from skymatch.operators.knn import Search
from skymatch.plans import catalogue
from skymatch.plans import run as R
from skymatch.plans.config import Config
from skymatch.sources import sample, scratch

NEEDED = {"reference_sample_phot_filters": ["a", "b"], "neighbor_method": "KDTree", "neighbors_no": 3, "weight_method": "Euclidean"}


def rows_of(df):
    return sorted((r["target_id"], r["rank"], r["ref_id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("leaf_rows", [3, 64])
def test_index_against_all_pairs(spark, leaf_rows):
    """With ties, repeated fluxes, empty leaves, more targets than fit a tile, and fewer objects than neighbours."""
    r = np.random.default_rng(leaf_rows)
    point = lambda: [float(x) for x in np.round(r.normal(0, 1, 2), 1)]
    row = lambda i: (i, *[v for f in point() for v in (f, 0.1)])
    refs = [row(i) for i in range(300)] + [(300 + i, 0.5, 0.1, 0.5, 0.1) for i in range(40)]
    t = spark.createDataFrame([row(i) for i in range(150)], "target_id long, f_a double, e_a double, f_b double, e_b double")
    n = spark.createDataFrame(refs, "ref_id long, f_a double, e_a double, f_b double, e_b double")
    for search in (Search(5, method="kdtree", leaf_rows=leaf_rows), Search(4, method="combined", batch=30, leaf_rows=leaf_rows)):
        assert rows_of(knn.neighbors(t, n, ["a", "b"], search, "index")) == rows_of(knn.neighbors(t, n, ["a", "b"], search, "join"))
    few = n.where("ref_id < 3")
    assert rows_of(knn.neighbors(t, few, ["a", "b"], Search(5, method="kdtree", leaf_rows=leaf_rows), "index")) == rows_of(knn.neighbors(t, few, ["a", "b"], Search(5, method="kdtree"), "join"))
    assert knn.neighbors(t.limit(0), n, ["a", "b"], Search(5, method="kdtree"), "index").count() == 0
    assert knn.neighbors(t, n.limit(0), ["a", "b"], Search(5, method="kdtree"), "index").count() == 0
    with pytest.raises(ValueError):
        knn.neighbors(t, n, ["a", "b"], Search(5), "index")


def test_a_kept_index_reads_no_reference(spark, tmp_path):
    """What a second query reads is the index alone, also for the chi-squared distance of the nearest."""
    r = np.random.default_rng(1)
    rows = [(i, *(float(round(x, 1)) for x in r.normal(0, 2, 2)), *map(float, r.uniform(0.1, 1, 2))) for i in range(1500)]
    spark.createDataFrame(rows, "ref_id long, f_a double, f_b double, e_a double, e_b double").write.parquet(str(tmp_path / "refs"))
    n = spark.read.parquet(str(tmp_path / "refs"))
    t = spark.createDataFrame([(i, *map(float, r.normal(0, 2, 2)), 0.5, 0.3) for i in range(200)], "target_id long, f_a double, f_b double, e_a double, e_b double")
    searches = (Search(7, method="kdtree"), Search(4, method="combined", batch=25))
    want = [rows_of(knn.neighbors(t, n, ["a", "b"], s, "join")) for s in searches]
    kdindex.KdIndex.fit(n, ["a", "b"], str(tmp_path / "index"), 50)
    (tmp_path / "refs").rename(tmp_path / "gone")
    index = kdindex.KdIndex.open(spark, str(tmp_path / "index"))
    for s, w in zip(searches, want):
        out = index.query(t, s)
        assert rows_of(out) == w
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan + "SortMergeJoin" * ("BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan)
    with pytest.raises(WrongFormat):
        index.query(t, Search(3))


def test_crowds(spark, tmp_path):
    """Equal objects that no cut parts, and a leaf that all targets fall into: blocks and tiles stay small."""
    refs = spark.range(10_000).selectExpr("id AS ref_id", "1D AS f_a", "2D AS f_b", "1D AS e_a", "1D AS e_b").unionByName(spark.range(10_000, 10_050).selectExpr("id AS ref_id", "id / 1D AS f_a", "0D AS f_b", "1D AS e_a", "1D AS e_b"))
    targets = spark.range(100_000).selectExpr("id AS target_id", "1D + id % 3 AS f_a", "2D AS f_b", "1D AS e_a", "1D AS e_b")
    index = kdindex.KdIndex.fit(refs, ["a", "b"], str(tmp_path / "index"), 500)
    leaves = index.leaves()
    assert leaves.agg(F.max(F.size("ids"))).first()[0] < 800 and leaves.agg(F.sum(F.size("ids"))).first()[0] == 10_050
    tiles = index.tiles(knn._side(targets, "target_id", ["a", "b"]), 5)
    assert tiles.agg(F.max(F.size("tids"))).first()[0] <= kdindex.TILE and tiles.agg(F.max(F.size("tids"))).first()[0] > 1000
    out = index.query(targets, Search(5, method="kdtree"))
    assert out.groupBy("rank").agg(F.count("*").alias("n"), F.min("ref_id").alias("a"), F.max("ref_id").alias("b"), F.max("distance").alias("d")).orderBy("rank").collect() == [(i + 1, 100_000, i, i, 2.0) for i in range(5)]


def test_trees(spark):
    """Down the tree, the leaves within a limit are those of whose bounds that is true."""
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (3000, 3))
    tree = kdindex.Tree.split(x[:500], 6)
    leaf = tree.leaf(x)
    tree.filled([(int(j), int((leaf == j).sum()), x[leaf == j].min(0).tolist(), x[leaf == j].max(0).tolist()) for j in np.unique(leaf)], 10)
    tree = kdindex.Tree.loaded(tree.dumped())
    assert tree.size[0] == 3000 and (tree.low[0] == x.min(0)).all() and (tree.blocks >= 1).all()
    t, limit = r.normal(0, 1.5, (50, 3)), r.uniform(0, 1, 50)
    near = tree.around(t, 60)
    assert (tree.size[near] >= 60).all() and (tree.size[2 * near[near < tree.inner] + 1] < 3000).all()
    row, found = tree.below(np.arange(50), np.zeros(50, np.int64), t, limit, np.full(50, -1))
    gap = np.maximum(np.maximum(tree.low[None, tree.inner :] - t[:, None], t[:, None] - tree.high[None, tree.inner :]), 0)
    want = ((gap**2).sum(2) <= limit[:, None]) & (tree.size[None, tree.inner :] > 0)
    assert sorted(zip(row.tolist(), found.tolist())) == sorted(zip(*(a.tolist() for a in np.nonzero(want))))
    one, under = tree.below(np.arange(50), near)
    row, rest = tree.below(np.arange(50), np.zeros(50, np.int64), t, np.full(50, np.inf), near)
    both = sorted([*zip(one.tolist(), under.tolist()), *zip(row.tolist(), rest.tolist())])
    assert both == sorted((i, j) for i in range(50) for j in np.flatnonzero(tree.size[tree.inner :]).tolist())


def test_index_compares_few_pairs(spark, sf):
    t, n = catalogue._bulk(spark, sf.replace("sf0.001", "sf0.01"))
    n = t.withColumnRenamed("target_id", "ref_id")
    t = scratch.stored(t.where("target_id % 7 = 0"))
    n = scratch.stored(n)
    index = kdindex.KdIndex.fit(n, catalogue._BULK, scratch.folder(spark), 128)
    assert 10 * kdindex.pairs_compared(index, t, 5) < t.count() * n.count()
    auto = knn.neighbors(t.limit(200), n, catalogue._BULK, Search(5, method="kdtree", leaf_rows=128), "index")
    assert rows_of(auto) == rows_of(knn.neighbors(t.limit(200), n, catalogue._BULK, Search(5, method="kdtree"), "blocks"))


def test_half_sample_modes():
    """Against a plain version: steps of (n + 1) // 2, whose last start isn't tried."""

    def plain(x):
        x = sorted(x)
        while len(x) > 3:
            m = (len(x) + 1) // 2
            best = min(range(m - 1), key=lambda j: (x[j + m] - x[j], j))
            x = x[best : best + m + 1]
        return sum(x) / len(x)

    assert montecarlo.half_sample_mode(np.array([0.0, 1.0, 2.0, 10.0, 10.5])) == pytest.approx(13 / 3)
    r = np.random.default_rng(3)
    for n in range(1, 60):
        x = r.normal(0, 1, n)
        assert montecarlo.half_sample_mode(x) == pytest.approx(plain(x))


def test_pairs_are_searched_once(spark, sf):
    """What the providers of a run read is stored: no nested loop is left in the plan."""
    plan = catalogue.QUERIES["full_run"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize(
    "wrong",
    [
        {"force_cpu": False}, {"redden_mean_phot": True}, {"input_size": 5}, {"target_catalog_id_column": "X"}, {"target_catalog_gal_ebv": "e"}, {"missing_photometry_flags": [-99.0]}, {"dust_map_sed_bpc": 1.0},
        {"target_catalog_filters_shifts": {"a": "s"}}, {"input_chunk_size": 4}, {"mc_slice_aggregate": {"pp": [["p", "q", [0, 1], {"x": "no such"}]]}}, {"unheard_of": 1}, {"neighbor_method": "Guess"}, {"weight_method": "Guess"},
    ],
)
def test_parameters_are_refused(wrong):
    with pytest.raises(ValueError):
        Config.parse(NEEDED | wrong)


def test_every_parameter_is_used_or_refused():
    """A value of its own for each parameter that needs another one, without that."""
    from dataclasses import fields

    from skymatch.plans import config

    other = {"target_catalog_filters": [["a", "b"]] * len(NEEDED["reference_sample_phot_filters"]), "scale_prior": "delta", "target_catalog_filters_shifts": {"a": "s"}, "missing_photometry_flags": [1.0], "reference_sample_providers": ["p"]}
    always = {"target_catalog", "force_cpu", "neighbor_catalog", "output_file", "enable_filters", "weight_method_alternative", "copy_input_columns", "neighbor_info_output", "flags_in_separate_columns", "corrected_photometry"}
    always |= {"reference_sample_out_mean_phot_filters", *(f.name for f in fields(Config) if f.name.startswith(("pdz_", "mc_")) and f.name not in config.USED_WITH)}
    assert {f.name for f in fields(Config)} == always | config.USED_WITH.keys() | {"reference_sample_phot_filters", "neighbor_method", "neighbors_no", "weight_method"}
    for name in config.USED_WITH:
        usual = next(f.default for f in fields(Config) if f.name == name)
        value = other.get(name, {str: "x", int: 7, float: 0.5, bool: not usual}.get(type(usual), "x" if name not in ("leafsize", "batch_size", "input_size", "input_chunk_size") else 7))
        method = "KDTree" if name in ("scale_prior", "batch_size") else "BruteForce"
        with pytest.raises(ValueError):
            Config.parse({k: v for k, v in NEEDED.items() if k != "batch_size"} | {"neighbor_method": method, name: value})


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A catalogue with columns of its own, photometry, a sample and curves."""
    root = str(tmp_path_factory.mktemp("files"))
    r = np.random.default_rng(0)
    targets = [(i, *map(float, r.uniform(1, 9, 2)), 0.1, 0.2, 0.05, 100.0) for i in range(20)]
    targets[3] = (3, -99.0, *targets[3][2:])
    spark.createDataFrame(targets, "SOURCE long, FA double, FB double, EA double, EB double, DUST double, SHIFT double").write.parquet(f"{root}/targets")
    refs = [(i, *map(float, r.uniform(1, 9, 2)), 0.1, 0.1, 1.1, [0.0, 1e-5]) for i in range(50)]
    spark.createDataFrame(refs, "ID long, a double, b double, a_ERR double, b_ERR double, a_EBV_CORR double, b_SHIFT_CORR array<double>").write.parquet(f"{root}/phot")
    s = sample.ReferenceSample.create(spark, f"{root}/sample", {"pdz": "pdz", "pp": "mc"})
    bins = [0.0, 1.0, 2.0, 3.0]
    s.add_objects(spark.createDataFrame([(i, 1.0 + i % 2) for i in range(50)], "ref_id long, weight double"))
    s.add_data("pdz", spark.createDataFrame([(i, [0.0, 1.0, float(i % 3), 0.0]) for i in range(50)], "ref_id long, p array<double>"), bins)
    long = spark.createDataFrame([(i, n, float(i) + n / 10, n % 3) for i in range(50) for n in range(5)], "ref_id long, sample_no int, p double, q int")
    long.write.parquet(f"{root}/posteriors")
    import os

    os.makedirs(f"{root}/curves")
    for band, middle in (("a", 5000), ("b", 6000)):
        with open(f"{root}/curves/{band}.dat", "w") as f:
            f.write("\n".join(f"{middle + d} {1 if abs(d) < 200 else 0}" for d in range(-400, 401, 100)))
    for name, value in (("dust", lambda x: x / 2000), ("sed", lambda x: 1.0)):
        with open(f"{root}/{name}.txt", "w") as f:
            f.write("# two columns\n" + "\n".join(f"{x} {value(x)}" for x in range(4000, 8000, 50)))
    values = NEEDED | {
        "target_catalog": f"{root}/targets", "target_catalog_id_column": "SOURCE", "target_catalog_filters": [["FA", "EA"], ["FB", "EB"]], "missing_photometry_flags": [-99.0], "reference_sample_dir": f"{root}/sample",
        "reference_sample_phot_file": f"{root}/phot", "neighbor_info_output": True, "pdz_point_estimates": ["mean"], "reference_sample_out_mean_phot_filters": ["a"], "leafsize": 8, "neighbor_catalog": f"{root}/neighbors",
    }
    return root, values


def test_inputs_of_a_configuration(spark, files):
    root, values = files
    i = R.Inputs.from_config(spark, Config.parse(values))
    assert {"target_id", "f_a", "e_a", "f_b", "e_b", "in_DUST"} <= set(i.targets.columns) and "ebv" not in i.targets.columns
    assert i.targets.where("target_id = 3").first()["e_a"] == float("inf") and i.targets.count() == 20
    assert i.bins == [0.0, 1.0, 2.0, 3.0] and i.pdz.count() == 50 and i.refs.agg(F.max("weight")).first()[0] == 2
    assert R.files(spark, Config.parse(values | {"input_size": 4})).targets.count() == 4
    assert R.files(spark, Config.parse(values | {"input_chunk_size": 6})).targets.rdd.getNumPartitions() == 4
    assert R.files(spark, Config.parse(values | {"reference_sample_providers": []})).pdz is None
    assert "f_b" not in R.files(spark, Config.parse(values | {"enable_filters": "a"})).targets.columns
    assert R.files(spark, Config.parse(values | {"target_catalog_unit": "mJy"})).targets.where("target_id = 5").first()["e_a"] == pytest.approx(100)
    dusty = {"target_catalog_gal_ebv": "DUST", "target_catalog_filters_shifts": {"b": "SHIFT"}}
    with pytest.raises(MissingData):
        R.files(spark, Config.parse(values | dusty))
    dusty |= {"galactic_curve": f"{root}/dust.txt", "galactic_sed": f"{root}/sed.txt", "filters_dir": f"{root}/curves"}
    i = R.files(spark, Config.parse(values | dusty | {"dust_map_sed_bpc": 2.0, "redden_mean_phot": True}))
    row = i.targets.where("target_id = 5").first()
    assert row["ebv"] == pytest.approx(0.1) and row["shifts"]["b"] == 100 and 2.4 < i.coefficients["a"] < 2.6 < i.coefficients["b"] < 3.1
    with pytest.raises(MissingData):
        R.files(spark, Config.parse(NEEDED))


def test_programs(spark, files):
    """The stages one by one give what all in one give."""
    root, values = files
    with open(f"{root}/config.json", "w") as f:
        json.dump(values, f)
    config = ["--config", f"{root}/config.json"]
    programs.main(["complete", "--reference_sample_dir", f"{root}/sample", "--posteriors", f"{root}/posteriors", "--parameters", '["p", "q"]', "--provider=pp"], spark)
    mc = ["--mc_slice_aggregate", json.dumps({"pp": [["p", "q", [0, 1, 3], {"MAX": "max", "MEAN": "mean"}]]}), "--mc_pdf_take_n", "20"]
    for stage in ("neighbors", "correct", "weights"):
        programs.main([stage, *config], spark)
    programs.main(["output", *config, *mc, f"--output_file={root}/out"], spark)
    programs.main(["run", *config, *mc, "--output_file", f"{root}/all"], spark)
    one, other = (spark.read.parquet(f"{root}/{n}/catalog") for n in ("out", "all"))
    assert one.columns == other.columns and {"pdf", "pdf_mean", "a_mean", "neighbor_ids", "mc_slice_aggregate_p_q_MAX", "mc_slice_aggregate_p_q_MEAN"} <= set(one.columns)
    flat = lambda df: sorted([float(v) for x in r for v in (x if isinstance(x, list) else [x])] for r in df.collect())
    assert one.count() == 20 and all(np.allclose(a, b) for a, b in zip(flat(one), flat(other), strict=True))
    assert spark.read.parquet(f"{root}/out/bins_mc_slice_aggregate_p_q_MAX").count() == 3
    assert all(a >= b for r in one.collect() for a, b in zip(r["mc_slice_aggregate_p_q_MAX"], r["mc_slice_aggregate_p_q_MEAN"]))
    with pytest.raises(SystemExit):
        programs.main(["dance"], spark)
    with pytest.raises(SystemExit):
        programs.main(["run", *config], spark)


def test_fits_output(spark, files):
    """One file: the catalogue with its keywords, and a table for each grid; it reads back as the Parquet output does."""
    from skymatch.sources.fits import read_fits, read_header

    root, values = files
    config = Config.parse(values | {"pdz_quantiles": [0.1, 0.5], "output_file": f"{root}/fits", "output_format": "fits"})
    i = R.files(spark, config)
    out, side = scratch.stored(R.run(i, config)), R.extension_tables(i, config)
    R.write(out, side, f"{root}/as_fits", "fits", R.headers(config))
    R.write(out, side, f"{root}/as_parquet")
    head = read_header(f"{root}/as_fits/catalog.fits", "CATALOG")
    assert head["PDFQUAN"] == "0.1 0.5" and head["COMMENT"] and int(head["NAXIS2"]) == 20
    got, want = read_fits(spark, f"{root}/as_fits/catalog.fits", "CATALOG"), spark.read.parquet(f"{root}/as_parquet/catalog")
    assert got.columns == want.columns
    flat = lambda df: sorted([float(v) for x in r for v in (x if isinstance(x, list) else [x])] for r in df.collect())
    assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(flat(got), flat(want), strict=True))
    bins = read_fits(spark, f"{root}/as_fits/catalog.fits", "BINS_PDF")
    assert sorted(map(tuple, bins.collect())) == sorted(map(tuple, spark.read.parquet(f"{root}/as_parquet/bins_pdf").collect()))


def test_posteriors_of_files(spark, files, tmp_path):
    from skymatch.sources.fits import write_fits

    folder = tmp_path / "posteriors"
    folder.mkdir()
    for n in (1, 2):
        write_fits(spark.createDataFrame([(f"o{i}", n + i / 10.0) for i in range(3) for _ in range(4)], "OBJECT_ID string, Z double").coalesce(1), f"{folder}/s{n}.fits", single=True)
    listing = spark.createDataFrame([(f"s{1 + i % 2}.fits",) for i in range(6)], "FILE_NAME string").coalesce(1)
    write_fits(listing, f"{folder}/Index_File_posterior.fits", single=True)
    sample.ReferenceSample.create(spark, str(tmp_path / "sample"), {"pdz": "pdz"})
    programs.main(["complete", "--reference_sample_dir", str(tmp_path / "sample"), "--posterior_folder", str(folder)], spark)
    rows = sample.ReferenceSample.open(spark, str(tmp_path / "sample")).data("pp").collect()
    assert {r["ref_id"]: [x["Z"] for x in r["s"]] for r in rows} == {i: [pytest.approx(1 + i % 2 + i // 2 / 10)] * 4 for i in range(6)}


def test_photometry_and_index_must_hold_the_same(spark, files, tmp_path):
    root, values = files
    some = spark.read.parquet(f"{root}/phot")
    for n, df in enumerate((some.where("ID > 3"), some.unionByName(some.limit(1).withColumn("ID", F.lit(999).cast("long"))))):
        df.write.parquet(str(tmp_path / f"p{n}"))
        with pytest.raises(MissingData, match="different objects"):
            R.files(spark, Config.parse(values | {"reference_sample_phot_file": str(tmp_path / f"p{n}")}))


def test_folders_are_released(spark):
    path = scratch.folder(spark)
    spark.range(3).write.parquet(path)
    df = scratch.stored(spark.range(4))
    assert df.count() == 4 and scratch.release(spark) >= 2 and not scratch.FOLDERS
    import os

    assert not os.path.exists(path.removeprefix("file://"))
