"""Catalogues, filters, samples, streams, configuration and whole runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.errors import AlreadySet, DuplicateId, InvalidDimensions, MissingData, Uninitialized, WrongFormat
from skymatch.operators.knn import Search, neighbors
from skymatch.plans import catalogue, run, views
from skymatch.plans.config import Config
from skymatch.sources import catalog, filters, sample
from skymatch.sources.sample import ReferenceSample
from skymatch.streaming.neighbors import write_neighbors


def test_target_catalog(spark, tmp_path):
    rows = [(1, 1.0, 0.1, None, 0.2, 0.5, 7.0), (2, math.nan, 0.1, -99.0, 0.2, 0.6, 8.0), (3, 3.0, 0.1, 4.0, 0.2, 0.7, 9.0)]
    df = spark.createDataFrame(rows, "ID long, FV double, EV double, FY double, EY double, EBV double, SH double")
    for format, options in (("parquet", {}), ("csv", {"header": True}), ("json", {}), ("orc", {})):
        df.write.format(format).options(**options).save(f"{tmp_path}/{format}")
        c = catalog.TargetCatalog(f"{tmp_path}/{format}", {"vis": ("FV", "EV"), "Y": ("FY", "EY")}, format=format, missing=(-99.0,), ebv="EBV", shifts={"vis": "SH"})
        out = {r["target_id"]: r for r in catalog.scan_targets(spark, c).collect()}
        assert (out[1]["f_Y"], out[1]["e_Y"]) == (0, math.inf) and (out[2]["f_vis"], out[2]["e_vis"]) == (0, math.inf) and (out[2]["f_Y"], out[2]["e_Y"]) == (0, math.inf)
        assert out[3]["f_Y"] == 4 and math.isclose(out[3]["ebv"], 0.7 * 1.018) and out[3]["shifts"]["vis"] == 9 and float(out[3]["in_FV"]) == 3
    two = catalog.prepared(df, catalog.TargetCatalog("", {"vis": ("FV", "EV"), "Y": ("FY", "EY")}, limit=2, enabled="vi?", unit="Jy"))
    assert two.count() == 2 and "f_Y" not in two.columns and two.orderBy("target_id").first()["f_vis"] == 1e6
    assert two.schema["f_vis"].metadata == {"unit": "uJy"}
    for bad, error in ((dict(unit="furlong"), WrongFormat), (dict(bands={"vis": ("FV", "nope")}), MissingData), (dict(id_column="nope"), MissingData)):
        with pytest.raises(error):
            catalog.prepared(df, catalog.TargetCatalog(**{"path": "", "bands": {"vis": ("FV", "EV")}, **bad}))
    assert catalog.enabled_bands(["lsst/g", "lsst/r", "euclid/vis"], "euclid/*;lsst/*") == ["euclid/vis", "lsst/g", "lsst/r"]


def test_reference_photometry(spark):
    rows = [(1, 1.0, 0.1, 2.0, [0.5, 0.25]), (3, 5.0, None, 6.0, None)]
    df = spark.createDataFrame(rows, "ID long, vis double, vis_ERR double, g double, vis_SHIFT_CORR array<double>")
    assert catalog.photometry_bands(df.columns) == ["vis", "g"]
    out = {r["ref_id"]: r for r in catalog.reference_photometry(df).collect()}
    assert (out[1]["e_vis"], out[3]["e_vis"], out[1]["e_g"], out[1]["ebv_g"]) == (0.1, 0, 0, 0) and (out[1]["c0_vis"], out[1]["c1_vis"], out[3]["c1_vis"]) == (0.5, 0.25, 0)
    with pytest.raises(KeyError):
        catalog.reference_photometry(df, ["Y"])
    with pytest.raises(WrongFormat):
        catalog.reference_photometry(df, system="AB")
    ids = spark.createDataFrame([(3, 0), (1, 1)], "ref_id long, position long")
    assert [r["ref_id"] for r in catalog.in_order(catalog.reference_photometry(df), ids).collect()] == [3, 1]
    with pytest.raises(MissingData):
        catalog.in_order(catalog.reference_photometry(df), spark.createDataFrame([(9, 0)], "ref_id long, position long"))


def test_filters(spark, tmp_path):
    d = tmp_path / "f"
    (d / "sub").mkdir(parents=True)
    for i, n in enumerate(("vis.dat", "sub/g.dat")):
        (d / n).write_text("# comment\n" + "\n".join(f"{1000 + 500 * k} {i + k / 10}" for k in range(9)))
    (tmp_path / "list.txt").write_text(f"# curves\nf/sub/g.dat : green # alias\n\n{d}/vis.dat\n")
    listed = filters.from_list(spark, str(tmp_path / "list.txt"))
    assert list(listed) == ["green", "vis"] and listed["green"].shape == (9, 2) and listed["green"][3].tolist() == [2500, 1.3]
    assert set(filters.from_directory(spark, str(d))) == {"g", "vis"}
    (d / "filter_list.txt").write_text("vis.dat: V\nsub/g.dat")
    assert list(filters.from_directory(spark, str(d))) == ["V", "g"]
    assert filters.as_table(spark, listed).count() == 2
    with pytest.raises(MissingData):
        filters.transmission(listed, "Y")
    with pytest.raises(InvalidDimensions):
        filters.curve("1\n2")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "ref_id long")


def pdz(spark, *rows, n=6):
    return spark.createDataFrame([(i, [float(a + k) for k in range(n)]) for i, a in rows], "ref_id long, p array<double>")


BINS = [1.0, 2.0, 5.0, 6.0, 8.0, 9.0]


def test_sample(spark, tmp_path):
    s = ReferenceSample.create(spark, f"{tmp_path}/a", {"pdz": "pdz", "sed": "sed", "pp": "mc"})
    with pytest.raises(Uninitialized):
        s.data("pdz")
    with pytest.raises(Uninitialized):
        s.add_data("pdz", pdz(spark, (1, 1)))
    s.add_data("pdz", pdz(spark, (1, 1), (3, 2)), BINS)
    s.add_data("pdz", pdz(spark, (12, 3)))
    with pytest.raises(DuplicateId):
        s.add_data("pdz", pdz(spark, (12, 3)))
    with pytest.raises(DuplicateId):
        s.add_data("pdz", pdz(spark, (13, 3), (13, 4)))
    with pytest.raises(AlreadySet):
        s.add_data("pdz", pdz(spark, (14, 3)), [b + 1 for b in BINS])
    with pytest.raises(InvalidDimensions):
        s.add_data("pdz", pdz(spark, (14, 3), n=5))
    knots = "ref_id long, knots array<struct<wl:double,f:double>>"
    s.add_data("sed", spark.createDataFrame([(1, [(1.0, 2.0), (2.0, 3.0)]), (7, [(1.0, 2.0)])], knots))
    with pytest.raises(InvalidDimensions):
        s.add_data("sed", spark.createDataFrame([(8, [(2.0, 2.0), (1.0, 3.0)])], knots))
    s.add_data("pp", spark.createDataFrame([(3, [(1.0,), (2.0,)])], "ref_id long, s array<struct<A:double>>"))
    assert s.bins() == BINS and s.get("pdz", 3).first()["p"][0] == 2
    assert sorted(r["ref_id"] for r in s.index().collect()) == [1, 3, 7, 12]
    s.add_objects(spark.createDataFrame([(99, 0.5)], "ref_id long, weight float"))
    with pytest.raises(DuplicateId):
        s.add_objects(spark.createDataFrame([(99, 0.7)], "ref_id long, weight float"))
    assert {r["ref_id"]: r["weight"] for r in s.weights().collect()} == {1: 1, 3: 1, 7: 1, 12: 1, 99: 0.5}
    rows = list(s.iterate())
    assert [r["ref_id"] for r in rows] == [1, 3, 7, 12, 99] and rows[1]["pp"]["s"][1]["A"] == 2 and rows[2]["pdz"] is None
    s.check()
    again = ReferenceSample.open(spark, f"{tmp_path}/a")
    assert again.providers == s.providers
    with pytest.raises(AlreadySet):
        again.add_provider("pp", "mc")
    with pytest.raises(WrongFormat):
        again.add_provider("index", "mc")
    again.add_provider("other", "mc")
    b = ReferenceSample.create(spark, f"{tmp_path}/b", {"pdz": "pdz"})
    b.add_data("pdz", pdz(spark, (500, 5)), BINS)
    b.import_sample(s)
    assert b.data("pdz").count() == 4 and b.index().count() == 6 and b.data("pp").count() == 1
    b.clear("pdz")
    assert b.data("pdz").count() == 0 and b.index().count() == 6
    b.add_data("pdz", pdz(spark, (1, 9)))
    with pytest.raises(KeyError):
        b.data("nope")


def test_index_merge(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None)], "ref_id long, weight float")
    b = spark.createDataFrame([(2, 0.7, 5), (3, None, 6)], "ref_id long, weight float, extra long")
    out = {r["ref_id"]: (r["weight"], r["extra"]) for r in sample.merge_index(a, b).collect()}
    assert out[1] == (0.5, None) and abs(out[2][0] - 0.7) < 1e-6 and out[3] == (None, 6)


def test_posteriors_and_spectra(spark):
    long = spark.createDataFrame([(1, k, k * 1.5, k) for k in range(4)], "ref_id long, sample_no int, A double, B int")
    assert [x["A"] for x in sample.complete(long, ["A", "B"]).first()["s"]] == [0, 1.5, 3, 4.5]
    seds = spark.createDataFrame([(1, [(10.0, 4.0)]), (2, [(20.0, 8.0)])], "ref_id long, knots array<struct<wl:double,f:double>>")
    zs = spark.createDataFrame([(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.5)], "ref_id long, z double")
    out = {(r["ref_id"], r["z"]): r["knots"][0] for r in sample.redshifted(seds, zs).collect()}
    assert len(out) == 5 and out[(1, 1.0)] == (20.0, 1.0) and math.isclose(out[(2, 1.5)]["wl"], 50)
    assert sample.unit_of("C (lyr)") == ("C", "lyr") and sample.unit_of("D") == ("D", None)


def test_stream_to_files(spark, sf, tmp_path):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    stream = views.photometry(spark.readStream.schema(t.schema).parquet(f"{sf}/embeddings*.parquet").where("vec_id % 5 = 0"), "target_id")
    q = write_neighbors(stream, views.refs(spark, sf), views.BANDS, Search(4), f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("target_id", "rank", "ref_id").collect()
    want = neighbors(views.targets(spark, sf), views.refs(spark, sf), views.BANDS, Search(4)).select("target_id", "rank", "ref_id").collect()
    assert sorted(got) == sorted(want)


def test_stream_against_an_index(spark, tmp_path):
    """Several micro-batches, whose scratch tables go, while the index stays."""
    from skymatch.operators.kdindex import KdIndex
    from skymatch.sources import scratch
    from skymatch.streaming.neighbors import write_indexed_neighbors

    r = np.random.default_rng(6)
    make = lambda n, key: spark.createDataFrame([(i, *map(float, r.normal(0, 1, 2)), 0.1, 0.2) for i in range(n)], f"{key} long, f_a double, f_b double, e_a double, e_b double")
    refs, targets = make(800, "ref_id"), make(90, "target_id").repartition(3)
    targets.write.parquet(f"{tmp_path}/in")
    index = KdIndex.fit(refs, ["a", "b"], scratch.folder(spark), 40)
    stream = spark.readStream.schema(targets.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = list(scratch.FOLDERS)
    for search in (Search(4, method="kdtree"), Search(3, method="combined", batch=20)):
        out = f"{tmp_path}/{search.method}"
        write_indexed_neighbors(stream, index, search, out, f"{out}-state", availableNow=True).awaitTermination()
        assert scratch.FOLDERS == kept and len(list((tmp_path / search.method).glob("batch=*"))) == 3
        got = spark.read.parquet(out).select("target_id", "rank", "ref_id").collect()
        assert sorted(got) == sorted(neighbors(targets, refs, ["a", "b"], search, "join").select("target_id", "rank", "ref_id").collect())


def test_config():
    good = dict(reference_sample_phot_filters=["a", "b"], neighbor_method="Combined", neighbors_no=3, weight_method="Chi2", batch_size=9)
    c = Config.parse(good)
    assert (c.search.method, c.search.batch, c.mc_pdf_take_n) == ("combined", 9, 100)
    assert Config.parse('{"reference_sample_phot_filters": ["a"], "neighbor_method": "BruteForce", "neighbors_no": 2, "weight_method": "Likelihood", "scale_prior": "tophat 1 2"}').search.prior.high == 2
    for bad in (dict(neighbor_method="Octree"), dict(batch_size=None), dict(scale_prior="uniform"), dict(weight_method="best"), dict(surprise=1), dict(target_catalog_filters=[("x", "y")])):
        with pytest.raises(ValueError):
            Config.parse({**good, **bad})
    with pytest.raises(ValueError):
        Config.parse({"neighbors_no": 3})


def test_full_run(spark, sf, tmp_path):
    out = catalogue.full_run(spark, sf).cache()
    n = views.targets(spark, sf).count()
    assert out.count() == n
    r = out.first()
    assert len(r["neighbor_ids"]) == 10 and len(r["pdf"]) == len(views.BINS) and len(r["pdf_mc"]) == 10 and len(r["mc_samples_p1"]) == 100 and len(r["mc_count_i1"]) == 4
    assert abs(np.sum(np.array(r["mc_pdf_1d_p1"]) * np.diff(catalogue._E1)) - 1) < 1e-9 and r["phz_pp_68_p1"][0] <= r["phz_pp_median_p1"] <= r["phz_pp_68_p1"][1]
    c = Config.parse(catalogue.CONFIG)
    i = run.Inputs(views.coloured_targets(spark, sf), views.corrected_refs(spark, sf), views.COEFFICIENTS, views.densities(spark, sf), views.BINS, {"pp": views.samples(spark, sf)})
    counted, o = run.observed(out)
    run.write(counted, run.extension_tables(i, c), f"{tmp_path}/out")
    assert o.get["targets"] == n
    assert spark.read.parquet(f"{tmp_path}/out/catalog").count() == n and spark.read.parquet(f"{tmp_path}/out/bins_pdf").count() == len(views.BINS)
    back = run.ids_to_neighbors(spark.read.parquet(f"{tmp_path}/out/catalog"), i.refs)
    assert back.count() == 10 * n
    with pytest.raises(MissingData):
        run.ids_to_neighbors(out, i.refs.limit(3))
    # a provider of one's own
    extra = run.output(run.weigh(run.correct(run.find(i, c), i, c), i, c), i, c, {"n": lambda p, i, c: p.groupBy("target_id").agg(F.count("*").alias("n"))})
    assert {x["n"] for x in extra.collect()} == {10}
