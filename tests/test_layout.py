"""Arrays in files, samples whose index names files and offsets, and posteriors by file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.errors import CorruptedFile, DuplicateId, InvalidAxis, InvalidPosition, MissingData, WrongFormat
from skymatch.sources import layout, npy
from skymatch.sources.fits import write_fits
from skymatch.sources.npy import read_npy
from skymatch.sources.sample import ReferenceSample

INDEX = [("id", "<i8"), ("weight", "<f4"), ("pdz_file", "<i8"), ("pdz_offset", "<i8"), ("sed_file", "<i8"), ("sed_offset", "<i8"), ("pp_file", "<i8"), ("pp_offset", "<i8")]
BINS = np.arange(4, dtype=np.float32)


def sample_folder(path):
    """Ten objects over two files a provider; object 9 has no spectrum."""
    index = np.zeros(10, INDEX)
    for name, first in (("pdz", 1), ("sed", 0), ("pp", 0)):
        index[f"{name}_file"] = [1] * 6 + [2] * 4
        index[f"{name}_offset"] = [*range(first, first + 6), *range(first, first + 4)]
    index["id"], index["weight"] = np.arange(10) * 11, np.arange(10) / 2
    index["sed_file"][9] = index["sed_offset"][9] = -1
    np.save(path / "index.npy", index)
    for n, ids in ((1, range(6)), (2, range(6, 10))):
        np.save(path / f"pdz_data_{n}.npy", np.array([BINS, *([i, i + 1, i + 2, i + 3] for i in ids)], np.float32))
        np.save(path / f"sed_data_{n}.npy", np.array([[[100 * k, i + k] for k in range(3)] for i in ids if i < 9], np.float32))
        pp = np.zeros((len(ids), 5), [("Z", "<f4"), ("Mass (Msun)", "<f8")])
        pp["Z"], pp["Mass (Msun)"] = np.array([[i + s / 10 for s in range(5)] for i in ids]), 7
        np.save(path / f"pp_data_{n}.npy", pp)
    return index


def test_arrays_of_all_kinds(spark, tmp_path):
    table = np.zeros(7, [("id", ">i8"), ("b", "?"), ("u", "<u2"), ("name", "S4"), ("text", "<U3"), ("v", "<f4", (2,)), ("small", "<f2")])
    table["id"], table["b"], table["u"], table["name"], table["text"], table["v"], table["small"] = range(7), [1, 0] * 3 + [1], 60_000, b"ab", "é", [[1, 2]] * 7, 0.5
    np.save(tmp_path / "t.npy", table)
    df = read_npy(spark, str(tmp_path / "t.npy"), range_bytes=50)
    assert dict(df.dtypes) == {"file": "string", "row": "bigint", "id": "bigint", "b": "boolean", "u": "int", "name": "string", "text": "string", "v": "array<float>", "small": "float"}
    rows = sorted(df.collect())
    assert len(rows) == 7 and tuple(rows[3]) == ("t.npy", 3, 3, False, 60_000, "ab", "é", [1, 2], 0.5)
    for x, kind in ((np.arange(12.0), "double"), (np.arange(24, dtype=np.int32).reshape(12, 2), "array<int>"), (np.arange(48, dtype=">f4").reshape(12, 2, 2), "array<array<float>>")):
        np.save(tmp_path / "x.npy", x)
        df = read_npy(spark, str(tmp_path / "x.npy"), range_bytes=16)
        assert df.dtypes[2][1] == kind and df.rdd.getNumPartitions() > 2
        assert [r[2] for r in sorted(df.collect())] == x.tolist()
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_arrays_that_cannot_be_read(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((3, 2))))
    np.save(tmp_path / "c.npy", np.zeros(3, complex))
    np.save(tmp_path / "u.npy", np.zeros(3, np.uint64))
    (tmp_path / "short.npy").write_bytes((tmp_path / "u.npy").read_bytes()[:-8])
    (tmp_path / "text.npy").write_text("no array")
    for name, error in (("f", WrongFormat), ("c", WrongFormat), ("u", WrongFormat), ("short", CorruptedFile), ("text", CorruptedFile), ("absent", MissingData)):
        with pytest.raises(error):
            npy.NpyReader({"path": str(tmp_path / f"{name}.npy")}).schema()
    folder = tmp_path / "mixed"
    folder.mkdir()
    np.save(folder / "a.npy", np.zeros(3))
    np.save(folder / "b.npy", np.zeros(3, np.float32))
    with pytest.raises(Exception, match="types differ"):
        read_npy(spark, str(folder)).count()


def test_lookups(spark, tmp_path):
    sample_folder(tmp_path)
    index = layout.read_index(spark, str(tmp_path / "index.npy"))
    assert layout.providers(index) == ["pdz", "sed", "pp"] and layout.files_of(index, "sed") == [1, 2]
    assert [tuple(r) for r in layout.ids_of_file(index, "pdz", 2).collect()] == [(66, 1), (77, 2), (88, 3), (99, 4)]
    assert [tuple(r) for r in layout.position(index, "sed", [99, 88, 5]).collect()] == [(88, 2, 2)]
    layout.store_index(index, str(tmp_path / "by_file"), "pdz")
    one = layout.ids_of_file(spark.read.parquet(str(tmp_path / "by_file")), "pdz", 1)
    assert [r["ref_id"] for r in one.collect()] == [0, 11, 22, 33, 44, 55]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pdz_file" in plan


def test_indices_that_are_wrong(spark, tmp_path):
    good = sample_folder(tmp_path)

    def raises(error, **values):
        bad = good.copy()
        for k, v in values.items():
            bad[k] = v
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(error):
            layout.read_index(spark, str(tmp_path / "bad.npy"))

    raises(DuplicateId, id=[0, 1, 2, 3, 4, 5, 6, 7, 8, 0])
    raises(InvalidPosition, pdz_offset=[2, 1, 3, 4, 5, 6, 1, 2, 3, 4])
    raises(InvalidPosition, pdz_offset=[1, 1, 3, 4, 5, 6, 1, 2, 3, 4])
    raises(InvalidPosition, sed_file=-2)
    raises(InvalidPosition, sed_file=-1)
    raises(InvalidPosition, pp_file=0)
    np.save(tmp_path / "bad.npy", good[["weight", "pdz_file", "pdz_offset"]])
    with pytest.raises(CorruptedFile):
        layout.read_index(spark, str(tmp_path / "bad.npy"))
    np.save(tmp_path / "bad.npy", np.zeros(3))
    with pytest.raises(CorruptedFile):
        layout.read_index(spark, str(tmp_path / "bad.npy"))
    np.save(tmp_path / "bad.npy", np.zeros(3, [("id", "<f8")]))
    with pytest.raises(CorruptedFile):
        layout.read_index(spark, str(tmp_path / "bad.npy"))


def test_numbered_files(spark, tmp_path):
    sample_folder(tmp_path)
    assert layout.numbered(str(tmp_path), "pdz_data_{}.npy") == [1, 2] and layout.numbered(str(tmp_path), "none_{}.npy") == [] and layout.numbered(str(tmp_path / "absent"), "{}.npy") == []
    for n in (4, 5):
        np.save(tmp_path / f"pdz_data_{n}.npy", np.zeros((1, 4), np.float32))
    assert layout.numbered(str(tmp_path), "pdz_data_{}.npy") == [1, 2]  # 3 is missing
    (tmp_path / "sed_data_2.npy").unlink()
    index = layout.read_index(spark, str(tmp_path / "index.npy"))
    assert layout.existing(index, "pp", str(tmp_path), "pp_data_{}.npy") == [1, 2]
    with pytest.raises(MissingData, match="sed_data_2.npy"):
        layout.existing(index, "sed", str(tmp_path), "sed_data_{}.npy")


def test_rows_of_providers(spark, tmp_path):
    sample_folder(tmp_path)
    index = layout.read_index(spark, str(tmp_path / "index.npy"))
    pdz = {r["ref_id"]: r["p"] for r in layout.provider_rows(spark, index, "pdz", "pdz", str(tmp_path)).collect()}
    assert pdz == {11 * i: [i, i + 1, i + 2, i + 3] for i in range(10)} and layout.bins(spark, str(tmp_path), "pdz_data_{}.npy") == BINS.tolist()
    sed = {r["ref_id"]: [tuple(k) for k in r["knots"]] for r in layout.provider_rows(spark, index, "sed", "sed", str(tmp_path)).collect()}
    assert sed == {11 * i: [(100 * k, i + k) for k in range(3)] for i in range(9)}
    pp = {r["ref_id"]: r["s"] for r in layout.provider_rows(spark, index, "pp", "mc", str(tmp_path), "pp_data_{}.npy").collect()}
    assert len(pp) == 10 and pp[22][3]["Z"] == pytest.approx(2.3) and pp[22][3]["Mass"] == 7
    short = index.withColumn("pdz_offset", F.when(F.col("ref_id") == 99, 50).otherwise(F.col("pdz_offset")))
    with pytest.raises(InvalidAxis):
        layout.provider_rows(spark, short, "pdz", "pdz", str(tmp_path))
    np.save(tmp_path / "pdz_data_2.npy", np.zeros((5, 4), np.float32))
    with pytest.raises(InvalidAxis):
        layout.bins(spark, str(tmp_path), "pdz_data_{}.npy")


def test_import(spark, tmp_path):
    (tmp_path / "arrays").mkdir()
    sample_folder(tmp_path / "arrays")
    s = ReferenceSample.create(spark, str(tmp_path / "sample"), {"pdz": "pdz", "sed": "sed", "pp": "mc"})
    layout.import_arrays(spark, str(tmp_path / "arrays"), s)
    s.check()
    assert s.bins() == BINS.tolist() and s.data("pdz").count() == 10 and s.data("sed").count() == 9 and s.data("pp").count() == 10
    assert {r["ref_id"]: r["weight"] for r in s.weights().collect()} == {11 * i: i / 2 for i in range(10)}
    assert [r["ref_id"] for r in s.lacking("sed").collect()] == [99]


def posterior_folder(spark, path, counts, each):
    for n, c in counts.items():
        rows = [(f"o{n}.{i}", n + i / 10 + k / 1000, float(k)) for i in range(c) for k in range(each[n])]
        write_fits(spark.createDataFrame(rows, "OBJECT_ID string, Z double, M double").coalesce(1), str(path / f"sampling_{n}.fits"), single=True, rows=7)


def test_posteriors(spark, tmp_path):
    counts, each = {1: 3, 2: 4, 10: 1}, {1: 5, 2: 2, 10: 6}
    posterior_folder(spark, tmp_path, counts, each)
    (tmp_path / "other.fits").write_bytes(b"not listed")
    listing, want = [], {}
    for at, n in enumerate([2, 1, 1, 2, 10, 2, 1, 2]):
        i = sum(f"sampling_{n}.fits" in x[1] for x in listing)
        listing.append((1000 - at, f" sampling_{n}.fits ", at))
        want[1000 - at] = [(pytest.approx(n + i / 10 + k / 1000), float(k)) for k in range(each[n])]
    df = spark.createDataFrame(listing, "ref_id long, FILE_NAME string, position long").repartition(3)
    got = {r["ref_id"]: [tuple(x) for x in r["s"]] for r in layout.posteriors(spark, str(tmp_path), df).collect()}
    assert got == want
    s = ReferenceSample.create(spark, str(tmp_path / "sample"), {"pp": "mc"})
    s.add_data("pp", layout.posteriors(spark, str(tmp_path), df))
    assert s.data("pp").count() == 8
    more = spark.createDataFrame([*listing, (1, "sampling_1.fits", 99)], df.schema)
    with pytest.raises(CorruptedFile, match="sampling_1.fits"):
        layout.posteriors(spark, str(tmp_path), more)
    with pytest.raises(MissingData, match="sampling_3.fits"):
        layout.posteriors(spark, str(tmp_path), spark.createDataFrame([(1, "sampling_3.fits", 0)], df.schema))
