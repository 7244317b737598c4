"""FITS tables that a plain writer of this file makes, and tables that are written and read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.errors import CorruptedFile, MissingData, WrongFormat
from skymatch.sources import catalog, fits
from skymatch.sources.fits import read_fits, read_header, write_fits


def header(*cards):
    text = "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def padded(data):
    return data + b"\0" * (-len(data) % 2880)


def bintable(columns, rows, name="T", extra=()):
    """columns: (name, form, unit)."""
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("EXTNAME", f"'{name}'")]
    for i, (n, form, unit) in enumerate(columns, 1):
        cards += [(f"TTYPE{i}", f"'{n}'  / it''s a name"), (f"TFORM{i}", f"'{form}'")] + ([(f"TUNIT{i}", f"'{unit}'")] if unit else [])
    return header(*cards, *extra) + padded(rows.tobytes())


PRIMARY = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 3), ("NAXIS2", 5)) + padded(b"x" * 15)
KIND = np.dtype([("ID", ">i8"), ("F", ">f4"), ("E", ">f8"), ("OK", "S1"), ("V", ">f4", (2,)), ("N", "S6"), ("U", ">i2"), ("B", "u1"), ("J", ">i4")])
COLUMNS = [("ID", "K", None), ("F", "1E", "uJy"), ("E", "D", "uJy"), ("OK", "L", None), ("V", "2E", None), ("N", "6A", None), ("U", "I", None), ("B", "B", None), ("J", "J", None)]


def rows(first, n):
    out = np.zeros(n, KIND)
    for i in range(n):
        k = first + i
        out[i] = (k, k / 4, k / 8, b"TF"[k % 2 : k % 2 + 1], (k, -k), f"n{k}".encode(), k - 32768, k % 256, -1 if k == first else k)
    return out


@pytest.fixture
def folder(tmp_path):
    extra = [("TZERO7", 32768), ("TNULL9", -1)]
    for i in range(2):
        other = np.zeros(1, [("x", ">f8")])
        (tmp_path / f"{i}.fits").write_bytes(PRIMARY + bintable(COLUMNS, rows(100 * i, 7), "DATA", extra) + bintable([("x", "D", None)], other, "OTHER"))
    return tmp_path


def test_types(spark, folder):
    df = read_fits(spark, f"{folder}/1.fits")
    assert df.schema["F"].metadata == {"unit": "uJy"} and dict(df.dtypes)["U"] == "int" and dict(df.dtypes)["V"] == "array<float>"
    out = {r["ID"]: r for r in df.collect()}
    assert len(out) == 7
    r = out[103]
    assert (r["F"], r["E"], r["OK"], r["V"], r["N"], r["U"], r["B"], r["J"]) == (25.75, 12.875, False, [103, -103], "n103", 103, 103, 103)
    assert out[100]["J"] is None and out[100]["OK"] is True


def test_many_files_and_names(spark, folder):
    assert read_fits(spark, str(folder), batch=3).count() == 14
    assert read_fits(spark, f"{folder}/0.fits", "OTHER").columns == ["x"]
    (folder / "2.fits").write_bytes(PRIMARY + bintable([("x", "D", None)], np.zeros(1, [("x", ">f8")])))
    with pytest.raises(Exception, match="differ"):
        read_fits(spark, str(folder)).count()


def test_catalog(spark, folder):
    c = catalog.TargetCatalog(str(folder), {"vis": ("F", "E")}, format="fits")
    assert catalog.scan_targets(spark, c).where("f_vis = target_id / 4").count() == 14


def test_bad_files():
    good = PRIMARY + bintable(COLUMNS, rows(0, 3))
    for data, hdu, error in ((b"no", 1, WrongFormat), (good, 0, WrongFormat), (good, 5, MissingData), (good[:-2880], 1, CorruptedFile), (good[:300], 1, CorruptedFile), (good.replace(b"'1E'", b"'1P'"), 1, WrongFormat)):
        with pytest.raises(error):
            fits.layout(fits.within(data), len(data), hdu)


def test_ranges_of_a_file(spark, folder):
    """A file is read by several tasks, each row once, wherever ranges cut rows."""
    whole = sorted(map(str, read_fits(spark, f"{folder}/1.fits").collect()))
    size = (folder / "1.fits").stat().st_size
    for n in (100, 37, 2880, size):
        df = read_fits(spark, f"{folder}/1.fits", range_bytes=n)
        assert df.rdd.getNumPartitions() == -(-size // n)
        assert sorted(map(str, df.collect())) == whole
    tasks = {r["t"] for r in read_fits(spark, f"{folder}/1.fits", range_bytes=100).select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) > 1


def test_tables_beyond_a_binary_value_need_no_memory(tmp_path):
    """A header that speaks of more rows than a binary value could hold; only the range asked for is read."""
    rows_, width = 2**28, 8
    head = header(("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows_), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "'x'"), ("TFORM1", "'K'"))
    path = tmp_path / "big.fits"
    with open(path, "wb") as f:
        f.write(PRIMARY + head)
        f.truncate(len(PRIMARY + head) + rows_ * width)  # sparse
    reader = fits.FitsReader({"path": str(path), "range": str(1 << 20), "batch": "1000"})
    parts = reader.partitions()
    assert len(parts) == 2049
    assert sum(b.num_rows for p in (parts[0], parts[1000], parts[-1]) for b in reader.read(p)) == (3 * (1 << 20) - len(PRIMARY + head) - (2049 * (1 << 20) - path.stat().st_size)) // width


def test_columns_that_are_asked_for(spark, folder):
    df = read_fits(spark, str(folder), columns=["E", "ID"])
    assert sorted(df.columns) == ["E", "ID"] and df.where("E = ID / 8").count() == 14
    with pytest.raises(Exception, match="no columns"):
        read_fits(spark, str(folder), columns=["nope"])


def test_units_must_agree(spark, folder):
    other = [(n, f, "mJy" if n == "F" else u) for n, f, u in COLUMNS]
    (folder / "2.fits").write_bytes(PRIMARY + bintable(other, rows(300, 4), "DATA", [("TZERO7", 32768), ("TNULL9", -1)]))
    with pytest.raises(Exception, match="units of .*F.* differ"):
        read_fits(spark, str(folder)).count()


def test_whole_files_give_the_same(spark, folder):
    for path, hdu in ((str(folder), 1), (f"{folder}/0.fits", "OTHER")):
        a, b = fits.read_whole(spark, path, hdu), read_fits(spark, path, hdu)
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_units_of_catalogues(spark, folder):
    """Fluxes are in their columns' unit; differing ones, and one that isn't the stated one, raise."""
    for unit, factor in (("mJy", 1e3), ("uJy", 1.0), ("microJy", 1.0), ("nJy", 1e-3), ("erg s-1 cm-2 Hz-1", 1e29), ("W/m2/Hz", 1e32), (None, 1.0)):
        for old in folder.glob("*.fits"):
            old.unlink()
        cols = [(n, f, unit if n in "FE" else None) for n, f, _ in COLUMNS]
        (folder / "a.fits").write_bytes(PRIMARY + bintable(cols, rows(8, 4)))
        out = catalog.scan_targets(spark, catalog.TargetCatalog(str(folder), {"vis": ("F", "E")}, format="fits")).collect()
        assert [r["f_vis"] for r in out] == pytest.approx([r["target_id"] / 4 * factor for r in out], rel=1e-6)
    stated = catalog.TargetCatalog(str(folder), {"vis": ("F", "E")}, format="fits", unit="mJy")
    assert catalog.scan_targets(spark, stated).where("f_vis = target_id * 250").count() == 4  # no unit in the file: the stated one
    (folder / "a.fits").write_bytes(PRIMARY + bintable([(n, f, "Jy" if n == "F" else "mJy" if n == "E" else None) for n, f, _ in COLUMNS], rows(8, 4)))
    with pytest.raises(WrongFormat, match="units"):
        catalog.scan_targets(spark, stated)
    (folder / "a.fits").write_bytes(PRIMARY + bintable([(n, f, "Jy" if n in "FE" else None) for n, f, _ in COLUMNS], rows(8, 4)))
    with pytest.raises(WrongFormat, match="stated"):
        catalog.scan_targets(spark, stated)


# ---- writing

MADE = "id long, small short, mid int, f float, d double, ok boolean, name string, p array<double>, counts array<int>"


def table(spark, n=50):
    data = [(i, i % 7 if i % 5 else None, -i if i % 3 else None, i / 4 if i % 4 else None, i / 3, [True, False, None][i % 3], f"n{i}" if i % 6 else None, [i / 2, float(i)] if i % 8 else None, [i, 2, 3]) for i in range(n)]
    return spark.createDataFrame(data, MADE).withMetadata("f", {"unit": "uJy"}).withMetadata("d", {"unit": "mag"})


def same(got, want):
    """But for what the format can't tell: empty strings, and NaN for null numbers of floating point."""
    import math

    def tidy(v):
        return None if v is None or v == "" or isinstance(v, float) and math.isnan(v) or isinstance(v, list) and any(isinstance(x, float) and math.isnan(x) for x in v) else v

    rows_ = [sorted(tuple(map(repr, map(tidy, r))) for r in df.collect()) for df in (got, want)]
    assert rows_[0] == rows_[1]


@pytest.mark.parametrize("single", [True, False])
def test_written_tables_read_back(spark, tmp_path, single):
    df = table(spark).repartition(5)
    path = str(tmp_path / ("one.fits" if single else "many"))
    write_fits(df, path, {"PDFQUAN": "0.1 it's 0.2 " * 12, "comment": "made here\n" + "long " * 40, "N": 7, "X": 0.25, "YES": True}, single, rows=4)
    got = read_fits(spark, path)
    assert got.schema["f"].metadata == {"unit": "uJy"} and got.schema["d"].metadata == {"unit": "mag"}
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
    same(got, df)
    head = read_header(path)
    assert head["PDFQUAN"] == ("0.1 it's 0.2 " * 12).rstrip() and head["N"] == "7" and float(head["X"]) == 0.25 and head["YES"] == "T" and head["COMMENT"].startswith("made here\nlong")
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    if single:
        assert int(head["NAXIS2"]) == 50 and os.path.getsize(path) % 2880 == 0
        write_fits(df.limit(3), path, mode="append", single=True, name="MORE")
        same(read_fits(spark, path, "MORE"), df.limit(3))
        same(read_fits(spark, path, 1), df)
    else:
        assert len(os.listdir(path)) > 10
        write_fits(df.limit(3), path, mode="append")
        assert read_fits(spark, path).count() == 53
    write_fits(df.where("id < 5"), path, single=single)
    same(read_fits(spark, path), df.where("id < 5"))


def test_long_cards():
    for n in range(60, 215):
        for text in ("a" * n, "'" * n, "a" * (n - 3) + "'" * 3):
            lines = fits.card("KEY", text)
            assert len(lines) % 80 == 0 and all(len(lines[i : i + 80].rstrip()) <= 80 for i in range(0, len(lines), 80))
            block = fits.padded(lines + b"END".ljust(80), b" ")
            assert fits.cards(fits.within(block), 0)[0]["KEY"] == text


def test_what_cannot_be_written(spark, tmp_path):
    df = table(spark)
    for bad, error in ((df.select(F.struct("id").alias("s")), "can't be written"), (df.select(F.array("name").alias("s")), "can't be written"), (df.select(F.when(F.col("id") < 9, F.array("d")).otherwise(F.array("d", "d")).alias("v")).coalesce(1), "lengths"), (df.select(F.repeat("name", 50).alias("s")), "strings")):
        with pytest.raises(Exception, match=error):
            write_fits(bad, str(tmp_path / "bad"))
        assert not (tmp_path / "bad").exists()


def test_empty_tables(spark, tmp_path):
    for single in (True, False):
        path = str(tmp_path / f"e{single}")
        write_fits(table(spark).limit(0), path, single=single, lengths={"p": 2})
        assert read_fits(spark, path).count() == 0 and read_fits(spark, path).columns == table(spark).columns
