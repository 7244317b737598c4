"""Reference samples whose index says in which file, and where in it, each object's data lie.

An index has ref_id, perhaps weight, and for each provider <name>_file (a number from 1, -1 for none) and <name>_offset (a row of that file). Data files are numbered
arrays: of densities (the first row holds the bins), of spectra [objects, knots, 2], or of Monte-Carlo samples (named fields). They are read by
ranges, and rows meet the index by file and offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CorruptedFile, DuplicateId, InvalidAxis, InvalidPosition, MissingData
from .files import listed, store
from .fits import FitsReader, of_file, read_fits
from .fits import layout as fits_layout
from .npy import read_npy
from .sample import ReferenceSample, unit_of
from .scratch import stored

PATTERNS = {"pdz": "pdz_data_{}.npy", "sed": "sed_data_{}.npy", "mc": "mc_data_{}.npy"}


def providers(index: DataFrame) -> list[str]:
    return [c.removesuffix("_file") for c in index.columns if c.endswith("_file") and c.removesuffix("_file") + "_offset" in index.columns]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, weight (if there is one), files and offsets, and row, the place in the index. Raises where checked() does."""
    rows = read_npy(spark, path).drop("file")
    if "id" not in rows.columns:
        raise CorruptedFile("an index needs named fields, id among them")
    return checked(rows.withColumnRenamed("id", "ref_id"))


def checked(index: DataFrame) -> DataFrame:
    """index (with row, its own order), if ids are whole numbers of 64 bits and unique, positions aren't below -1 and belong to one object, and the index names the objects of each file in the order in which they lie there."""
    if dict(index.dtypes).get("ref_id") != "bigint":
        raise CorruptedFile("ids must be integers of 64 bits")
    if not index.groupBy("ref_id").count().where("count > 1 OR ref_id IS NULL").isEmpty():
        raise DuplicateId("an id occurs twice")
    for name in providers(index):
        at = index.select(F.col(f"{name}_file").cast("long").alias("f"), F.col(f"{name}_offset").cast("long").alias("o"), "row")
        if not at.where("f < -1 OR o < -1 OR f = 0 OR (f = -1) != (o = -1) OR f IS NULL OR o IS NULL").isEmpty():
            raise InvalidPosition(f"a position of {name} is out of range")
        before = F.lag(F.struct("o", "row")).over(Window.partitionBy("f").orderBy("row"))  # a file's rows, which its size bounds
        order = at.where("f > 0").withColumn("b", before).where("b IS NOT NULL")
        found = order.agg(F.count_if(F.col("o") == F.col("b.o")).alias("twice"), F.count_if(F.col("o") < F.col("b.o")).alias("back")).first()
        if found["twice"] or found["back"]:
            raise InvalidPosition(f"the index of {name} doesn't follow the layout of its files")
    return index


def files_of(index: DataFrame, name: str) -> list[int]:
    """Numbers of the files that hold a provider's data."""
    return sorted(r[0] for r in index.select(F.col(f"{name}_file").cast("int")).where(f"{name}_file > 0").distinct().collect())  # a row a file


def ids_of_file(index: DataFrame, name: str, number: int) -> DataFrame:
    """ref_id, offset of one file's objects, in the order in which they lie there."""
    return index.where(F.col(f"{name}_file") == number).select("ref_id", F.col(f"{name}_offset").cast("long").alias("offset")).orderBy("offset")


def position(index: DataFrame, name: str, ids: DataFrame | Iterable[int]) -> DataFrame:
    """ref_id, file, offset of some objects; none for those without data."""
    ids = ids if isinstance(ids, DataFrame) else index.sparkSession.createDataFrame([(int(i),) for i in ids], "ref_id long")
    return index.where(f"{name}_file > 0").join(ids.select("ref_id"), "ref_id", "left_semi").select("ref_id", F.col(f"{name}_file").cast("int").alias("file"), F.col(f"{name}_offset").cast("long").alias("offset"))


def store_index(index: DataFrame, path: str, name: str) -> None:
    """The index by files of one provider: a folder a file, sorted by offset, so that looking a file up reads its folder alone."""
    index.repartition(F.col(f"{name}_file")).sortWithinPartitions(f"{name}_file", f"{name}_offset").write.mode("overwrite").partitionBy(f"{name}_file").parquet(path)


def numbered(folder: str, pattern: str) -> list[int]:
    """Numbers, from 1 to the first gap, of the files that follow a pattern such as pdz_data_{}.npy."""
    shape = re.compile(re.escape(pattern).replace(re.escape("{}"), r"(\d+)"))
    try:
        found = {int(m[1]) for p, _ in listed(folder) if (m := shape.fullmatch(p.rpartition("/")[2])) and m[1] == str(int(m[1]))}
    except MissingData:
        found = set()
    out = []
    while len(out) + 1 in found:
        out.append(len(out) + 1)
    return out


def existing(index: DataFrame, name: str, folder: str, pattern: str) -> list[int]:
    """Numbers of the files that are there; raises if the index names others."""
    there = numbered(folder, pattern)
    if absent := sorted(set(files_of(index, name)) - set(there)):
        raise MissingData(f"files of {name} are missing: {', '.join(pattern.format(n) for n in absent)}")
    return there


def located(spark: SparkSession, index: DataFrame, name: str, folder: str, pattern: str) -> DataFrame:
    """ref_id and the columns of the data files, for all objects of a provider. An offset beyond its file raises."""
    existing(index, name, folder, pattern)
    glob = pattern.format("*")
    number = F.regexp_extract("file", re.escape(pattern).replace(re.escape("{}"), r"(\d+)"), 1).cast("int")
    data = read_npy(spark, f"{folder.rstrip('/')}/{glob}").withColumns({"_file": number}).drop("file").withColumnRenamed("row", "_offset")
    wanted = index.where(f"{name}_file > 0").select("ref_id", F.col(f"{name}_file").cast("int").alias("_file"), F.col(f"{name}_offset").cast("long").alias("_offset"))
    if not wanted.join(data.select("_file", "_offset"), ["_file", "_offset"], "left_anti").isEmpty():
        raise InvalidAxis(f"positions of {name} lie beyond their files")
    return wanted.join(data, ["_file", "_offset"]).drop("_file", "_offset")


def bins(spark: SparkSession, folder: str, pattern: str) -> list[float]:
    """The first row of the density files, which must be one and increase."""
    first = [r["values"] for r in read_npy(spark, f"{folder.rstrip('/')}/{pattern.format('*')}").where("row = 0").select("values").distinct().limit(2).collect()]
    if len(first) != 1 or any(b <= a for a, b in zip(first[0], first[0][1:])):
        raise InvalidAxis("bins differ between files, or don't increase")
    return [float(x) for x in first[0]]


def provider_rows(spark: SparkSession, index: DataFrame, name: str, kind: str, folder: str, pattern: str | None = None) -> DataFrame:
    """Rows as a ReferenceSample keeps them: ref_id and p, knots or s, whose fields lose the units of their names."""
    rows = located(spark, index, name, folder, pattern or PATTERNS[kind])
    if kind == "pdz":
        return rows.select("ref_id", F.col("values").cast("array<double>").alias("p"))
    if kind == "sed":
        return rows.select("ref_id", F.transform("values", lambda k: F.struct(k[0].cast("double").alias("wl"), k[1].cast("double").alias("f"))).alias("knots"))
    fields = rows.schema["values"].dataType.elementType.names if "values" in rows.columns else [c for c in rows.columns if c != "ref_id"]
    if "values" in rows.columns:
        return rows.select("ref_id", F.transform("values", lambda x: F.struct(*(x[f].alias(unit_of(f)[0]) for f in fields))).alias("s"))
    return rows.select("ref_id", F.array(F.struct(*(F.col(f"`{f}`").alias(unit_of(f)[0]) for f in fields))).alias("s"))


def import_arrays(spark: SparkSession, folder: str, sample: ReferenceSample, patterns: dict[str, str] | None = None) -> None:
    """Adds the objects and data of a folder of arrays (index.npy and numbered files) to a sample, for those of its providers that the index names."""
    index = read_index(spark, f"{folder.rstrip('/')}/index.npy")
    sample.add_objects(index.select("ref_id", *(["weight"] if "weight" in index.columns else [])))
    for name in providers(index):
        kind = sample.providers.get(name)
        if kind is None or not files_of(index, name):
            continue
        pattern = (patterns or {}).get(name, f"{name}_data_{{}}.npy")
        sample.add_data(name, provider_rows(spark, index, name, kind, folder, pattern), bins(spark, folder, pattern) if kind == "pdz" else None)


def posteriors(spark: SparkSession, folder: str, listing: DataFrame, id_column: str = "OBJECT_ID", file_column: str = "FILE_NAME") -> DataFrame:
    """ref_id, s of the posterior samples of files that a listing names: a row for each object, in the order of `position`, with its file.

    Each file is a table of samples, those of an object one after another, of equal number for the objects of a file, in the order of the listing. Tasks read files by
    ranges; a sample's object is its row's share of the file. Missing files, and files whose rows can't be shared out evenly, raise. The column id_column of the files is dropped.
    listing: ref_id, position and the column of file names.
    """
    base = folder.rstrip("/")
    order = Window.partitionBy("file").orderBy("position")  # the objects of one file, which its size bounds
    objects = listing.select("ref_id", F.trim(F.col(file_column)).alias("file"), "position").withColumn("at", F.row_number().over(order) - 1)
    sizes = objects.groupBy("file").agg(F.count("*").alias("objects"))

    @F.udf("long")
    def length(name: str) -> int:
        """Rows of a file by a short read of its header, -1 if it is missing."""
        files, at = store(f"{base}/{name}")
        try:
            with files.open_input_file(at) as f:
                return fits_layout(of_file(f), f.size(), 1).rows
        except FileNotFoundError:
            return -1

    sizes = stored(sizes.withColumn("rows", length("file")))
    if bad := [r["file"] for r in sizes.where("rows < 0").select("file").limit(5).collect()]:
        raise MissingData(f"files are missing: {', '.join(bad)}")
    if bad := [r["file"] for r in sizes.where("rows % objects != 0 OR rows = 0").select("file").limit(5).collect()]:
        raise CorruptedFile(f"samples can't be shared out evenly in {', '.join(bad)}")
    names = [r["file"] for r in sizes.select("file").orderBy("file").collect()]  # a name a file
    options = {"path": base, "files": "\n".join(names)}
    fields = [f for f in FitsReader(options).schema().names if f != id_column]
    samples = read_fits(spark, base, files=names, places=True)
    shared = samples.join(sizes.select(F.col("file").alias("_file"), (F.col("rows") / F.col("objects")).cast("long").alias("_each")), "_file")
    shared = shared.select("_file", F.floor(F.col("_row") / F.col("_each")).alias("_at"), F.struct(F.col("_row"), *(F.col(f"`{f}`") for f in fields)).alias("_s"))
    found = shared.groupBy("_file", "_at").agg(F.array_sort(F.collect_list("_s")).alias("_s"))  # the samples of one object
    found = found.join(objects, (F.col("_file") == F.col("file")) & (F.col("_at") == F.col("at")))
    return found.select("ref_id", F.transform("_s", lambda x: F.struct(*(x[f].alias(unit_of(f)[0]) for f in fields))).alias("s"))
