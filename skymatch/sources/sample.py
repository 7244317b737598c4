"""Reference samples: a folder of Parquet tables by ref_id: an index, densities, spectra and Monte-Carlo samples.

Tables are immutable; adding writes new files, and updates write a table anew. What holds of an index file in other systems (files, offsets) has no
counterpart: the id is the address.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..errors import AlreadySet, CorruptedFile, DuplicateId, InvalidDimensions, Uninitialized, WrongFormat
from .catalog import checked_ids

KINDS = ("pdz", "sed", "mc")
#: Rows in a file at most, which bounds its size.
ROWS_A_FILE = 200_000


@dataclass
class ReferenceSample:
    """providers: name -> kind (pdz, sed or mc)."""

    spark: SparkSession
    path: str
    providers: dict[str, str]

    @classmethod
    def create(cls, spark: SparkSession, path: str, providers: dict[str, str] | None = None) -> ReferenceSample:
        providers = providers or {"pdz": "pdz", "sed": "sed"}
        if unknown := {k for k in providers.values() if k not in KINDS}:
            raise WrongFormat(f"kinds {unknown} aren't known")
        spark.createDataFrame([], "ref_id long, weight float").write.mode("errorifexists").parquet(f"{path}/index")
        spark.createDataFrame(list(providers.items()), "name string, kind string").coalesce(1).write.parquet(f"{path}/providers")
        return cls(spark, path, dict(providers))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ReferenceSample:
        rows = spark.read.parquet(f"{path}/providers").collect()
        return cls(spark, path, {r["name"]: r["kind"] for r in rows})

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _rewrite(self, name: str, df: DataFrame) -> None:
        """Writes a table anew though df may read it."""
        new = f"{self.path}/.{name}-new"
        df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).parquet(new)
        self.spark.read.parquet(new).write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{self.path}/{name}")
        self.spark.read.parquet(new).limit(0).write.mode("overwrite").parquet(new)

    # ---- reading

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def data(self, name: str) -> DataFrame:
        if name not in self.providers:
            raise KeyError(f"no provider {name}")
        if not self._exists(name):
            raise Uninitialized(f"{name} has no data yet")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bins(self, name: str = "pdz") -> list[float]:
        if not self._exists(f"{name}_bins"):
            raise Uninitialized(f"{name} has no bins yet")
        return list(self.spark.read.parquet(f"{self.path}/{name}_bins").first()["z"])

    def get(self, name: str, ref_id: int) -> DataFrame:
        """The rows of an id, found by the scan's filter."""
        return self.data(name).where(F.col("ref_id") == ref_id)

    def weights(self) -> DataFrame:
        """ref_id, weight; 1 where none is set."""
        return self.index().select("ref_id", F.coalesce("weight", F.lit(1.0).cast("float")).alias("weight"))

    def joined(self) -> DataFrame:
        """index beside all providers' data, null where an object has none."""
        out = self.index()
        for name in self.providers:
            if self._exists(name):
                out = out.join(self.data(name).select("ref_id", F.struct(*[c for c in self.data(name).columns if c != "ref_id"]).alias(name)), "ref_id", "left")
        return out

    def lacking(self, name: str) -> DataFrame:
        """ref_id of objects that a provider has nothing of."""
        return self.index().join(self.data(name), "ref_id", "left_anti").select("ref_id")

    def iterate(self) -> Iterator:
        """Rows of joined() by id, one partition at a time."""
        return self.joined().orderBy("ref_id").toLocalIterator()

    def check(self) -> None:
        """Each object of a provider must be in the index, once."""
        checked_ids(self.index(), "ref_id")
        for name in self.providers:
            if self._exists(name):
                checked_ids(self.data(name), "ref_id")
                if not self.data(name).join(self.index(), "ref_id", "left_anti").isEmpty():
                    raise CorruptedFile(f"{name} has objects that the index hasn't")

    # ---- writing

    def add_objects(self, ids: DataFrame) -> None:
        """ids: ref_id and perhaps weight (1 by default). New ones are added; a weight that differs from a known one raises."""
        new = ids.select("ref_id", (F.col("weight").cast("float") if "weight" in ids.columns else F.lit(1.0).cast("float")).alias("weight"))
        checked_ids(new, "ref_id")
        merged = merge_index(self.index(), new)
        self._rewrite("index", merged)

    def add_data(self, name: str, df: DataFrame, bins: list[float] | None = None) -> None:
        """Rows by ref_id: pdz (p), sed (knots of wl, f) or mc (s). An id that the provider has already raises."""
        kind = self.providers.get(name)
        if kind is None:
            raise KeyError(f"no provider {name}")
        checked_ids(df, "ref_id")
        validate(df, kind, bins if bins is not None or kind != "pdz" else self.bins(name))
        if kind == "pdz":
            if bins is not None and self._exists(f"{name}_bins"):
                if list(map(float, bins)) != self.bins(name):
                    raise AlreadySet("the bins differ from those that are set")
            elif bins is not None:
                self.spark.createDataFrame([([float(b) for b in bins],)], "z array<double>").coalesce(1).write.parquet(f"{self.path}/{name}_bins")
        if self._exists(name) and not df.join(self.data(name), "ref_id", "left_semi").isEmpty():
            raise DuplicateId(f"{name} has some of these objects already")
        df.write.mode("append").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{self.path}/{name}")
        self._rewrite("index", merge_index(self.index(), df.select("ref_id").join(self.index(), "ref_id", "left_anti").select("ref_id", F.lit(1.0).cast("float").alias("weight"))))

    def clear(self, name: str) -> None:
        """Drops a provider's objects; the index keeps them."""
        self._rewrite(name, self.data(name).limit(0))

    def add_provider(self, name: str, kind: str, overwrite: bool = False) -> None:
        if name in self.providers and not overwrite:
            raise AlreadySet(f"there is a provider {name}")
        if kind not in KINDS or name in ("index", "providers"):
            raise WrongFormat(f"{name} of kind {kind} can't be added")
        if name in self.providers and self._exists(name):
            self.clear(name)
        self.providers[name] = kind
        self._rewrite("providers", self.spark.createDataFrame(list(self.providers.items()), "name string, kind string").coalesce(1))

    def import_sample(self, other: ReferenceSample) -> None:
        """All objects and data of another sample."""
        self.add_objects(other.index().join(self.index(), "ref_id", "left_anti"))  # with their weights, before data adds objects without
        for name, kind in other.providers.items():
            if name not in self.providers:
                self.add_provider(name, kind)
            if other._exists(name):
                self.add_data(name, other.data(name), other.bins(name) if kind == "pdz" else None)


def validate(df: DataFrame, kind: str, bins: list[float] | None = None) -> None:
    """Columns and values of provider rows."""
    column = {"pdz": "p", "sed": "knots", "mc": "s"}[kind]
    if column not in df.columns or not isinstance(df.schema[column].dataType, ArrayType):
        raise InvalidDimensions(f"{kind} rows need an array {column}")
    element = df.schema[column].dataType.elementType
    if kind == "pdz":
        if bins is None:
            raise Uninitialized("bins aren't known")
        if any(b <= a for a, b in zip(bins, bins[1:])):
            raise InvalidDimensions("bins must increase")
        bad = F.size("p") != len(bins)
    elif kind == "sed":
        if not isinstance(element, StructType) or element.names[:2] != ["wl", "f"]:
            raise InvalidDimensions("knots are structs of wl and f")
        falls = F.zip_with("knots", F.slice("knots", 2, 1_000_000_000), lambda a, b: b["wl"] < a["wl"])
        bad = F.exists(falls, lambda x: F.coalesce(x, F.lit(False)))
    else:
        if not isinstance(element, StructType):
            raise InvalidDimensions("samples are structs of parameters")
        bad = F.size("s") == 0
    if not df.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise InvalidDimensions(f"some rows of {kind} have the wrong length or order")


def merge_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two indices by ref_id; columns of both sides; a value set on both sides must agree."""
    shared = [c for c in a.columns if c in b.columns and c != "ref_id"]
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.ref_id") == F.col("y.ref_id"), "full_outer")
    for c in shared:
        if not both.where(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull() & (F.col(f"x.{c}") != F.col(f"y.{c}"))).isEmpty():
            raise DuplicateId(f"{c} is set differently")
    cols = [F.coalesce("x.ref_id", "y.ref_id").alias("ref_id"), *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in shared)]
    cols += [F.col(f"x.{c}") for c in a.columns if c not in (*shared, "ref_id")] + [F.col(f"y.{c}") for c in b.columns if c not in (*shared, "ref_id")]
    return both.select(*cols)


def complete(posteriors: DataFrame, parameters: list[str]) -> DataFrame:
    """ref_id, s: posterior samples in long form (ref_id, sample_no, parameters) as Monte-Carlo rows."""
    rows = F.array_sort(F.collect_list(F.struct("sample_no", *parameters)))
    return posteriors.groupBy("ref_id").agg(rows.alias("_s")).select("ref_id", F.transform("_s", lambda x: F.struct(*(x[p].alias(p) for p in parameters))).alias("s"))


def redshifted(seds: DataFrame, zs: DataFrame) -> DataFrame:
    """ref_id, z, knots: each spectrum at each redshift (of its own object, if zs has ref_id): wavelengths times 1 + z, fluxes over its square."""
    pairs = seds.join(zs, "ref_id") if "ref_id" in zs.columns else seds.crossJoin(zs)
    k = F.lit(1.0) + F.col("z")
    return pairs.select("ref_id", "z", F.transform("knots", lambda x: F.struct((x["wl"] * k).alias("wl"), (x["f"] / (k * k)).alias("f"))).alias("knots"))


def unit_of(name: str) -> tuple[str, str | None]:
    """`C (lyr)` is the parameter C in lyr."""
    import re

    m = re.fullmatch(r"\s*(.*?)\s*\(([^()]*)\)\s*", name)
    return (m[1], m[2]) if m else (name.strip(), None)
