"""Catalogues of targets and reference photometry as DataFrames with f_<band>, e_<band> columns in microjansky."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateId, InvalidAxis, MissingData, WrongFormat
from .fits import read_fits
from .npy import read_npy

#: Microjansky in a unit of flux density.
UNITS = {"uJy": 1.0, "mJy": 1e3, "Jy": 1e6, "nJy": 1e-3, "erg/s/cm2/Hz": 1e29, "ABmag-zero": 3.6307805477010137e9, "maggy": 3.6307805477010137e9, "nanomaggy": 3.6307805477010137, "W/m2/Hz": 1e32}
PREFIXES = {"": 1.0, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "kilo": 1e3, "mega": 1e6}


def microjansky(unit: str) -> float:
    """How many a unit of flux density is: prefixed janskys, or a product of powers such as `erg s-1 cm-2 Hz-1` and `W / (m2 Hz)`, in any order."""
    if unit in UNITS:
        return UNITS[unit]
    if (m := re.fullmatch(r"(.*?)(Jy|[jJ]ansky)", unit.strip())) and m[1] in PREFIXES:
        return PREFIXES[m[1]] * 1e6
    above, _, below = unit.replace("**", "").replace("^", "").replace("*", " ").replace(".", " ").partition("/")
    powers: dict[str, int] = {}
    for text, sign in ((above, 1), (re.sub(r"[/()]", " ", below), -1)):
        for part in text.split():
            m = re.fullmatch(r"([A-Za-z]+)([+-]?\d+)?", part)
            if not m:
                raise WrongFormat(f"the unit {unit} isn't known")
            powers[m[1]] = powers.get(m[1], 0) + sign * int(m[2] or 1)
    if powers == {"erg": 1, "s": -1, "cm": -2, "Hz": -1}:
        return 1e29
    if powers in ({"W": 1, "m": -2, "Hz": -1}, {"J": 1, "s": -1, "m": -2, "Hz": -1}):
        return 1e32
    raise WrongFormat(f"the unit {unit} isn't known")


def common_unit(df: DataFrame, columns: list[str], stated: str | None) -> str:
    """The unit that columns' metadata name, which must be one for all of them; where they name none the stated one, or microjansky."""
    units = {df.schema[x].metadata.get("unit") for x in columns}
    if len(units) > 1:
        raise WrongFormat(f"columns {columns} have several units: {sorted(map(str, units))}")
    found = next(iter(units), None)
    if found and stated and microjansky(found) != microjansky(stated):
        raise WrongFormat(f"columns are in {found}, {stated} is stated")
    return found or stated or "uJy"


@dataclass(frozen=True)
class TargetCatalog:
    """bands: (flux column, error column) of each reference band, in their order. unit: of columns that name none in their metadata; uJy if None. missing: flux values that mean none. enabled: globs; others of the bands are dropped, and the order follows the globs."""

    path: str
    bands: dict[str, tuple[str, str]]
    id_column: str = "ID"
    format: str = "parquet"
    unit: str | None = None
    missing: tuple[float, ...] = ()
    enabled: str | None = None
    limit: int | None = None
    ebv: str | None = None
    dust_map_factor: float = 1.018
    shifts: dict[str, str] = field(default_factory=dict)


def enabled_bands(bands: list[str], globs: str | None) -> list[str]:
    """Bands that match, in the order of the globs, which `;` separates."""
    if not globs:
        return list(bands)
    out = []
    for g in (g.strip() for g in globs.split(";")):
        out += [b for b in bands if fnmatch(b, g) and b not in out]
    return out


def cleaned(f: Column, e: Column, missing: tuple[float, ...] = (), factor: float = 1.0) -> tuple[Column, Column]:
    """A missing flux (null, NaN or a given value) is 0 with an infinite error, so that its band weighs nothing."""
    gone = f.isNull() | F.isnan(f)
    for m in missing:
        gone = gone | (f == F.lit(float(m)))
    return F.when(gone, F.lit(0.0)).otherwise(f * factor), F.when(gone, F.lit(float("inf"))).otherwise(e * factor)


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    if format == "csv":
        return spark.read.options(header=True, inferSchema=True).csv(path)
    if format == "fits":
        return read_fits(spark, path)
    if format == "npy":
        return read_npy(spark, path).drop("file", "row")
    if format in ("parquet", "orc", "json"):
        return spark.read.format(format).load(path)
    raise WrongFormat(f"{format} can't be read")


def prepared(df: DataFrame, c: TargetCatalog) -> DataFrame:
    """target_id, fluxes and errors of the enabled bands, ebv and shifts if named, and all other input columns as in_<name>."""
    bands = enabled_bands(list(c.bands), c.enabled)
    absent = [x for b in bands for x in c.bands[b] if x not in df.columns]
    if absent or c.id_column not in df.columns:
        raise MissingData(f"no columns {absent or c.id_column}")
    factor = microjansky(common_unit(df, [x for b in bands for x in c.bands[b]], c.unit))
    if c.limit is not None:
        df = df.orderBy(c.id_column).limit(c.limit)
    cols = [F.col(c.id_column).cast("long").alias("target_id")]
    for b in bands:
        f, e = cleaned(*(F.col(x).cast("double") for x in c.bands[b]), c.missing, factor)
        cols += [f.alias(f"f_{b}").alias(f"f_{b}", metadata={"unit": "uJy"}), e.alias(f"e_{b}", metadata={"unit": "uJy"})]
    if c.ebv:
        cols.append((F.col(c.ebv).cast("double") * F.lit(c.dust_map_factor)).alias("ebv"))
    if c.shifts:
        cols.append(F.struct(*(F.col(x).cast("double").alias(b) for b, x in c.shifts.items() if b in bands)).alias("shifts"))
    return df.select(*cols, *(F.col(x).alias(f"in_{x}") for x in df.columns))


def scan_targets(spark: SparkSession, c: TargetCatalog) -> DataFrame:
    return prepared(read(spark, c.path, c.format), c)


def photometry_bands(columns: list[str], id_column: str = "ID") -> list[str]:
    """Bands of a photometry table: all columns but the id, errors and corrections."""
    return [c for c in columns if c != id_column and not c.endswith(("_ERR", "_CORR"))]


def reference_photometry(df: DataFrame, bands: list[str] | None = None, id_column: str = "ID", system: str = "F_nu_uJy") -> DataFrame:
    """ref_id, f_, e_, ebv_, c0_, c1_ of each band. Missing error and correction columns count as 0. Shift corrections are arrays of two."""
    if system != "F_nu_uJy":
        raise WrongFormat(f"photometry in {system} can't be used")
    known = photometry_bands(df.columns, id_column)
    wanted = bands or known
    if unknown := [b for b in wanted if b not in known]:
        raise KeyError(f"no bands {unknown}")
    zero = F.lit(0.0)
    cols = [F.col(id_column).cast("long").alias("ref_id")]
    for b in wanted:
        cols.append(F.col(b).cast("double").alias(f"f_{b}"))
        for name, source in ((f"e_{b}", f"{b}_ERR"), (f"ebv_{b}", f"{b}_EBV_CORR")):
            cols.append((F.coalesce(F.col(source).cast("double"), zero) if source in df.columns else zero).alias(name))
        shift = f"{b}_SHIFT_CORR"
        for i in (0, 1):
            cols.append((F.coalesce(F.get(shift, F.lit(i)).cast("double"), zero) if shift in df.columns else zero).alias(f"c{i}_{b}"))
    return df.select(*cols)


def in_order(photometry: DataFrame, ids: DataFrame) -> DataFrame:
    """Photometry rows of ids (ref_id, position), with their position; an id without photometry raises."""
    absent = ids.join(photometry.select("ref_id"), "ref_id", "left_anti")
    if not absent.isEmpty():
        raise MissingData("ids without photometry")
    return photometry.join(ids.select("ref_id", "position"), "ref_id").orderBy("position")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """key, n: ids that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checked_ids(df: DataFrame, key: str) -> DataFrame:
    """df, if no id occurs twice and none is null."""
    if not df.where(F.col(key).isNull()).isEmpty():
        raise InvalidAxis(f"{key} has nulls")
    if not duplicates(df, key).isEmpty():
        raise DuplicateId(f"{key} repeats")
    return df
