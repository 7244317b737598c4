"""Filter transmission curves from list files and directories."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidDimensions, MissingData


def list_entries(text: str) -> list[tuple[str, str]]:
    """(file, name) of each line `FILE [: NAME]`; `#` begins a comment. Without a name the file's stem is it."""
    out = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            file, _, name = (x.strip() for x in line.partition(":"))
            out.append((file, name or re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])))
    return out


def curve(text: str) -> np.ndarray:
    """[knots, 2]: wavelength and transmission."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    out = np.array([[float(v) for v in r[:2]] for r in rows])
    if out.ndim != 2 or out.shape[1] != 2:
        raise InvalidDimensions("a curve has two columns")
    return out


#: Bytes of all curves that are read at once at most.
MOST_BYTES = 256 << 20


def _texts(spark: SparkSession, paths: Iterable[str], glob: str | None = None) -> dict[str, str]:
    """Whole files by path, of names that match. Their sizes are summed before any is read."""
    how = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    size = spark.read.format("binaryFile").options(**how).load(list(paths)).agg(F.sum("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise InvalidDimensions(f"curves of {size} bytes in all are no filters")
    rows = spark.read.text(list(paths), wholetext=True, **how).select(F.input_file_name().alias("path"), "value").collect()
    return {re.sub("^file:/+", "/", r["path"]): r["value"] for r in rows}


def read_curve(spark: SparkSession, path: str) -> np.ndarray:
    """[knots, 2] of a file of two columns."""
    (text,) = _texts(spark, [path]).values()
    return curve(text)


def from_list(spark: SparkSession, list_file: str) -> dict[str, np.ndarray]:
    """Curves by name in the order of a list file; relative paths start at its folder."""
    (text,) = _texts(spark, [list_file]).values()
    folder = list_file.rsplit("/", 1)[0]
    entries = [(f if f.startswith("/") or "://" in f else f"{folder}/{f}", n) for f, n in list_entries(text)]
    texts = _texts(spark, [f for f, _ in entries])
    return {n: curve(texts[f]) for f, n in entries}


def from_directory(spark: SparkSession, folder: str) -> dict[str, np.ndarray]:
    """Curves of all *.dat files below a folder; its filter_list.txt, if there is one, gives order and names."""
    texts = _texts(spark, [folder], "{*.dat,filter_list.txt}")
    root = re.sub("^file:/+", "/", folder).rstrip("/")
    listed = texts.get(f"{root}/filter_list.txt")
    if listed is not None:
        return {n: curve(texts[f if f.startswith("/") else f"{root}/{f}"]) for f, n in list_entries(listed)}
    return {re.sub(r"\.dat$", "", p.rsplit("/", 1)[-1]): curve(t) for p, t in sorted(texts.items()) if p.endswith(".dat")}


def as_table(spark: SparkSession, curves: dict[str, np.ndarray]) -> DataFrame:
    """band, position, curve."""
    return spark.createDataFrame([(n, i, [(float(a), float(b)) for a, b in c]) for i, (n, c) in enumerate(curves.items())], "band string, position int, curve array<struct<wl:double,tr:double>>")


def transmission(curves: dict[str, np.ndarray], band: str) -> np.ndarray:
    if band not in curves or curves[band] is None:
        raise MissingData(f"{band} has no transmission curve")
    return curves[band]
