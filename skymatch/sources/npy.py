"""Arrays of `.npy` files as DataFrames: `spark.read.format("npy")` (after register), by ranges of rows, so that one large file is read by many tasks.

Every row has `file` (the file's name) and `row` (its place there). Tables of named fields give a column a field; arrays give `value` (one dimension) or
`values` (nested arrays, or arrays of structs). Unsigned integers widen; those of 64 bits, complex numbers and objects can't be read. Several files must have one type.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..errors import CorruptedFile, WrongFormat
from .files import RANGE, FileRange, own_rows, ranges, store

#: Bytes in which a header lies; longer ones are read again.
HEAD = 1 << 16


def header(f: pa.NativeFile) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type of an element, and where the data begin."""
    size, n = f.size(), HEAD
    while True:
        f.seek(0)
        data = io.BytesIO(f.read(n))
        try:
            version = npy.read_magic(data)
            shape, fortran, kind = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[version](data, max_header_size=size)
        except (ValueError, KeyError) as e:
            if n < size and n < 64 * HEAD:
                n *= 8
                continue
            raise CorruptedFile(f"it isn't an array file: {e}") from e
        if fortran and len(shape) > 1 or not shape or kind.hasobject:
            raise WrongFormat("arrays by columns, single values and objects can't be read")
        if data.tell() + int(np.prod(shape, dtype=np.int64)) * kind.itemsize > size:
            raise CorruptedFile("the array ends early")
        return shape, kind, data.tell()


def arrow(x: np.ndarray) -> pa.Array:
    """[rows, ...] as a column."""
    if x.ndim > 1:
        inner = arrow(x.reshape(-1, *x.shape[2:]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), inner)
    if x.dtype.names:
        return pa.StructArray.from_arrays([arrow(np.ascontiguousarray(x[n])) for n in x.dtype.names], x.dtype.names)
    kind = x.dtype
    if kind.kind in "SU":
        return pa.array([v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in x.tolist()], pa.string())
    wider = {"u1": np.int16, "u2": np.int32, "u4": np.int64, "f2": np.float32}.get(kind.str[1:])
    if kind.kind not in "bif" and wider is None or kind.itemsize > 8:
        raise WrongFormat(f"values of type {kind} can't be read")
    return pa.array(np.ascontiguousarray(x.astype(wider or kind.newbyteorder("="))))


def columns(x: np.ndarray) -> dict[str, pa.Array]:
    if x.ndim == 1 and x.dtype.names:
        return {n: arrow(np.ascontiguousarray(x[n])) for n in x.dtype.names}
    return {"value" if x.ndim == 1 else "values": arrow(x)}


class NpyReader(DataSourceReader):
    """Options: path (a file, a folder or a glob), range (bytes a task), batch (bytes of rows at a time)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.range, self.batch = options["path"], int(options.get("range", RANGE)), int(options.get("batch", 8 << 20))
        self.parts = ranges(self.path, ".npy", self.range)
        self.kind = self._kind(self.parts[0].path)

    def _kind(self, path: str) -> tuple[tuple[int, ...], np.dtype]:
        with store(self.path)[0].open_input_file(path) as f:
            shape, kind, _ = header(f)
        return shape[1:], kind

    def schema(self) -> StructType:
        shape, kind = self.kind
        found = columns(np.zeros((0, *shape), kind))
        return StructType([StructField("file", StringType()), StructField("row", LongType()), *(StructField(n, from_arrow_type(a.type)) for n, a in found.items())])

    def partitions(self) -> list[FileRange]:
        return self.parts

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with store(self.path)[0].open_input_file(part.path) as f:
            shape, kind, body = header(f)
            if columns(np.zeros((0, *shape[1:]), kind)).keys() != columns(np.zeros((0, *self.kind[0]), self.kind[1])).keys() or kind != self.kind[1] or len(shape) != len(self.kind[0]) + 1:
                raise WrongFormat("the files' types differ")
            width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            first, last = own_rows(part, body, width, shape[0])
            step = max(1, self.batch // max(1, width))
            for at in range(first, last, step):
                n = min(step, last - at)
                f.seek(body + at * width)
                found = columns(np.frombuffer(f.read(n * width), kind).reshape(n, *shape[1:]))
                name = part.path.rpartition("/")[2]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), *found.values()], ["file", "row", *found])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        return NpyReader(self.options).schema()

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("range", range_bytes).load(path)
