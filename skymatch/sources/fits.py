"""Binary tables of FITS files as DataFrames, and DataFrames as FITS files.

`spark.read.format("fits")` (after register) deals each file to tasks by ranges of bytes: a task reads the header by a few short reads, then the rows that begin in its range, batch
by batch, so neither files nor memory set a limit. Files of stores that only Spark can open are read whole by one task each, and must be below 2 GiB.
Integer columns with the offsets that mark unsigned numbers are shifted; other scalings apply as doubles. Integer nulls (TNULL) become nulls.

Writing makes a folder of whole files, each made by a task of a bounded number of rows, or with `single` one file that the commit step joins from them, copying
MBs at a time. Null integers get TNULL, null floats and arrays NaN, null booleans the format's zero byte, null strings are empty; only the last two don't come back as nulls. Arrays must have one length.
A failed write takes no file's place; parts of tasks that end later may stay in its folder `<path>.staging-*`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from ..errors import CorruptedFile, InvalidDimensions, MissingData, WrongFormat
from .files import RANGE, FileRange, opens, own_rows, ranges, store

BLOCK = 2880
#: Fixed values of the format: numpy type and bytes of a column code.
CODES = {"L": ("S1", 1), "B": ("u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "E": (">f4", 4), "D": (">f8", 8), "A": ("S", 1)}
SPARK: dict[str, DataType] = {"L": BooleanType(), "B": ShortType(), "I": ShortType(), "J": IntegerType(), "K": LongType(), "E": FloatType(), "D": DoubleType(), "A": StringType()}
WIDER = {"B": "I", "I": "J", "J": "K", "K": "D"}


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    repeat: int
    unit: str | None
    scale: float
    zero: float
    null: int | None

    @property
    def spark_code(self) -> str:
        if self.scale == 1 and self.zero == 0:
            return self.code
        if self.scale == 1 and self.code in WIDER and float(self.zero).is_integer():
            return WIDER[self.code]
        return "D"

    @property
    def spark_type(self) -> DataType:
        kind = SPARK[self.spark_code]
        return kind if self.code == "A" or self.repeat == 1 else ArrayType(kind)


#: Reads (start, length) of a file; short at its end.
Reads = Callable[[int, int], bytes]


def within(data: bytes) -> Reads:
    return lambda at, n: data[at : at + n]


def of_file(f: pa.NativeFile) -> Reads:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def cards(read: Reads, at: int) -> tuple[dict[str, str], int]:
    """Keywords of the header there, and where its data begin. Long strings are put together; COMMENT and HISTORY lines are joined by line ends."""
    out: dict[str, str] = {}
    last = ""
    while True:
        block = read(at, BLOCK).decode("ascii", "replace")
        if len(block) < BLOCK:
            raise CorruptedFile("a header has no end")
        at += BLOCK
        for card in (block[i : i + 80] for i in range(0, BLOCK, 80)):
            key, text = card[:8].strip(), card[8:]
            if key == "END":
                return out, at
            if key in ("COMMENT", "HISTORY"):
                out[key] = "\n".join(filter(None, [out.get(key), text.strip()]))
            elif card[8:10] == "= " or key == "CONTINUE" and last:
                value = text.removeprefix("= ").strip()
                if m := re.match(r"'((?:[^']|'')*)'", value):
                    value = m[1].replace("''", "'").rstrip()
                else:
                    value = value.split("/", 1)[0].strip()
                if key == "CONTINUE":
                    out[last] = out[last].removesuffix("&") + value
                else:
                    last = key
                    out[key] = value


def data_size(head: dict[str, str]) -> int:
    n = int(head.get("NAXIS", 0))
    if n == 0:
        return 0
    size = abs(int(head["BITPIX"])) // 8
    for i in range(1, n + 1):
        size *= int(head[f"NAXIS{i}"])
    return (size + int(head.get("PCOUNT", 0))) * int(head.get("GCOUNT", 1)) if size else int(head.get("PCOUNT", 0))


def find_table(read: Reads, size: int, hdu: int | str) -> tuple[dict[str, str], int]:
    """Header and place of the data of a table by number (the primary header is 0) or name, in a file of so many bytes."""
    if read(0, 6) != b"SIMPLE":
        raise WrongFormat("it isn't a FITS file")
    at, number = 0, 0
    while at < size:
        head, body = cards(read, at)
        if hdu == number or number and hdu == head.get("EXTNAME"):
            if head.get("XTENSION") != "BINTABLE":
                raise WrongFormat(f"{hdu} is no binary table")
            return head, body
        at, number = body + -(-data_size(head) // BLOCK) * BLOCK, number + 1
    raise MissingData(f"there is no table {hdu}")


def columns(head: dict[str, str]) -> list[Column]:
    out = []
    for i in range(1, int(head["TFIELDS"]) + 1):
        m = re.fullmatch(r"(\d*)([LBIJKEDA])\w*", head[f"TFORM{i}"])
        if not m:
            raise WrongFormat(f"columns of form {head[f'TFORM{i}']} can't be read")
        null = head.get(f"TNULL{i}")
        out.append(Column(head.get(f"TTYPE{i}", f"col{i}"), m[2], int(m[1] or 1), head.get(f"TUNIT{i}"), float(head.get(f"TSCAL{i}", 1)), float(head.get(f"TZERO{i}", 0)), int(null) if null else None))
    return out


def schema(cols: list[Column]) -> StructType:
    return StructType([StructField(c.name, c.spark_type, True, {"unit": c.unit} if c.unit else None) for c in cols])


@dataclass(frozen=True)
class Layout:
    """Where the rows of a table lie."""

    columns: list[Column]
    kind: np.dtype
    body: int
    rows: int
    head: dict[str, str]


def layout(read: Reads, size: int, hdu: int | str) -> Layout:
    head, at = find_table(read, size, hdu)
    cols = columns(head)
    kinds = [(f"c{i}", (CODES[c.code][0] + (str(c.repeat) if c.code == "A" else "")), () if c.code == "A" or c.repeat == 1 else (c.repeat,)) for i, c in enumerate(cols)]
    kind = np.dtype([(n, t, s) if s else (n, t) for n, t, s in kinds])
    width, n = int(head["NAXIS1"]), int(head["NAXIS2"])
    if kind.itemsize != width:
        raise CorruptedFile("row width and columns differ")
    if at + n * width > size:
        raise CorruptedFile("the table ends early")
    return Layout(cols, kind, at, n, head)


def same_columns(found: list[Column], wanted: StructType) -> None:
    """Raises where a file's columns or their units aren't those of the first file."""
    mine = schema(found)
    if mine.simpleString() != wanted.simpleString():
        raise WrongFormat("the files' columns differ")
    if differ := [f.name for f, g in zip(mine, wanted) if f.metadata.get("unit") != g.metadata.get("unit")]:
        raise WrongFormat(f"the files' units of {differ} differ")


def batches(l: Layout, rows: np.ndarray, names: list[str] | None) -> pa.RecordBatch:
    wanted = [(k, c) for k, c in enumerate(l.columns) if names is None or c.name in names]
    return pa.RecordBatch.from_arrays([arrow(c, rows[f"c{k}"]) for k, c in wanted], [c.name for _, c in wanted])


def arrow(c: Column, x: np.ndarray) -> pa.Array:
    kinds = {"L": pa.bool_(), "B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64(), "E": pa.float32(), "D": pa.float64()}
    if c.code == "A":
        return pa.array([v.split(b"\0")[0].decode("ascii", "replace").rstrip() for v in x], pa.string())
    flat = x.reshape(-1)
    gone = flat == c.null if c.null is not None and c.code in "BIJK" else None
    if c.code == "L":
        values, gone = flat == b"T", (flat != b"T") & (flat != b"F")
    else:
        values = flat.astype(flat.dtype.newbyteorder("="))
        if c.spark_code == "D" and c.code != "D":
            values = values.astype(float) * c.scale + c.zero
        elif c.spark_code != c.code:
            values = values.astype(np.int64) + int(c.zero)
        elif c.scale != 1 or c.zero:
            values = values * c.scale + c.zero
    out = pa.array(values, mask=gone).cast(kinds[c.spark_code])
    return out if x.ndim == 1 else pa.FixedSizeListArray.from_arrays(out, c.repeat).cast(pa.list_(kinds[c.spark_code]))


def hdu_of(value: int | str) -> int | str:
    return int(value) if str(value).isdigit() else value


class FitsReader(DataSourceReader):
    """Options: path (a file, a folder or a glob), hdu (number or name), columns (comma-separated; others aren't decoded), range (bytes a task), batch (rows), files (names in the folder, by line ends), places (adds _file and _row, a row's file and place there)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.hdu = options["path"], hdu_of(options.get("hdu", "1"))
        self.names = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.range, self.batch = int(options.get("range", RANGE)), int(options.get("batch", 20_000))
        self.parts = ranges(self.path, "", self.range, options["files"].split("\n") if options.get("files") else None)
        self.places = options.get("places", "").lower() == "true"
        self.whole = schema(self._layout(self.parts[0].path).columns)
        if self.names and (unknown := set(self.names) - set(self.whole.names)):
            raise MissingData(f"no columns {sorted(unknown)}")

    def _layout(self, path: str) -> Layout:
        files, _ = store(self.path)
        with files.open_input_file(path) as f:
            return layout(of_file(f), f.size(), self.hdu)

    def schema(self) -> StructType:
        place = [StructField("_file", StringType()), StructField("_row", LongType())] if self.places else []
        return StructType([*(f for f in self.whole if self.names is None or f.name in self.names), *place])

    def partitions(self) -> list[FileRange]:
        return self.parts

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        with files.open_input_file(part.path) as f:
            l = layout(of_file(f), f.size(), self.hdu)
            same_columns(l.columns, self.whole)
            width = l.kind.itemsize
            first, last = own_rows(part, l.body, width, l.rows)
            for at in range(first, last, self.batch):
                n = min(self.batch, last - at)
                f.seek(l.body + at * width)
                b = batches(l, np.frombuffer(f.read(n * width), l.kind, n), self.names)
                if self.places:
                    b = b.append_column("_file", pa.array([part.path.rpartition("/")[2]] * n)).append_column("_row", pa.array(range(at, at + n), pa.int64()))
                yield b


def card(key: str, value: bool | int | float | str) -> bytes:
    """The lines of a keyword; long strings go on in CONTINUE lines, comments and history in lines of their own."""
    if key.upper() in ("COMMENT", "HISTORY"):
        lines = [f"{key.upper():<8}{line[i : i + 72]}" for line in str(value).split("\n") for i in range(0, max(1, len(line)), 72)]
    elif isinstance(value, str):
        text, lines = value.replace("'", "''"), []
        while len(text) > 68:
            cut = 67 - (67 - len(text[:67].rstrip("'"))) % 2  # not between the two of a doubled quote
            lines.append(text[:cut] + "&")
            text = text[cut:]
        lines.append(text)
        lines = [f"{key.upper():<8}= '{lines[0]:<8}'", *(f"CONTINUE  '{x}'" for x in lines[1:])]
    else:
        lines = [f"{key.upper():<8}= {'T' if value is True else 'F' if value is False else repr(value).upper():>20}"]
    return b"".join(x.ljust(80).encode("ascii", "replace") for x in lines)


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % BLOCK)


PRIMARY = padded(card("SIMPLE", True) + card("BITPIX", 8) + card("NAXIS", 0) + card("EXTEND", True) + b"END".ljust(80), b" ")


@dataclass(frozen=True)
class Written:
    """How a column is written: length is that of its arrays, or the bytes of its strings; 1 for plain values."""

    name: str
    code: str
    length: int
    unit: str | None
    array: bool

    @property
    def kind(self) -> tuple:
        if self.code == "A":
            return self.name, f"S{self.length}"
        return (self.name, CODES[self.code][0], (self.length,)) if self.array else (self.name, CODES[self.code][0])

    @property
    def null(self) -> int | None:
        return {"I": -(2**15), "J": -(2**31), "K": -(2**63)}.get(self.code)


def written(schema_: StructType, lengths: dict[str, int], string: int) -> list[Written]:
    out = []
    for f in schema_:
        array = isinstance(f.dataType, ArrayType)
        kind = f.dataType.elementType if array else f.dataType
        codes = [c for c in "LIJKEDA" if SPARK[c] == kind]
        if kind.typeName() == "byte":
            codes = ["I"]
        if not codes or array and codes == ["A"]:
            raise WrongFormat(f"{f.name} of type {f.dataType.simpleString()} can't be written")
        out.append(Written(f.name, codes[0], lengths.get(f.name, 0) if array else string if codes == ["A"] else 1, (f.metadata or {}).get("unit"), array))
    return out


def header(cols: list[Written], rows: int, name: str, extra: dict) -> bytes:
    width = np.dtype([c.kind for c in cols]).itemsize
    out = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(cols)), ("EXTNAME", name)]
    for i, c in enumerate(cols, 1):
        out += [(f"TTYPE{i}", c.name), (f"TFORM{i}", f"{c.length}{c.code}")]
        out += [(f"TUNIT{i}", c.unit)] if c.unit else []
        out += [(f"TNULL{i}", c.null)] if c.null is not None else []
    return padded(b"".join(card(k, v) for k, v in [*out, *extra.items()]) + b"END".ljust(80), b" ")


def encoded(batch: pa.RecordBatch, cols: list[Written]) -> bytes:
    """The rows of a batch as the table holds them."""
    out = np.zeros(batch.num_rows, np.dtype([c.kind for c in cols]))
    for c, x in zip(cols, batch.columns):
        if c.code == "A":
            values = [(v or "").encode("ascii", "replace") for v in x.to_pylist()]
            if (longest := max(map(len, values), default=0)) > c.length:
                raise InvalidDimensions(f"{c.name} has strings of {longest} bytes, over {c.length}")
            out[c.name] = values
            continue
        if c.array:
            sizes = x.value_lengths().drop_null().unique().to_pylist()
            if any(s != c.length for s in sizes):
                raise InvalidDimensions(f"arrays of {c.name} have lengths {sizes}, not {c.length}")
            here = x.is_valid().to_numpy(zero_copy_only=False)
            flat, gone = x.drop_null().flatten(), c.null if c.null is not None else np.nan if c.code in "ED" else None
            whole = np.full((len(x), c.length), gone if gone is not None else b"\0", CODES[c.code][0])
            if here.any() and c.length:
                whole[here] = plain(flat, c).reshape(-1, c.length)
            out[c.name] = whole
        else:
            out[c.name] = plain(x, c)
    return out.tobytes()


def plain(x: pa.Array, c: Written) -> np.ndarray:
    """Numbers of a column, nulls as the format has them."""
    if c.code == "L":
        return np.array([b"\0" if v is None else b"T" if v else b"F" for v in x.to_pylist()], "S1")
    x = x.fill_null(c.null if c.null is not None else float("nan")) if x.null_count else x
    return x.to_numpy(zero_copy_only=False).astype(CODES[c.code][0])


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has written, with their rows, and its columns."""

    files: list[tuple[str, int]]
    columns: list[Written]


class FitsWriter(DataSourceArrowWriter):
    """Options: path, single (one file, to which append adds a table), rows (of a file at most), header (JSON of keywords), name (EXTNAME), string (bytes of strings, 64), lengths (JSON: array column -> length, which write_fits finds; else that of the task's first row)."""

    def __init__(self, options: dict[str, str], schema_: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.single, self.rows = options.get("single", "false").lower() == "true", int(options.get("rows", 100_000))
        self.extra, self.name = json.loads(options.get("header", "{}")), options.get("name", "DATA")
        self.fields, self.string, self.lengths = schema_, int(options.get("string", 64)), json.loads(options.get("lengths", "{}"))
        written(schema_, self.lengths, self.string)  # raises before any task starts
        self.staging = f"{store(self.path)[1]}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        files, _ = store(self.path)
        out, cols, held, n = [], None, [], 0

        def flush() -> None:
            nonlocal held, n
            if n:
                files.create_dir(self.staging, recursive=True)
                path = f"{self.staging}/part-{uuid.uuid4().hex}.fits"
                with files.open_output_stream(path) as f:
                    f.write(b"" if self.single else PRIMARY + header(cols, n, self.name, self.extra))
                    size = 0
                    for x in held:
                        f.write(x)
                        size += len(x)
                    f.write(b"" if self.single else b"\0" * (-size % BLOCK))
                out.append((path, n))
            held, n = [], 0

        for batch in iterator:
            if not batch.num_rows:
                continue
            if cols is None:
                first = {f.name: len(x[0]) for f, x in zip(self.fields, batch.columns) if isinstance(f.dataType, ArrayType) and f.name not in self.lengths for x in [x.drop_null()] if len(x)}
                cols = written(self.fields, first | self.lengths, self.string)
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                if n + part.num_rows > self.rows:
                    flush()
                held.append(encoded(part, cols))
                n += part.num_rows
        flush()
        return Parts(out, cols or [])

    def commit(self, messages: list[Parts | None]) -> None:
        files, at = store(self.path)
        done = [m for m in messages if m]
        parts = [p for m in done for p in m.files]
        kinds = {tuple(m.columns) for m in done if m.columns}
        try:
            if len(kinds) > 1:
                raise InvalidDimensions("arrays differ in length between tasks")
            cols = list(kinds.pop()) if kinds else written(self.fields, self.lengths, self.string)
            there = files.get_file_info(at).type
            if self.overwrite and there == fs.FileType.Directory:
                files.delete_dir(at)
            if self.single:
                self._join(files, at, cols, parts, not self.overwrite and there == fs.FileType.File)
            else:
                if self.overwrite and there == fs.FileType.File:
                    files.delete_file(at)
                files.create_dir(at, recursive=True)
                for k, (path, _) in enumerate(parts):
                    files.move(path, f"{at}/part-{k:05d}-{path.rpartition('-')[2]}")
                if not parts and not [f for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".fits")]:
                    with files.open_output_stream(f"{at}/part-00000.fits") as f:
                        f.write(PRIMARY + header(cols, 0, self.name, self.extra))
        finally:
            self.abort(messages)

    def _join(self, files: fs.FileSystem, at: str, cols: list[Written], parts: list[tuple[str, int]], more: bool) -> None:
        """One file of the parts' rows, behind the tables that are there already if more; it takes its place when it is whole."""
        whole, size = f"{self.staging}/whole", 0
        files.create_dir(self.staging, recursive=True)
        with files.open_output_stream(whole) as f:

            def copy(path: str) -> None:
                nonlocal size
                with files.open_input_stream(path) as source:
                    while chunk := source.read(8 << 20):
                        f.write(chunk)
                        size += len(chunk)

            if more:
                copy(at)
            else:
                f.write(PRIMARY)
            f.write(header(cols, sum(n for _, n in parts), self.name, self.extra))
            size = 0
            for path, _ in parts:
                copy(path)
            f.write(b"\0" * (-size % BLOCK))
        files.move(whole, at)

    def abort(self, messages: list[Parts | None]) -> None:
        files, _ = store(self.path)
        if files.get_file_info(self.staging).type == fs.FileType.Directory:
            files.delete_dir(self.staging)


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> StructType:
        return FitsReader(self.options).schema()

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def with_metadata(df: DataFrame, wanted: StructType) -> DataFrame:
    for f in wanted:
        if f.metadata:
            df = df.withMetadata(f.name, f.metadata)
    return df


def read_fits(spark: SparkSession, path: str, hdu: int | str = 1, batch: int = 20_000, columns: list[str] | None = None, range_bytes: int = RANGE, files: list[str] | None = None, places: bool = False) -> DataFrame:
    """The table of one file, or the tables of all files of a folder or glob, or of the named ones of a folder, which must have the first one's columns and units. Units go into column metadata. places: adds _file and _row."""
    if opens(path):
        register(spark)
        options = {"hdu": str(hdu), "batch": str(batch), "range": str(range_bytes), "columns": ",".join(columns or []), "files": "\n".join(files or []), "places": str(places)}
        return with_metadata(spark.read.format("fits").options(**options).load(path), FitsReader(options | {"path": path}).schema())
    if files or places:
        raise WrongFormat(f"files of {path} can't be read by ranges")
    return read_whole(spark, path, hdu, batch, columns)


def read_whole(spark: SparkSession, path: str, hdu: int | str = 1, batch: int = 20_000, names: list[str] | None = None) -> DataFrame:
    """As read_fits, through Spark's own reader of whole files."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(values: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in values:
            for v in b.column(0):
                data = v.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([schema(layout(within(data), len(data), hdu).columns).json()])], ["schema"])

    first = files.limit(1).mapInArrow(heads, "schema string").collect()
    if not first:
        raise MissingData(f"there is nothing at {path}")
    whole = StructType.fromJson(json.loads(first[0]["schema"]))
    wanted = StructType([f for f in whole if names is None or f.name in names])

    def rows(values: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in values:
            for v in b.column(0):
                data = v.as_py()
                l = layout(within(data), len(data), hdu)
                same_columns(l.columns, whole)
                x = np.frombuffer(data, l.kind, l.rows, l.body)
                for i in range(0, len(x), batch):
                    yield batches(l, x[i : i + batch], names)

    return with_metadata(files.mapInArrow(rows, wanted), wanted)


def write_fits(df: DataFrame, path: str, header: dict | None = None, single: bool = False, mode: str = "overwrite", name: str = "DATA", rows: int = 100_000, string: int = 64, lengths: dict[str, int] | None = None) -> None:
    """df as a folder of FITS files, or as a single file, to which mode `append` adds a table. header: more keywords; `comment` becomes comment lines. Units come from column metadata."""
    register(df.sparkSession)
    lengths = dict(lengths or {})
    if arrays := [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and f.name not in lengths]:
        found = df.agg(*(f(F.size(F.when(F.col(f"`{a}`").isNotNull(), F.col(f"`{a}`")))).alias(f"{k}{i}") for i, a in enumerate(arrays) for k, f in (("a", F.min), ("b", F.max)))).first()
        lengths |= {a: found[f"b{i}"] or 0 for i, a in enumerate(arrays)}
        if differ := [a for i, a in enumerate(arrays) if found[f"a{i}"] != found[f"b{i}"]]:
            raise InvalidDimensions(f"arrays of {differ} have several lengths")
    options = {"header": json.dumps(header or {}), "single": str(single), "name": name, "rows": str(rows), "string": str(string), "lengths": json.dumps(lengths)}
    df.write.format("fits").mode(mode).options(**options).save(path)


def read_header(path: str, hdu: int | str = 1) -> dict[str, str]:
    """Keywords of a table of one file, or of the first one of a folder or glob."""
    files, _ = store(path)
    with files.open_input_file(ranges(path, "", RANGE)[0].path) as f:
        return layout(of_file(f), f.size(), hdu).head
