"""Files that tasks read in parts: anything Arrow can open (local or mounted folders, hdfs, s3, gs), by ranges of bytes."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

from ..errors import MissingData

#: Schemes that Arrow opens.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
#: Bytes of a file that one task reads.
RANGE = 64 << 20


def opens(path: str) -> bool:
    """Whether Arrow can open files there; others are Spark's alone to read."""
    scheme, sep, _ = path.partition(":")
    return not sep or "/" in scheme or scheme in SCHEMES


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path in its store, bytes) of one file, of those of a folder, or of those that a glob names in its last part, in the order of their names. Names that begin with a dot or underscore are passed over."""
    files, at = store(path)
    at = at.rstrip("/")
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    glob = "*" + suffix
    if info.type == fs.FileType.NotFound:
        at, _, glob = at.rpartition("/")
    found = files.get_file_info(fs.FileSelector(at or "/", allow_not_found=True))
    out = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob) and f.base_name[0] not in "._")
    if not out:
        raise MissingData(f"there is nothing at {path}")
    return out


@dataclass
class FileRange(InputPartition):
    """Rows that begin at a byte from start to below stop of a file."""

    path: str
    start: int
    stop: int


def ranges(path: str, suffix: str, size: int, names: list[str] | None = None) -> list[FileRange]:
    """Ranges of the files that listed() finds, or of the named ones of a folder."""
    if names is None:
        found = listed(path, suffix)
    else:
        files, at = store(path)
        found = [(f.path, f.size) for f in files.get_file_info([f"{at.rstrip('/')}/{n}" for n in names])]
        if absent := [p for p, n in found if n is None]:
            raise MissingData(f"files are missing: {', '.join(absent[:5])}")
    return [FileRange(p, s, min(s + size, n)) for p, n in found for s in range(0, max(n, 1), size)]


def own_rows(part: FileRange, body: int, width: int, rows: int) -> tuple[int, int]:
    """First and last + 1 of the rows of a table at `body` that begin in a range. Rows without bytes are the first range's."""
    if not width:
        return (0, rows) if part.start == 0 else (0, 0)
    first, last = (max(0, min(rows, -(-(x - body) // width))) for x in (part.start, part.stop))
    return first, last
