"""Media columns: binary payloads stored as lossless WebP images, read back as pixel arrays, with features of the pixels.

A payload is cut into images of at most 1 MiB, a byte to a pixel as a shade of grey and 64 pixels to a row; the files stand one after the other, each
knowing its size. They are compressed: green is subtracted, images of few shades get a palette, others row predictors where these help, repeated
stretches become back-references, and what is left gets prefix codes; reading back inverts all that.

Nulls and empties: a null text is empty; an empty text is stored as one row of zeros. Equal texts have equal values. Repeated rows are
stored alike, each on its own; texts have no greatest length. An empty table gives an empty result. round_trip ignores other columns;
encode_column and decode_column replace a column of the name that they make.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

UNIT = 64  # samples of a row


def padded(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of UNIT."""
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_media(payload: bytes) -> bytes:
    """The payload, of a multiple of UNIT bytes, as images."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return b"".join(webp.encode(rows[i : i + webp.MAX_SIDE]) for i in range(0, len(rows), webp.MAX_SIDE))


def to_pixels(media: bytes) -> np.ndarray:
    """uint8[rows, columns] of all images, one below the other; their pixels must be shades of grey."""
    out, at = [], 0
    while at < len(media):
        n = webp.file_size(media, at)
        image = webp.decode(media[at : at + n])
        grey = np.ascontiguousarray(image[:, :, webp.GREEN])
        if not ((image[:, :, webp.RED] == grey).all() and (image[:, :, webp.BLUE] == grey).all()):
            raise ValueError("the image has colours")
        out.append(grey)
        at += n
    return out[0] if len(out) == 1 else np.concatenate(out)


def feature(pixels: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and a hash of brightness differences over an 8 x 8 grid."""
    flat = pixels.reshape(-1)
    n, total = len(flat), int(flat.sum(dtype=np.int64))
    squares = int((np.bincount(flat, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    cells = np.add.reduceat(flat, np.arange(65) * n // 65, dtype=np.int64)
    bits = np.packbits(cells[1:] > cells[:-1]).tobytes().hex()
    mean = total / n
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{mean:.4f}:{max(0.0, squares / n - mean * mean) ** 0.5:.4f}:{bits}"


def encode_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column of the stored form."""

    @F.pandas_udf("binary")
    def apply(texts):
        return texts.map(lambda t: to_media(padded((t or "").encode("utf-8"))))

    return df.withColumn(media, apply(F.col(text)))


def decode_column(df: DataFrame, media: str = "media", pixels: str = "pixels") -> DataFrame:
    """df with a struct of height, width and samples (row by row); null for null media."""

    @F.pandas_udf("height int, width int, samples binary")
    def apply(files):
        import pandas as pd

        read = [to_pixels(f) for f in files]
        return pd.DataFrame({"height": [p.shape[0] for p in read], "width": [p.shape[1] for p in read], "samples": [p.tobytes() for p in read]})

    return df.withColumn(pixels, F.when(F.col(media).isNotNull(), apply(F.coalesce(F.col(media), F.lit(to_media(padded(b"")))))))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: each text stored and read back in one pass."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = to_media(padded(raw))
                pixels = to_pixels(media)
                back = pixels.tobytes()
                rows.append((doc_id.as_py(), len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in schema.split(", ")])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
