"""Uniform numbers that hang on keys and a seed alone, so that retried tasks, other layouts and other engines draw the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number: 52 bits, which a double holds.
DIGITS = 13


def uniform(seed: int, *keys: Column) -> Column:
    """Between 0 and 1, without either: the first 52 bits of the MD5 of the keys and the seed as decimal text, joined by colons, and a half."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") for k in keys), F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(16.0**DIGITS)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same for engines with md5() and hexadecimal literals."""
    text = " || ':' || ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), f"'{seed}'"])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS BIGINT) AS DOUBLE) + 5e-1) / {16**DIGITS}e0"
