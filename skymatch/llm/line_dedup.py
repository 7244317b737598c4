"""Line dedup: lines that stand on many distinct sites are boilerplate; all but their first occurrence go.

Each line with a word is known by two 64-bit hashes. One aggregation merges HyperLogLog sketches of the sites by line, together with the
first occurrence; partial aggregation shrinks hot lines before the shuffle. Lines whose estimate is near the threshold get exact distinct
counts. The lines to remove are joined back by their hash; texts are shuffled once, by document.

Nulls: a null text has no lines and stays null; a null site counts as one site of its own. Empty lines are never removed. Rows that repeat
with the same id and text are one document and are cleaned alike; of equal occurrences the one with the least (id, text hash, position) is
first. Other columns pass through unchanged, whatever their names, but n_lines and n_removed, which are replaced unless counts are not wanted.
Empty tables give empty results. Time is in proportion to a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, boxed, stored, unboxed


def line_hashes(text: Column) -> Column:
    """Structs (pos, a, b) of the lines that have a word."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(f"[^{SPACE}]"), F.struct(i.alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    return F.filter(lines, lambda x: x.isNotNull())


def spread(lines: DataFrame, min_sites: int, log_k: int = 10, margin: float = 0.25) -> DataFrame:
    """lines: a, b, site, key, version, pos. Lines on min_sites distinct sites or more: a, b, first (its first occurrence).

    Sketches decide where their estimate is further from min_sites than margin, relatively, and 1 absolutely, which for log_k = 10 is over seven standard errors.
    """
    site = F.xxhash64("site")  # sites are few against 2**64
    sketch = lines.groupBy("a", "b").agg(F.hll_sketch_agg(site, F.lit(log_k)).alias("_sketch"), F.count("*").alias("_n"), F.min(F.struct("key", "version", "pos")).alias("first"))
    # stored: else the joins below stand in one stage with this aggregation, and a hot line's partition can't be split
    seen = stored(sketch.where(F.col("_n") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("_sketch").alias("_sites")))
    low, high = min_sites - max(1.0, margin * min_sites), min_sites + max(1.0, margin * min_sites)
    near = seen.where((F.col("_sites") >= low) & (F.col("_sites") <= high))
    exact = lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", site.alias("site")).agg(F.lit(1).alias("_one")).groupBy("a", "b").agg(F.sum("_one").alias("_exact"))
    counted = near.join(exact.where(F.col("_exact") >= min_sites), ["a", "b"], "left_semi")
    return seen.where(F.col("_sites") > high).unionByName(counted).select("a", "b", "first")


def dedup_lines(docs: DataFrame, min_sites: int = 3, key: str = "doc_id", site: str = "source", text: str = "text", log_k: int = 10, counts: bool = True) -> DataFrame:
    """docs with text cleaned, and, with counts, n_lines, n_removed (lines with a word before, and removed), which replace columns of these names."""
    body = F.col("_row").getField(text)
    rows = docs.select(boxed(docs)).select("_row", F.col("_row").getField(key).alias("_id"), F.coalesce(F.xxhash64(body), F.lit(0).cast("long")).alias("_version"))
    lines = rows.select(F.col("_id").alias("key"), F.col("_version").alias("version"), F.col("_row").getField(site).alias("site"), F.explode(line_hashes(body)).alias("x"))
    lines = lines.select("key", "version", "site", "x.*")
    common = stored(spread(lines, min_sites, log_k))
    hits = lines.select("key", "version", "pos", "a", "b").join(common, ["a", "b"])
    hits = hits.where(~F.struct("key", "version", "pos").eqNullSafe(F.col("first")))
    gone = hits.groupBy(F.col("key").alias("_key"), F.col("version").alias("_v")).agg(F.collect_set("pos").alias("_gone"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_version") == F.col("_v")), "left")
    # what lies between the removed lines is cut out in one go each
    bounds = F.concat(F.array(F.lit(-1)), F.array_sort("_gone"), F.array(F.size(F.split(body, "\n"))))
    kept = bind(F.struct(F.split(body, "\n").alias("lines"), bounds.alias("at")), lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["at"]) - 2), lambda i: F.slice(x["lines"], F.get(x["at"], i) + 2, F.get(x["at"], i + 1) - F.get(x["at"], i) - 1))))
    clean = F.when(F.col("_gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    if not counts:
        return joined.select(*unboxed(docs.columns, **{text: clean})).select(*docs.columns)
    n_lines = F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))))
    n_removed = F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0))
    out = joined.select(*unboxed(docs.columns, **{text: clean, "n_lines": n_lines.cast("long"), "n_removed": n_removed.cast("long")}))
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
