"""Mixing sources to target weights by weighted sampling without replacement, with exponential keys.

A document of quality weight w gets the key -ln(u) / w, u being drawn from its id, so reruns agree. Sorted by key within its source, the
documents before the budget are the sample. A source whose target is above its size is taken in complete epochs first; the keys decide
about the rest. Prefix sums are two-level: sums of (source, key range) first, then inside each range, so that no task holds a source.

Nulls: a null source is a source, ordered last; a null text has size 0 and is never taken; a null or non-positive weight counts as the least
positive one. Rows that share an id are rows of their own, told apart by a hash of the whole row; rows equal in all columns have the same key and are taken one by one, in any order.
Empty tables give empty results. Other columns pass through `mixed` whatever their names; `mix` returns columns of its own only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, boxed, n_words, row_hash, stored, unboxed

LEAST_WEIGHT = 1e-6


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 sum."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def line_weight(text: Column) -> Column:
    """Quality weight: the share of distinct lines with a word, and half of that where symbols are more than a tenth of the words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    distinct = F.size(F.array_distinct(lines)).cast("double") / F.greatest(F.size(lines), F.lit(1)).cast("double")
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
    return F.greatest(distinct, F.lit(0.05)) * F.when(symbols * 10 > n_words(text), 0.5).otherwise(1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds target: share of all sizes dealt by weights (repeated over the ordered sources), none above most times its size.

    Sources are put in order of the level at which they are full; those full below the level that the others share are capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / weight_left)
    rows = rows.withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_w"))
    rows = rows.withColumn("_shared", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("source"), F.col("_level").alias("level")))).over(everything)["level"])
    return rows.select("source", "source_size", F.when(F.col("_open"), F.least("_cap", F.col("_w") * F.col("_shared"))).otherwise(F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weight: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text", rows_a_range: int = 100_000, seed: str = "mix") -> DataFrame:
    """doc_id, row (a hash of the whole row), source, size, source_size, target, copies (times the mix takes it), taken (words: copies * size), a row for each row of docs."""
    w = F.greatest(F.coalesce(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    slim = docs.select(F.col(key).alias("doc_id"), row_hash(docs, text).alias("row"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), (-F.log(uniform(F.col(key), seed)) / w).alias("_key"))
    slim = stored(slim)
    n = slim.count()  # from the footers
    ranges = max(256, n // rows_a_range)
    slim = slim.withColumn("_range", F.least(F.floor(F.col("_key") / (1 + F.col("_key")) * ranges), F.lit(ranges - 1)))
    parts = slim.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    goal = targets(parts.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, most)
    up_to = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
    parts = parts.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_n")
    parts = parts.withColumnsRenamed({"source": "_s", "_range": "_r"})
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.withColumn("_upto", F.sum("size").over(inside))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    end = (F.col("_before") + F.col("_upto")).cast("double")
    more = F.when((F.col("size") > 0) & (end - F.col("size") / 2.0 <= rest), 1).otherwise(0)  # the nearer side of the budget
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, epochs + more).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "row", "source", "size", F.col("source_size").cast("long"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weight: Column, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    plan = mix(docs, weight, key=key, source=source, text=text, **how)
    # rows equal in all columns are one here, with all their copies
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_r")).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    rows = docs.select(boxed(docs), row_hash(docs, text).alias("_hash"))
    rows = rows.join(plan, F.col("_row").getField(key).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_r")))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_r").orderBy("_copies"))).where("_rank = 1")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*unboxed(docs.columns))
