"""Places of rows in a global order, and whether two lists hold the same in the same order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MissingData
from ..sources.scratch import stored


def numbered(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """df with the place (long, from 0) of each row in an order, which should leave no ties. Other columns stay; none may be called _part.

    Rows are dealt to ranges of the order, which are stored; a row's place is what lies in the ranges before its own, a number a range, and its rank inside it.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range: as many as the shuffle has partitions
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_rank", inside).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_rank") - 1).alias(name))


def out_of_order(a: DataFrame, b: DataFrame, key: str, position: str = "position") -> DataFrame:
    """position, and the keys that two lists (key and position) have there, where they differ; null where a list has ended."""
    left, right = (df.select(F.col(position).alias("position"), F.col(key).alias(n)) for df, n in ((a, "left"), (b, "right")))
    return left.join(right, "position", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def checked_order(a: DataFrame, b: DataFrame, key: str, position: str = "position") -> DataFrame:
    """a, if b holds the same keys at the same places."""
    wrong = out_of_order(a, b, key, position).orderBy("position").head()
    if wrong is not None:
        raise MissingData(f"at {wrong['position']} one list has {wrong['left']}, the other {wrong['right']}")
    return a
