"""Inputs of the registered queries, made from the test tables; `oracle` has the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = [f"b{i}" for i in range(6)]
BINS = [i * 0.25 for i in range(-8, 57)]
SAMPLES = 20
COEFFICIENTS = {b: 3.0 - 0.25 * i for i, b in enumerate(BANDS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photometry(df: DataFrame, key: str) -> DataFrame:
    f = [F.col("embedding")[i].cast("double") for i in range(len(BANDS))]
    return df.select(F.col("vec_id").alias(key), *(c.alias(f"f_{b}") for c, b in zip(f, BANDS)), *((F.lit(0.01) + F.lit(0.05) * F.abs(c)).alias(f"e_{b}") for c, b in zip(f, BANDS)), "label")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photometry(table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0"), "target_id").drop("label")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photometry(table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0"), "ref_id")
    return rows.withColumn("z", F.col("label").cast("double")).withColumn("weight", F.lit(1.0) + (F.col("ref_id") % 3).cast("double")).drop("label")


def exact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without errors, so that best scales have a closed form."""
    return refs(spark, sf_dir).withColumns({f"e_{b}": F.lit(0.0) for b in BANDS})


def ebv(key: Column) -> Column:
    return (key % 7).cast("double") / F.lit(100.0)


def shift(key: Column, i: int) -> Column:
    return ((key + i) % 9 - 4).cast("double") / F.lit(10.0)


def coloured_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("target_id")
    return targets(spark, sf_dir).withColumn("ebv", ebv(k)).withColumn("shifts", F.struct(*(shift(k, i).alias(b) for i, b in enumerate(BANDS[:4]))))


def corrected_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ref_id")
    made = {f"ebv_{b}": F.lit(1.0 + 0.25 * i) + (k % 3).cast("double") / F.lit(10.0) for i, b in enumerate(BANDS)}
    made |= {f"c0_{b}": (k % 4).cast("double") / F.lit(100.0) for b in BANDS} | {f"c1_{b}": (k % 6 - 2).cast("double") / F.lit(100.0) for b in BANDS}
    return refs(spark, sf_dir).withColumns(made)


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.array(*(F.lit(b) for b in BINS))
    return refs(spark, sf_dir).select("ref_id", F.transform(bins, lambda b: F.exp(F.lit(-0.5) * F.pow((b - F.col("z")) / F.lit(0.7), F.lit(2.0)))).alias("p"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ref_id")

    def one(n: Column) -> Column:
        p1 = F.col("z") + ((k * 7 + n * 13) % 41 - 20).cast("double") / F.lit(10.0)
        return F.struct(p1.alias("p1"), (((k * 3 + n * 17) % 29).cast("double") / F.lit(10.0)).alias("p2"), ((k + n * 5) % 8).cast("int").alias("i1"))

    return refs(spark, sf_dir).select("ref_id", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), one).alias("s"))


def bulk_photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of orders: sums of integers, so that no order of addition matters."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("a"), F.sum(F.round("l_quantity").cast("long")).alias("b"), F.count("*").alias("c"), F.sum(F.col("l_partkey") % 97).alias("d"))
    f = {"b0": F.col("a") / F.lit(1e6), "b1": F.col("b") / F.lit(1e1), "b2": F.col("c").cast("double"), "b3": F.col("d") / F.lit(1e1)}
    return rows.select("l_orderkey", *(v.alias(f"f_{b}") for b, v in f.items()), *((F.lit(0.1) + F.lit(0.05) * F.abs(v)).alias(f"e_{b}") for b, v in f.items()))
