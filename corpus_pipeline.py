"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet in the shared folder and read again as the next one's
docs. All but the last return the columns of documents; n_chars follows the text, and columns of any other name, also of those that the operators make, pass through.
Rows may repeat, ids and texts may be null, and texts empty or of any length: what each stage makes of them its operator's docstring says. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymatch.llm import line_dedup, mixing, neardup, packing, toxicity
from skymatch.llm.common import free_name, stored, table
from skymatch.llm.settings import TOKENIZER

#: No SQL expresses the trained model, the sampling keys' partition and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    verdict = free_name(docs, "toxicity")
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), result=verdict).where(F.col(verdict)["score"] < 0.5).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sites or more go, but for their first occurrence."""
    clean = line_dedup.dedup_lines(docs, counts=False)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.one_of_each(docs, neardup.NearDup(shingle=5, percent=80))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs, mixing.line_weight(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences."""
    return packing.pack_documents(docs, **TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_neardup", without_near_copies),
    ("mixing", mixed_sources),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
