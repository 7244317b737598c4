"""The registered queries of the subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, line_dedup, media, mixing, neardup, oracle, packing, pii, prefix_trie, quality_gam, quality_rules, toxicity, url_filter, window_packing
from .common import held_out, table
from .settings import TOKENIZER, WORD_TOKENIZER

URL_RULES = [url_filter.UrlRule("net/", "block"), url_filter.UrlRule("example.net/en/", "allow"), url_filter.UrlRule("example.com/de/", "block"), url_filter.UrlRule("org/fr/", "allow")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **TOKENIZER)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.search(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), neardup.NearDup(shingle=3, percent=85)).select("doc_id", "n_shingles", "component_id", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.line_weight(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_gam.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    out = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, labels)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    return prefix_trie.trie(*prefix_trie.spliced(positions, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, most=5))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label")
    moved = F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, sf_dir, "embeddings").select(id_, moved.alias("label"), hard_negatives.scaled(F.col("embedding")).alias("v"))
    return hard_negatives.mine(vectors, id_ % 50 == 0)


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_packing.pack_windows(table(spark, sf_dir, "documents"), **WORD_TOKENIZER)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_best_fit_packing, op3_pii, op4_media_columns, op5_toxicity, op6_minhash_neardup, op7_mixing, op8_quality_gam, op9_line_dedup, op10_url_filter, op11_prefix_trie, op12_hard_negatives, op13_window_packing)
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": oracle.op1(),
    "op6_minhash_neardup": oracle.op6(),
    "op7_mixing": oracle.op7(),
    "op9_line_dedup": oracle.op9(),
    "op10_url_filter": oracle.op10(URL_RULES),
    "op11_prefix_trie": oracle.op11(),
    "op12_hard_negatives": oracle.op12(),
}
