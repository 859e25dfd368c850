"""The registered queries of the corpus operators, one per operator, over the whole of their tables.

Each query calls its operator with production parameters and derives the contract's columns from what it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, ordinal_quality, quality_rules, suffix_dedup, suffix_tree_lm
from docloom.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_id() -> dict:
    return {"doc_id": F.col("doc_id")}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_tail (probability of the top grade), kept."""
    return ordinal_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), doc_id())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), folds=4, held=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), doc_id()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_id(), window=10)
    n_hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), num=90, den=100, size=3).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), doc_id(), length=200)
    return found.select("doc_id", "n_bytes", suffix_dedup.n_removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha256_hex(F.col("kept")).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), doc_id(), min_docs=10, min_chars=1, keep="none").select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license (the best covered template, if any), coverage, licenses (all found, comma-joined)."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), doc_id())
    return found.select("doc_id", "license", "coverage", F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 10) == 0
    model = suffix_tree_lm.train(docs.where(~held))
    return suffix_tree_lm.score(docs, model, doc_id() | {"held_out": held})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ordinal_quality, op2_language_id, op3_quality_rules, op4_decontaminate, op5_jaccard_join, op6_mixing, op7_suffix_dedup, op8_line_dedup, op9_license_scan, op10_suffix_tree)
}
