"""A corpus pipeline of five stages; each works on all that the one before kept.

Stages, in order: documents that the quality classifier rejects go; lines found in many documents stay in the first
only (a document left without any words goes, as all it said is kept elsewhere); of each group of similar documents
the one with the smallest id stays; documents with benchmark passages go; the rest is mixed to source weights.

All columns of the documents are carried through, whatever they are called. Rows may repeat, ids and texts may be null, texts
may be empty or very long, and tables may be empty. Of rows with one id and text in a group of similar documents one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard_join, line_dedup, mixing, ordinal_quality
from docloom.llm.common import BROADCAST_BYTES, WORD, Scratch

def _carried(docs: DataFrame) -> dict[str, Column]:
    """All columns, under names that no operator adds."""
    return {f"__in_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}


def _back(df: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    return df.select(*[(changed or {}).get(c, F.col(f"__in_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _back(ordinal_quality.classify(docs, labels, _carried(docs)).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of a document that loses lines, and n_chars where there is one, are those of what is left."""
    left = line_dedup.dedup_lines(docs, _carried(docs), min_docs=10, min_chars=1, keep="first")
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    after = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return _back(left, docs, {c: F.when(F.col("n_dropped") > 0, x).otherwise(F.col(f"__in_{docs.columns.index(c)}")) for c, x in after.items() if c in docs.columns})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more. Rows are told apart by id and text; of equal rows one stays."""
    scratch = Scratch(spark)
    found = jaccard_join.similar_documents(docs, num=80, den=100, size=5, scratch=scratch).where("root is not null")
    found = scratch.save(found.select("doc_id", "text_hash", "root"), "found")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))  # sums of partial minima: a group of any size is no task of its own
    groups = found.groupBy("root").agg(one.alias("one"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = scratch.save(groups.select("root", F.col("one.doc_id").alias("first_id"), F.col("one.text_hash").alias("first_hash")), "groups")
    few = 24 * groups.count() <= BROADCAST_BYTES // 4
    members = found.join(F.broadcast(groups) if few else groups, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    members = members.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    members = scratch.save(members.where("not stays or rows > 1"), "members")
    n_away, n_again = members.agg(F.count(F.when(~F.col("stays"), 1)), F.count(F.when(F.col("stays"), 1))).first()
    away = members.where("not stays").select("__id", "__hash")
    away = F.broadcast(away) if 16 * n_away <= BROADCAST_BYTES // 4 else away
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    kept = hashed.join(away, same, "left_anti")
    if n_again:  # rows that share id and text with the one that stays
        again = members.where("stays").select("__id", "__hash")
        again = F.broadcast(again) if 16 * n_again <= BROADCAST_BYTES // 4 else again
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _back(decontaminate.find_benchmark(docs, items, _carried(docs)).where(F.size("spans") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, a row each, with the number of copies and the mix's figures; where a document's column has a figure's name, the figure's has mix_ before it."""
    mixed = mixing.mix(docs, keep=_carried(docs)).where("copies > 0")
    figures = [c for c in mixed.columns if not c.startswith("__in_")]
    return mixed.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)], *[F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in figures])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
]

#: The classifier and the similarity join are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and reread by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
