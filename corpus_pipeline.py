"""A training corpus from raw documents, in five stages; each gets what its predecessor kept.

In every filtering stage an empty table stays empty, columns beside doc_id, text, source and n_chars pass through whatever
their names, and rows are told apart by doc_id and text: rows without a doc_id, and rows that share one, are judged each
by its own text. A null text counts as an empty one, and stays null where its row stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import cut, maybe_broadcast, table, text_key
from provenir.llm.decontaminate import clean_of
from provenir.llm.lines import line_dedup
from provenir.llm.neardup import near_duplicates
from provenir.llm.packing import best_fit_packing
from provenir.llm.quality import quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality reaches 0.7. Empty texts are scored like others; equal rows go or stay together."""
    rejected = quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(F.col("doc_id").alias("__bad_doc"), F.col("th").alias("__bad_th")).distinct()
    return docs.join(maybe_broadcast(cut(rejected, "rejected")), F.col("doc_id").eqNullSafe(F.col("__bad_doc")) & (text_key(F.col("text")) == F.col("__bad_th")), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, with n_chars to match; a document that was nothing else goes. Empty and null texts stay."""
    out = line_dedup(docs, min_sites=10).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def _one_of_each(docs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows by ``keys``, of which several that share them leave the least by all their columns, as JSON. Single rows aren't moved."""
    again = cut(docs.groupBy(*keys).count().filter("count > 1").select(*[F.col(k).alias(f"__again_{k}") for k in keys]), "again")
    if again.isEmpty():
        return docs.select(columns)
    same = reduce(Column.__and__, (F.col(k) == F.col(f"__again_{k}") for k in keys))
    row = F.struct(*columns)
    least = docs.join(maybe_broadcast(again), same, "left_semi").groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return docs.join(maybe_broadcast(again), same, "left_anti").select(columns).unionByName(least)


def _near_dedup_by_text(docs: DataFrame, sha) -> DataFrame:
    """Near-dedup over (doc_id, hash of the text), numbered, as near_duplicates knows one document by its doc_id."""
    named = docs.filter("doc_id is not null").withColumn("__sha", sha)
    nodes = named.groupBy("doc_id", "__sha").agg(F.first("text").alias("text")).withColumn("__key", F.monotonically_increasing_id())
    nodes = cut(nodes, "nodes")
    found = near_duplicates(nodes.select(F.col("__key").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id")
    first = found.join(nodes.drop("text"), "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__sha")).alias("m"))
    kept = cut(first.select(F.col("m.doc_id").alias("__kept_doc"), F.col("m.__sha").alias("__kept_sha")), "kept")
    out = named.join(maybe_broadcast(kept), (F.col("doc_id") == F.col("__kept_doc")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    return _one_of_each(out, ["doc_id", "__sha"], docs.columns).unionByName(docs.filter("doc_id is null"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Rows of one doc_id with different texts are documents of their own. Rows of one doc_id and text are copies whatever
    their other columns, and the least by all columns (as JSON) stays. A null doc_id stays, and so does a text without
    words, which is near nothing.
    """
    sha = F.coalesce(F.sha2("text", 256), F.lit(""))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(sha).alias("a"), F.max(sha).alias("b"))
    if not ids.filter("a <> b").isEmpty():
        return _near_dedup_by_text(docs, sha)
    found = cut(near_duplicates(docs, width=5, percent=80), "near")
    gone = found.filter("not kept").select(F.col("doc_id").alias("__gone_doc")).distinct()
    out = docs.join(maybe_broadcast(gone), F.col("doc_id") == F.col("__gone_doc"), "left_anti")
    return _one_of_each(out.filter("doc_id is not null"), ["doc_id"], docs.columns).unionByName(out.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items, those without a doc_id too. Without test items all stay."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 words; a text without words is a piece of 0, and every row is packed."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
