"""Queries op1..op13 with production parameters, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import licenses, lines, seeds, sessions, trie
from provenir.llm.common import table
from provenir.llm.decontaminate import contaminated
from provenir.llm.neardup import near_duplicates
from provenir.llm.packing import best_fit_packing
from provenir.llm.quality import quality
from provenir.llm.rules import quality_rules
from provenir.llm.simhash import simhash_duplicates
from provenir.llm.suffixes import suffix_array_dedup
from provenir.llm.toxicity import toxicity

MIN_SITES = 10
RUN = 35


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7).drop("th")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seeds.seed_and_extend_dedup(table(spark, sf_dir, "documents"), length=RUN)
    return out.select("doc_id", out.n_tokens.alias("n_words"), "n_removed", "kept_sha256")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return best_fit_packing(docs, near_duplicates(docs, width=5, percent=80))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.shared_heads(trie.sequences(table(spark, sf_dir, "conversations"))))


def op13_session_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_gaps(table(spark, sf_dir, "clicks"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_quality_rules,
        op4_suffix_array_dedup,
        op5_minhash_near_dedup,
        op6_quality_classifier,
        op7_substring_dedup,
        op8_license_scan,
        op9_best_fit_packing,
        op10_benchmark_decontamination,
        op11_simhash_near_dedup,
        op12_prefix_trie,
        op13_session_closing,
        pipeline,
    )
}
ORACLES = {"op1_line_dedup": lines.oracle(MIN_SITES), "op7_substring_dedup": seeds.oracle(RUN), "op8_license_scan": licenses.oracle(), "op12_prefix_trie": trie.oracle(), "op13_session_closing": sessions.oracle()}
