"""The registered queries: the given tables as track documents, results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.llm.boilerplate import dedup_lines
from trackplace.llm.decontaminate import contaminated
from trackplace.llm.infill import fill_in_middle, restored
from trackplace.llm.languages import identify_languages
from trackplace.llm.mix import mixed_documents
from trackplace.llm.near import near_duplicates
from trackplace.llm.pages import extract_text
from trackplace.llm.personal import find_personal
from trackplace.llm.quality_rules import judge_tracks
from trackplace.llm.rule_ensemble import score_quality
from trackplace.llm.search import search_tracks
from trackplace.llm.secrets import scan_secrets
from trackplace.llm.urls import Rule, filter_urls

# The address rules of the registered query.
RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def tracks_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("track_id"), F.col("text").alias("document"), "lang", "source")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks_of(_table(spark, sf_dir, "documents"))


def _back(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("track_id", "doc_id")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(contaminated(_tracks(spark, sf_dir), _table(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _back(dedup_lines(_tracks(spark, sf_dir)))
    return rows.select("doc_id", "n_lines", "n_removed", F.col("document").alias("text"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), "quality")
    return _back(score_quality(_tracks(spark, sf_dir), labels))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(near_duplicates(_tracks(spark, sf_dir)))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(find_personal(_tracks(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(identify_languages(_tracks(spark, sf_dir)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(scan_secrets(_tracks(spark, sf_dir)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(judge_tracks(_tracks(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(mixed_documents(_tracks(spark, sf_dir))).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    rows = _back(fill_in_middle(_tracks(spark, sf_dir)))
    return rows.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(search_tracks(_tracks(spark, sf_dir), _table(spark, sf_dir, "benchmark")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_simhash": op4_simhash,
    "op5_personal_data": op5_personal_data,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_html_extraction": op13_html_extraction,
}
