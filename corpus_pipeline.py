"""The corpus pipeline: five stages from documents to a mix of sources.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes what a stage keeps as Parquet and gives the table read back to the next.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.llm.boilerplate import dedup_lines
from trackplace.llm.decontaminate import clean_tracks
from trackplace.llm.languages import UNKNOWN, identify_languages
from trackplace.llm.mix import mixed_texts
from trackplace.llm.near import distinct_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tracks(docs: DataFrame) -> DataFrame:
    return docs.select(COLUMNS).withColumnsRenamed({"doc_id": "track_id", "text": "document"})


def _documents(tracks: DataFrame) -> DataFrame:
    return tracks.withColumnsRenamed({"track_id": "doc_id", "document": "text"}).select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without one (``und``) go. Rows that
    share an id stay if one of them has a language."""
    known = identify_languages(_tracks(docs)).filter(F.col("lang_pred") != UNKNOWN)
    known = known.select(F.col("track_id").alias("_id")).distinct()
    return docs.select(COLUMNS).join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines that another one keeps; lines of
    one word count too."""
    rows = dedup_lines(_tracks(docs), least_words=1)
    changed = F.when(F.col("n_removed") > 0, F.length("document").cast("long")).otherwise(F.col("n_chars"))
    return _documents(rows.withColumn("n_chars", changed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of documents alike in five-word
    shingles; repeated rows leave one."""
    return _documents(distinct_documents(_tracks(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(clean_tracks(_tracks(docs), benchmark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a corpus: the texts of its slots, ``slot, source, doc_id, row,
    first, words, text``. In order of slot and row they follow the target weights
    in every stretch; a source beyond its target is left out in part."""
    return mixed_texts(_tracks(docs)).withColumnsRenamed({"track_id": "doc_id", "document": "text"})


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

# Byte models, components of links and seeds around hits have no SQL.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names; only a local session
    without that setting gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="trackplace-pipeline-")
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
