"""The stages, the registered queries, and their SQL on the driver's small tables."""

import os

import duckdb
import pytest
from test_near import brute_similar

import __spark_entry__ as entry
import corpus_pipeline
from trackplace.llm.mix import mixed_documents
from trackplace.llm.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver data not here")


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    want = con.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    columns = sorted(frame.columns)
    rows = sorted(tuple(r) for r in frame.select(columns).collect())
    assert rows == sorted(want.select(*columns).fetchall())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = spark.createDataFrame([(10_000_001, "1 2 3", None, "s", 5), (10_000_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(none)
    known = corpus_pipeline.language_id(spark, docs, SMALL)
    assert known.columns == COLUMNS and known.count() == docs.count() - 2
    lines = corpus_pipeline.line_dedup(spark, known, SMALL)
    assert lines.columns == COLUMNS and lines.count() == known.count()
    near = corpus_pipeline.near_dedup(spark, lines, SMALL)
    rows = sorted((r.doc_id, r.text or "") for r in lines.collect())
    groups = brute_similar([text for _, text in rows])
    assert sorted(r.doc_id for r in near.collect()) == sorted(rows[i][0] for i in set(groups))
    clean = corpus_pipeline.decontamination(spark, near, SMALL)
    texts = [r.text.lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = [r for r in near.collect() if any(t in r.text.lower() for t in texts)]
    left = {r.doc_id for r in clean.collect()}
    assert held and not left & {r.doc_id for r in held}
    mixed = corpus_pipeline.source_mix(spark, clean, SMALL)
    of = {(r.doc_id, r.source): r.text for r in clean.collect()}
    pieces = mixed.collect()
    assert {"slot", "doc_id", "source", "text"} <= set(mixed.columns) and len(pieces) > 50
    assert all(p.text.strip(" \t\n\x0b\x0c\r") in of[p.doc_id, p.source] for p in pieces)
    taken = mixed_documents(clean.selectExpr("doc_id as track_id", "text as document", "source"))
    assert sum(p.words for p in pieces) == taken.agg({"taken": "sum"}).first()[0]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 100 and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_short_lines_of_many_sources_stay_once(spark):
    rows = [(d, f"text of document {d}\nAll rights reserved.\nend", "en", f"s{d}", 40) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert got == {0: rows[0][1]} | {d: f"text of document {d}" for d in range(1, 4)}
