"""The pipeline and the queries on the smallest tables."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import pieces, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(queries.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, DATA), f"test-{name}")
        now = Counter(r.doc_id for r in docs.collect())
        assert set(now) <= ids and now
        if name != "sentencepiece":
            assert docs.columns == columns
        if name in ("language_id", "toxicity", "near_duplicates"):
            assert max(now.values()) == 1
            ids = set(now)
    assert docs.columns == [*columns, "ids", "exact"] and docs.where("not exact").isEmpty()


def test_stages_keep_what_they_should(spark):
    """Each stage on the whole table against the query of its operator or plain counting."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = lambda name: Counter(r.doc_id for r in stages[name](spark, docs, DATA).collect())
    query = lambda name: queries.QUERIES[name](spark, DATA).collect()
    assert kept("language_id") == Counter(r.doc_id for r in query("op4_language_id") if not r.rejected)
    assert kept("toxicity") == Counter(r.doc_id for r in query("op8_toxicity") if r.score < 0.3)
    classes = {}
    for r in query("op1_near_duplicates"):
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert kept("near_duplicates") == Counter(min(ids) for ids in classes.values())
    # A document comes as often as the mix uses half of it: by its source's target and its place in the source's stream.
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for i, r in rows.items()}
    streams = {}
    for i in sorted(rows, key=lambda i: hashlib.md5(f"{i}:mix".encode()).hexdigest()):
        streams.setdefault(rows[i].source, []).append(i)
    target = {rows[r.doc_id].source: round(r.target) for r in query("op10_mixing")}
    want = Counter()
    for source, ids in streams.items():
        at = 0
        for i in ids * 2:
            used = min(size[i], max(0, target[source] - at))
            at += size[i]
            want[i] += 1 if used and 2 * used >= size[i] else 0
    got = kept("mixing")
    assert got == +want
    for source in streams:  # whole documents come near the target
        assert abs(sum(n * size[i] for i, n in got.items() if rows[i].source == source) - target[source]) <= max(size[i] for i in streams[source])
    for r in stages["sentencepiece"](spark, docs, DATA).collect():
        assert r.text is None or pieces.decode(r.ids, pieces.load()) == r.text


def test_registration():
    found = __spark_entry__.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
