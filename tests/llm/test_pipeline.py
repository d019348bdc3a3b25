"""The pipeline against a brute-force version of its stages, each judged on its own input."""

from __future__ import annotations

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from surveyframe.llm import queries, simhash, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, tmp_path):
    docs = queries.table(spark, DATA, "documents")
    held = [{(r.doc_id, r.text) for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
            held.append({(r.doc_id, r.text) for r in out.collect()})
            assert held[-1] <= held[-2]
        docs = out

    chain = toxicity.train(queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels"), queries.categories())
    scores = {r.doc_id: r.p_toxic for r in toxicity.predict(queries.table(spark, DATA, "documents"), chain).collect()}
    assert held[1] == {(i, t) for i, t in held[0] if scores[i] < 0.5}

    last = {}
    for i, t in held[1]:
        last[t or ""] = max(i, last.get(t or "", i))
    assert held[2] == {(i, t) for i, t in held[1] if last[t or ""] == i}

    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in held[2]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert held[3] == {(i, t) for i, t in held[2] if find(i) == i}

    windows = set()
    for r in queries.table(spark, DATA, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = words(t)
        return not any(tuple(w[k : k + s]) in windows for s in sizes for k in range(len(w) - s + 1))

    assert held[4] == {(i, t) for i, t in held[3] if clean(t)}
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == {i for i, _ in held[4]}
    for i, t in held[4]:
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and rows[i].n_tokens == len(rows[i].ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, rows[i].ids)).encode()).hexdigest()
    assert 0 < len(held[4]) < len(held[0])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_stages_take_odd_rows(spark, tmp_path):
    schema = queries.table(spark, DATA, "documents").schema
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "same text here now ok", None, None, 5), (1, "same text here now ok", None, None, 5), (2, "a" * 100_000, "en", "s", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema).withColumn("row", F.lit(1))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (3 if rows else 0)


def test_queries_are_there():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    wanted = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, DATA)
    assert set(found.columns) == set(wanted.columns)
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(wanted.fetchall())
