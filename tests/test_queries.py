"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from surveyframe import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, fn, sql):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = fn(spark, DATA)
    wanted = con.sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = rows_of(found.columns, found.collect())
    assert rows == rows_of(wanted.columns, wanted.fetchall())
    assert rows, "a query without rows shows nothing"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_reports_show_something(spark, size):
    """Gaps, both kinds of drift, absent cells and more rows than the limits let through, on every size of the tables."""
    folder = os.path.join(os.path.dirname(DATA), size)
    if not os.path.isdir(folder):
        pytest.skip(f"{folder} isn't here")
    q = lambda name: queries.QUERIES[name](spark, folder)
    presence = q("question_presence").collect()
    assert len(presence) > 10 == q("top_gaps").count() and q("missing_pairs").count() == sum(r.missing_count for r in presence) > 10
    assert {r.drift_type for r in q("question_changes").select("drift_type").distinct().collect()} == {"formatting only", "substantive"}
    assert q("question_changes").where("drift_type = 'substantive'").select("canonical_id").distinct().count() > 8 == q("substantive_clusters").count()
    assert {"", "answered", "blank (optional)", "blank (missing)"} == {x for r in q("coverage_matrix").collect() for x in r[2:-1]}
    assert q("per_question_answer_rate").where("answer_rate < 1").count() > 10 == q("low_rates").count()
    assert {r.metric: r.value_num for r in q("overview").collect()}["questions with formatting-only drift"] > 0


def test_entry(spark):
    assert queries.entry(spark, DATA).count() > 0
