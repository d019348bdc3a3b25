"""Queries over the long frame take every row of the table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from surveyframe import queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")

#: The wording that each part is given.
TEXT = "trim(case p_partkey % 5 when 0 then p_name when 1 then concat('Q', size, '. ', upper(p_name)) when 2 then concat(p_name, '?') when 3 then concat(p_name, ' (if any)') else replace(p_name, ' ', '  ') end)"


def lacking(part):
    """Questionnaires, and those with a blank that isn't conditional: an empty answer or 'N/A', without '(if any)'."""
    key = F.col("p_partkey")
    lacks = ((key % 4 == 0) | (key % 9 == 0)) & (key % 5 != 3)
    each = F.struct("file_name", "sheet")
    return tuple(part.agg(F.count_distinct(each), F.count_distinct(F.when(lacks, each))).first())


#: What a query shows of the rows that it has taken, and the same of the table.
WHOLE = {
    "load_long": (lambda out: out.count(), lambda part: part.count()),
    "load_all": (lambda out: out.count(), lambda part: part.count()),
    "per_questionnaire_missing": (lambda out: out.agg(F.sum("n_questions")).first()[0], lambda part: part.count()),
    "text_order": (lambda out: out.agg(F.sum("freq")).first()[0], lambda part: part.count()),
    "distinct_counts": (lambda out: tuple(out.first()), lacking),
    "cluster_texts": (lambda out: out.count(), lambda part: part.selectExpr(TEXT).distinct().count()),
    "clusters_audit": (lambda out: out.count(), lambda part: part.count()),
    "comparison_wide": (lambda out: sum(v is not None for r in out.collect() for c, v in r.asDict().items() if c.endswith("Percentage")), lambda part: part.select("file_name", "sheet", "size").distinct().count()),
    "duplicate_hits": (lambda out: out.agg(F.sum("n_hits")).first()[0], lambda part: part.groupBy("file_name", "sheet", "size").count().where("count > 1").agg(F.sum("count")).first()[0]),
    "comparison_groups": (lambda out: out.count(), lambda part: part.count()),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_row_is_taken(spark, name):
    seen, held = WHOLE[name]
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", F.col("p_brand").alias("file_name"), F.col("p_type").alias("sheet"), F.col("p_size").alias("size"), "p_name")
    assert seen(queries.QUERIES[name](spark, DATA)) == held(part)
