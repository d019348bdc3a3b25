from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from surveyframe.functions import similarity as S

VECTORS = [("small ring", "small rod", 74, 73.684), ("blue widget", "green widget", 71, 70.588), ("abc xyz", "xbc ayz", 43, 42.857), ("regulatory authority", "regulator authorities", 88, 87.805), ("who is the custodian", "who is the custodian please", 100, 100), ("公司名稱", "公司名稱", 0, 100), ("", "", 0, 0)]


def test_vectors(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _, _ in VECTORS], "a string, b string")
    found = rows.select(S.token_set_score(F.col("a"), F.col("b")), S.legacy_token_set_score("a", "b"), S.token_set_score(F.col("b"), F.col("a"))).collect()
    for (_, _, legacy, score), (x, y, z) in zip(VECTORS, found, strict=True):
        assert x == pytest.approx(score, abs=1e-3) and x == z and y == legacy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_against_table(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abcé ", k=rnd.choice([0, 1, 7, 59, 60, 61, 75]))), "".join(rnd.choices("abcé ", k=rnd.choice([0, 1, 9, 64, 80])))) for _ in range(150)]
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(S.lcs_length(F.col("a"), F.col("b"))).collect()]
    assert found == [lcs(a, b) for a, b in pairs]


def test_bound_holds(spark):
    rnd = random.Random(4)
    words = ["small", "ring", "rod", "blue", "a", "custodian", "authority"]
    pairs = [(" ".join(rnd.choices(words, k=rnd.randrange(5))), " ".join(rnd.choices(words, k=rnd.randrange(5)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(S.tokens(F.col("a")).alias("a"), S.tokens(F.col("b")).alias("b"))
    assert rows.where(S.tokens_bound(F.col("a"), F.col("b")) < S.tokens_score(F.col("a"), F.col("b")) - 1e-9).count() == 0
