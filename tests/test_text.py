from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from surveyframe.functions import text as T


def values(spark, inputs, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_norm_match(spark):
    cases = {"Q1 a) Firm Full Legal Name!": "firm full legal name", "3rd party": "rd party", "1.2.3 Foo": "foo", "2024 2023 revenue": "revenue", "  Question 7: Straße?": "strasse", "a.m. hours": "hours", "(if any)": "if any", "Q1": "", "???": "", None: ""}
    assert values(spark, cases, T.norm_match) == list(cases.values())


def test_long_numbering_needs_no_stack(spark):
    assert values(spark, ["1. " * 20_000 + "end", "a) " * 20_000 + "End", "1" * 100_000], T.norm_match) == ["end", "end", ""]


def test_casefold_agrees_with_python(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "ŉ", "ﬁne", "ABC", "ß ŉ ß", "İ".lower(), "Ǆ", "ẞ", ""]
    assert values(spark, texts, T.casefold) == [t.casefold() for t in texts]


def test_strip_knows_all_white_space(spark):
    texts = ["  a b\t\r\n", "\x1c\x85x　", " ", "a\n"]
    assert values(spark, texts, T.strip) == [t.strip() for t in texts]


def test_fill_class(spark):
    cases = {"D9D9D9": "grey", "C6EFCE": "green", "FFFF00": "yellow", "FFFFFF": "none", "000000": "none", "969696": "grey", "959595": "none", "F5F5F5": "grey", "FFZZZZZZ": "none", None: "none", "12": "none"}
    assert values(spark, cases, T.fill_class) == list(cases.values())


def test_blank(spark):
    assert values(spark, [None, "", " \t", " ", "N/A", "YES - n/a"], T.is_blank) == [True] * 4 + [False] * 2
    assert values(spark, ["N/A", " n/A ", "YES - n/a"], lambda c: T.is_blank(c, ["n/a"])) == [True, True, False]


@pytest.mark.parametrize(("text", "expected"), [("Economic data (If available: x)", True), ("tell us if you can", False), ("Please specify this\nif so", True), ("Name", False), ("(if any)", True), ("skip if none", True)])
def test_conditional(spark, text, expected):
    assert values(spark, [text], T.is_conditional) == [expected]


def test_section_header_and_ids(spark):
    rows = spark.createDataFrame([("PRODUCT PROCESS", True, 14.0), ("PRODUCT PROCESS", True, None), ("Product PROCESS", True, 14.0), ("ABCD", True, 14.0), ("12345", True, 14.0), ("PRODUCT", False, 14.0)], "t string, b boolean, s double")
    assert [r[0] for r in rows.select(T.is_section_header("t", "b", "s")).collect()] == [True, False, False, False, False, False]
    assert values(spark, ["Q12", " Q3  ", "q3", "Q3a", "Q", None], T.question_id) == ["Q12", "Q3", None, None, None, None]


def test_columns(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 26, 27, 40, 702, 703, 16384, 0, None)], "n int")
    assert [r[0] for r in rows.select(T.column_letters("n")).collect()] == ["A", "Z", "AA", "AN", "ZZ", "AAA", "XFD", None, None]
    assert [T.column_number(c) for c in ("A", "Z", "AA", "AN", "XFD")] == [1, 26, 27, 40, 16384]


def test_digit_runs(spark):
    assert values(spark, ["Q2", "Q10.3b", "none", None, "9" * 30], T.digit_runs) == [[2], [10, 3], [10**9], [10**9], [(1 << 63) - 1]]


def test_joined_and_lines(spark):
    rows = spark.createDataFrame([(" a ", "b"), ("", "b"), (None, None), ("a", " ")], "x string, y string")
    assert [r[0] for r in rows.select(T.joined("x", "y")).collect()] == ["a - b", "b", "", "a"]
    assert [r[0] for r in rows.select(T.append_line("x", "y")).collect()] == ["a \nb", "b", None, "a"]


def test_digit_order(spark):
    ids = ["Q2", "Q10", "Q010", "Q9", "", "x", "Q1.2", "Q1.10", "Q1", "Q" + "9" * 19, "Q" + "9" * 20, "Q1" + "0" * 25, "Q999999999", "Q1000000001", "Q٣", "Q4"]
    number = lambda t: [int(d) for d in re.findall(r"\d+", t)] or [10**9]
    found = [r.t for r in spark.createDataFrame([(t,) for t in ids], "t string").orderBy(T.digit_order("t"), "t").collect()]
    assert found == sorted(ids, key=lambda t: (number(t), t.encode()))
