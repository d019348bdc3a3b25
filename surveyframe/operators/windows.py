"""Sliding page windows, and what becomes of the items extracted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that a full text must have more than a truncated one.
SLACK = 5


def page_windows(sheets: DataFrame, window: int = 2, stride: int = 1, n_col: str = "n_pages") -> DataFrame:
    """``sheets`` with a row for each window: window_no from 0, and its pages. The last window ends on the last page; a
    stride above the window leaves gaps before it."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    n = F.col(n_col).cast("int")
    last = n - window + 1
    starts = F.when(n <= 0, F.array().cast("array<int>")).when(last <= 1, F.array(F.lit(1))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(stride)), F.array(last))))
    rows = sheets.select("*", F.posexplode(starts).alias("window_no", "start"))
    return rows.withColumn("pages", F.sequence(F.col("start"), F.least(F.col("start") + window - 1, n))).drop("start")


def completeness(question: Column, answer: Column) -> Column:
    """Orders partial extractions: an answer first, then the characters of both."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return F.struct((a != "").cast("int").alias("answered"), (F.length(q) + F.length(a)).alias("size"))


def place_keys(df: DataFrame) -> list[str]:
    """What tells where an item comes from: file_name, where there is one, and sheet."""
    return [c for c in ("file_name", "sheet") if c in df.columns]


def dedupe_by_id(items: DataFrame) -> DataFrame:
    """Of the items of one question of a file and sheet the most complete, the first to arrive of equals, with the pages of
    all of them."""
    keys = [*place_keys(items), "question_id"]
    best = F.struct(completeness(F.col("question"), F.col("answer")).alias("c"), (-F.col("arrival")).alias("early"))
    kept = F.max_by(F.struct("question", "answer", "answer_source", "arrival"), best).alias("kept")
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_pages")))).alias("source_pages")
    return items.groupBy(*keys).agg(kept, pages).select(*keys, "kept.question", "kept.answer", "source_pages", "kept.answer_source", "kept.arrival")


def in_question_order(items: DataFrame) -> DataFrame:
    """By file and sheet, then the numbers in the id, then the id."""
    return items.orderBy(*place_keys(items), T.digit_order("question_id"), "question_id")


def reconcile(items: DataFrame, truth: DataFrame, slack: int = SLACK) -> DataFrame:
    """An answer that is a truncated form of the cell's own is replaced by it.

    ``truth``: file_name (where the items have one), sheet, question_id, answer. Both are compared with white space collapsed and case folded; the cell's must
    begin with the item's and be longer by more than ``slack``. answer_source says which.
    """
    keys = [*place_keys(items), "question_id"]
    known = truth.select(*keys, F.col("answer").alias("truth"))
    full, short = T.normalise("truth"), T.normalise("answer")
    cut = F.coalesce((short != "") & full.startswith(short) & (F.length(full) > F.length(short) + slack), F.lit(False))
    rows = items.join(known, keys, "left").withColumn("cut", cut)
    return rows.withColumns({"answer": F.when(F.col("cut"), F.col("truth")).otherwise(F.col("answer")), "answer_source": F.when(F.col("cut"), "xlsx_reconciled").otherwise(F.col("answer_source"))}).select(items.columns)


def substitutions(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("answer_source") == "xlsx_reconciled").alias("n_substituted"))


def flat_items(items: DataFrame) -> DataFrame:
    """The seven columns of the flat table; pages as a list in text."""
    pages = F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ", ")
    file_name = F.col("file_name") if "file_name" in items.columns else F.lit("")
    return items.select(file_name.alias("file_name"), F.coalesce("sheet", F.lit("")).alias("sheet"), "question_id", "question", "answer", F.coalesce("answer_source", F.lit("llm")).alias("answer_source"), pages.alias("source_pages"))


def nested_items(items: DataFrame) -> DataFrame:
    """One JSON text for each file: file_name and its questions, pages as numbers."""
    file_name = F.col("file_name") if "file_name" in items.columns else F.lit("")
    order = F.struct("sheet", T.digit_order("question_id").alias("numbers"), "question_id")
    item = F.struct("question_id", "question", "answer", "source_pages", "answer_source", "sheet")
    one = items.groupBy(file_name.alias("file_name")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item")))).alias("q"))
    return one.select("file_name", F.to_json(F.struct("file_name", F.transform("q", lambda x: x["item"]).alias("questions"))).alias("json"))
