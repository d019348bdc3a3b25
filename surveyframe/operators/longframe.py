"""The long frame: one row for each question of each questionnaire."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARSED_COLUMNS = ["file_name", "sheet", "section", "question_id", "sub_idx", "option_label", "prompt", "hint", "answer", "answer_cell", "side_answer", "side_answer_options", "side_answer_cell"]


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def missing_as_null(df: DataFrame, na_strings: list[str] | None = T.NA_STRINGS) -> DataFrame:
    """Text cells that a table reader takes for missing become null; None keeps them all."""
    texts = [n for n, kind in df.dtypes if kind == "string"]
    if not na_strings or not texts:
        return df
    return df.withColumns({n: F.when(~F.col(n).isin(na_strings), F.col(n)) for n in texts})


def question_text(df: DataFrame) -> Column:
    """The first non-blank of question and prompt, behind the option label if there is one."""
    body = F.coalesce(T.non_blank(_or_null(df, "question")), T.non_blank(_or_null(df, "prompt")))
    return T.joined(_or_null(df, "option_label"), body)


def answer_text(df: DataFrame) -> Column:
    """Side answer and answer, joined; '' without either."""
    return T.joined(_or_null(df, "side_answer"), _or_null(df, "answer"))


def questionnaire_id(file_name: Column, sheet: Column, by_sheet: bool = True) -> Column:
    """The file, with its sheet unless ``by_sheet`` is false; the sheet if there is no file."""
    name, part = F.coalesce(file_name, F.lit("")), F.coalesce(sheet, F.lit(""))
    if not by_sheet:
        return name
    return F.when(name == "", part).when(part == "", name).otherwise(F.concat(name, F.lit(" | "), part))


def load_long(frames: list[DataFrame], by_sheet: bool = True, extra_blank: list[str] | None = None, extra_conditional: list[str] | None = None, na_strings: list[str] | None = T.NA_STRINGS) -> DataFrame:
    """ord, questionnaire, file_name, sheet, question_id, question_text, answer, is_blank, conditional.

    Frames are parsed tables of either schema, each with ``ord``, its rows' place in the input; frames without a question
    or prompt are left out, other missing columns are empty. Rows without a question text go.
    """
    usable = [missing_as_null(f, na_strings) for f in frames if {"question", "prompt"} & set(f.columns)]
    if not usable:
        raise ValueError("no input has a question or a prompt")
    parts = []
    for f in usable:
        file_name, sheet = (F.coalesce(_or_null(f, n), F.lit("")) for n in ("file_name", "sheet"))
        parts.append(
            f.select(
                F.col("ord").cast("long").alias("ord"), questionnaire_id(file_name, sheet, by_sheet).alias("questionnaire"), file_name.alias("file_name"), sheet.alias("sheet"),
                F.coalesce(T.strip(_or_null(f, "question_id")), F.lit("")).alias("question_id"), question_text(f).alias("question_text"), answer_text(f).alias("answer"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts).where("question_text <> ''")
    return rows.withColumns({"is_blank": T.is_blank("answer", extra_blank), "conditional": T.is_conditional("question_text", extra_conditional)})


def load_all(frames: list[DataFrame], na_strings: list[str] | None = T.NA_STRINGS) -> DataFrame:
    """Parsed tables with a prompt as one, without rows of a blank prompt; sub_idx as a number, 0 if it is none."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [missing_as_null(f, na_strings) for f in frames])
    for n in PARSED_COLUMNS:
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(None).cast("string"))
    sub = F.coalesce(F.col("sub_idx").cast("string").try_cast("double"), F.lit(0.0)).cast("int")
    return rows.where(~T.is_blank("prompt")).withColumn("sub_idx", sub)
