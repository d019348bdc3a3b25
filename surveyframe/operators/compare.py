"""Side-by-side comparison: a row for each questionnaire, three columns for each group of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_hits(grouped: DataFrame) -> DataFrame:
    """file_name, sheet, group, question, answer, match_score of the first row of each group on each sheet, and n_hits."""
    rows = grouped.withColumns({"question": T.display_question("option_label", "prompt"), "merged": T.joined("side_answer", "answer")})
    first = F.min_by(F.struct("question", F.col("merged").alias("answer"), "match_score"), "ord").alias("first")
    return rows.groupBy("file_name", "sheet", "group").agg(first, F.count(F.lit(1)).alias("n_hits")).select("file_name", "sheet", "group", "first.*", "n_hits")


def duplicate_hits(grouped: DataFrame) -> DataFrame:
    """Groups that more than one row of a sheet falls into; only the first is shown in the comparison."""
    return first_hits(grouped).where("n_hits > 1").select("file_name", "sheet", "group", "n_hits").orderBy("file_name", "sheet", "group")


def pivot_to_wide(grouped: DataFrame, groups: list[int] | None = None) -> DataFrame:
    """Questionnaire, Sheet and, for each group g, Actual_Question Qg, Qg Answer and Qg Match Percentage; '' and null where
    absent. ``groups`` count from 0, the columns from 1."""
    if groups is None:
        groups = [r[0] for r in grouped.select("group").distinct().orderBy("group").collect()]
    hits = first_hits(grouped)
    wide = hits.groupBy("file_name", "sheet").pivot("group", groups).agg(F.first("question").alias("q"), F.first("answer").alias("a"), F.first("match_score").alias("m"))
    columns = [c for g in groups for c in (F.coalesce(F.col(f"{g}_q"), F.lit("")).alias(f"Actual_Question Q{g + 1}"), F.coalesce(F.col(f"{g}_a"), F.lit("")).alias(f"Q{g + 1} Answer"), F.col(f"{g}_m").alias(f"Q{g + 1} Match Percentage"))]
    return wide.select(F.col("file_name").alias("Questionnaire"), F.col("sheet").alias("Sheet"), *columns).orderBy("Questionnaire", "Sheet")


def widths(columns: list[str]) -> list[float]:
    """The widths of the comparison's columns in a workbook."""
    # Widths by what the column's name begins or ends with.
    kinds = [("Questionnaire", 28), ("Sheet", 22), ("Actual_Question ", 48), (" Answer", 36), (" Match Percentage", 10)]
    return [next((w for k, w in kinds if c.startswith(k) or c.endswith(k)), 18) for c in columns]
