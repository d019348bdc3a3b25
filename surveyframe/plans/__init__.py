"""Whole runs: from parsed tables to a report or a comparison, from workbooks to sub-questions, from pages to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cluster, compare, grid, longframe, report, windows
from ..sources import extract, xlsx
from ..storage import cut

# Columns of the report that are shown wide.
REPORT_WIDE = {"canonical_text", "question_text", "variant_text", "Question", "used_by", "present_in", "missing_from", "source_question_ids", "answer"}
LLM_COLUMNS = ["file_name", "sheet", "question_id", "question", "answer", "answer_source", "source_pages"]


def analyse(long: DataFrame, threshold: float = 85) -> dict[str, DataFrame]:
    """The report tables over a long frame, by sheet name."""
    rows = cut(cluster.with_clusters(long, threshold))
    labels = cut(report.canonical_labels(rows))
    return {
        "overview": report.overview(rows, threshold),
        "questionnaire_missing": report.per_questionnaire(rows),
        "question_answer_rate": report.per_question(rows, labels),
        "question_changes": report.question_changes(rows, labels),
        "coverage_matrix": report.coverage_matrix(rows, labels),
        "question_presence": report.question_presence(rows, labels),
        "clusters": report.clusters_audit(rows, labels),
    }


def analyse_files(spark: SparkSession, path: str, output: str | None = None, threshold: float = 85, by_sheet: bool = True, extra_blank: list[str] | None = None, extra_conditional: list[str] | None = None) -> dict[str, DataFrame]:
    """Parsed workbooks of either schema under ``path`` to the report; written to ``output`` if given."""
    files = xlsx.list_files(spark, path)
    columns = list(dict.fromkeys([*longframe.PARSED_COLUMNS, *LLM_COLUMNS]))
    long = longframe.load_long([xlsx.read_tables(files, columns)], by_sheet, extra_blank, extra_conditional)
    if (long := cut(long)).isEmpty():
        raise ValueError("no questions found")
    tables = analyse(long, threshold)
    if output:
        xlsx.write_workbook(tables, output, wide_columns=REPORT_WIDE)
    return tables


def digest(tables: dict[str, DataFrame]) -> list[str]:
    """The report in a few lines: answers missing, the lowest rates, changed wordings and gaps."""
    from pyspark.sql import functions as F

    out = ["Missing answers"]
    for r in tables["questionnaire_missing"].toLocalIterator():
        rate = "n/a" if r.required_answer_rate is None else f"{r.required_answer_rate:.0%}"
        out.append(f"  {r.questionnaire}: {r.n_answered} of {r.n_questions} ({r.answer_rate:.0%}), required missing {r.n_required_missing} (rate {rate})")
    out.append("Lowest answer rates")
    out += [f"  {r.canonical_id} {r.answer_rate:.0%} ({r.answered} of {r.instances}){' [conditional]' if r.is_conditional else ''}: {r.canonical_text[:70]}" for r in report.low_rates(tables["question_answer_rate"]).collect()]
    changes = tables["question_changes"]
    drift = {r.drift_type: r.n for r in changes.groupBy("drift_type").agg(F.count_distinct("canonical_id").alias("n")).collect()}
    out.append(f"Changed wordings: {drift.get('substantive', 0)} in substance, {drift.get('formatting only', 0)} in form only")
    shown = report.substantive_clusters(changes).collect()
    of_shown: dict[str, list] = {r.canonical_id: [] for r in shown}
    for r in changes.where(F.col("canonical_id").isin(list(of_shown))).toLocalIterator():
        of_shown[r.canonical_id].append(f"    {r.used_by_count} times: {r.variant_text[:80]}")
    for r in shown:
        out += [f"  {r.canonical_id}, {r.n_variants} wordings: {r.Question[:80]}", *of_shown[r.canonical_id]]
    total = tables["questionnaire_missing"].count()
    out.append(f"Gaps: {tables['question_presence'].count()} questions are not in every questionnaire")
    out += [f"  {r.canonical_id} in {r.present_count} of {total}, missing from {r.missing_from[:60]}: {r.canonical_text[:50]}" for r in report.top_gaps(tables["question_presence"]).collect()]
    return out


def compare_files(spark: SparkSession, path: str, output: str | None = None, threshold: int = 80) -> DataFrame:
    """Parsed workbooks to the wide comparison."""
    rows = longframe.load_all([xlsx.read_tables(xlsx.list_files(spark, path), longframe.PARSED_COLUMNS, sheet=None)])
    grouped = cut(cluster.cluster_rows(cut(rows), threshold))
    wide = compare.pivot_to_wide(grouped)
    if output:
        xlsx.write_workbook({"comparison": wide}, output, {"comparison": compare.widths(wide.columns)}, freeze=False)
    return wide


def parse_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Styled workbooks to cells (resolved), sub_questions, remarks and json."""
    files = xlsx.list_files(spark, path, "parse")
    parts = cut(xlsx.read_parts(files))
    resolved = cut(grid.resolved_cells(xlsx.cells_of(parts), xlsx.merges_of(parts), xlsx.dropdowns_of(parts)))
    flat, notes = cut(grid.sub_questions(resolved)), grid.remarks(resolved)
    return {"cells": resolved, "sub_questions": flat, "remarks": notes, "json": grid.nested_sheets(flat, notes, grid.source_rows(resolved))}


def extract_items(pages: DataFrame, make_extractor, window: int = 2, stride: int = 1, truth: DataFrame | None = None, attempts: int = extract.ATTEMPTS) -> DataFrame:
    """Pages (file_name, sheet, page_no, png) to reconciled items, in question order; ``truth`` as for ``windows.reconcile``.
    Sheets of the same name in different files stay apart."""
    from pyspark.sql import functions as F

    keys = windows.place_keys(pages)
    sheets = pages.groupBy(*keys).agg(F.max("page_no").alias("n_pages"))
    spans = windows.page_windows(sheets, window, stride).select(*keys, "window_no", "pages")
    cells = spans.select(*keys, "window_no", "pages", F.explode("pages").alias("page_no")).join(extract.fit_images(pages.select(*keys, "page_no", "png")), [*keys, "page_no"])
    images = cells.groupBy(*keys, "window_no", "pages").agg(F.array_sort(F.collect_list(F.struct("page_no", "png"))).alias("p"))
    ready = images.select(*keys, "window_no", "pages", F.transform("p", lambda x: x["png"]).alias("images"))
    items = extract.response_items(extract.extract_windows(ready, make_extractor, attempts))
    kept = windows.dedupe_by_id(items)
    return windows.in_question_order(kept if truth is None else windows.reconcile(kept, truth))
