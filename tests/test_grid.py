from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from surveyframe import fixtures
from surveyframe.operators import grid
from surveyframe.operators.ranges import band_index
from surveyframe.storage import cut


def test_demo_grid(spark):
    resolved = grid.resolved_cells(*fixtures.demo_grid(spark))
    rows = grid.sub_questions(resolved).orderBy("segment", "sub_idx").collect()
    got = [(r.question_id, r.sub_idx, r.option_label, r.prompt.split("\n")[0][:30], r.hint[:20], r.answer[:20], r.answer_cell, r.side_answer, r.side_answer_cell) for r in rows]
    assert got == [
        ("Q1", 0, "", "Firm Full Legal Name and Addre", "", "Acme Bank (Hong Kong", "N5", "", ""),
        ("Q2", 0, "", "Regulatory Authority", "SFC, Monetary Author", "SFC & HKMA", "N9", "", ""),
        ("Q3", 0, "", "Relevant Authorised Activities", "For HK, please speci", "Type 1 & Type 4", "N13", "", ""),
        ("Q3", 1, "", "For Singapore, please specify ", "For Singapore, pleas", "N/A", "N15", "", ""),
        ("Q4", 0, "", "Economic data (If available: n", "", "Approx no of employe", "N18", "", ""),
        ("Q5", 0, "", "a) Has your firm adopted a pro", "", "Yes", "N23", "YES", "B22"),
        ("Q5", 1, "", "b) Does each structured produc", "", "Yes, each structured", "N25", "", ""),
        ("Q6", 0, "", "What are the key features revi", "This includes but no", "Product Control Comm", "N29", "", ""),
        ("Q7", 0, "", "In which capacity will your fi", "", "", "", "", ""),
        ("Q7", 1, "Settling distributor", "Who is the custodian?", "", "", "N36", "YES", "B34"),
        ("Q7", 2, "Non-settling distributor", "Who is the custodian?", "", "PERSHING LLC", "N39", "NO", "B37"),
        ("Q7", 3, "", "Is this PtP set up? i.e you ac", "", "", "N41", "", ""),
    ]
    assert {r.section for r in rows if r.question_id == "Q6"} == {"PRODUCT APPROVAL PROCESS"}
    assert {r.side_answer_options for r in rows if r.side_answer} == {"YES,NO"}
    assert rows[1].prompt == "Regulatory Authority\nSFC, Monetary Authority of Singapore etc."
    sources = {r.question_id: r.source_rows for r in grid.source_rows(resolved).collect()}
    assert sources == {"Q1": [4, 5], "Q2": [7, 8, 9], "Q3": [11, 12, 13, 14, 15], "Q4": [17, 18], "Q5": [22, 23, 24, 25], "Q6": [27, 28, 29], "Q7": list(range(33, 42))}
    assert sorted((r.cell, r.value) for r in grid.remarks(resolved).collect()) == [("AP10", "External reviewer note: please verify Q1 address."), ("AQ25", "Internal flag: Q6 answer needs follow-up.")]


def test_side_answer_before_the_id_counts_for_the_question_before(spark):
    cells, merges, _ = fixtures.demo_grid(spark)
    answers = {r.question_id: r.answer for r in grid.slot_answers(cells, merges).collect()}
    assert answers["Q4"].endswith("\nYES") and answers["Q1"] == "Acme Bank (Hong Kong) Limited"


def _options(spark, rows):
    cells = [("f", "s", r, c, v, "00D9D9D9" if grey else None, "rgb" if grey else None, False, italic, 11.0) for r, c, v, grey, italic in rows]
    df = spark.createDataFrame(cells, "file_name string, sheet string, row int, col int, value string, fill_rgb string, fill_type string, bold boolean, italic boolean, font_size double")
    return [(r.option_label, r.prompt, r.answer, r.side_answer) for r in grid.sub_questions(grid.resolved_cells(df)).orderBy("sub_idx").collect()]


def test_multi_select(spark):
    stem = [(1, 12, "Q8", False, False), (1, 14, "Which channels?", False, False)]
    options = [(2, 2, "YES", True, False), (2, 14, "Branch", False, False), (3, 2, "NO", True, False), (3, 14, "Online", False, False), (4, 2, "yes ", True, False), (4, 14, "Phone", False, False)]
    assert _options(spark, stem + options) == [("", "Which channels?", "Branch | Phone", "")]
    assert len(_options(spark, stem + options + [(4, 15, "hint", False, True)])) == 4
    assert len(_options(spark, stem + options + [(5, 14, None, True, False)])) == 4
    assert len(_options(spark, [*stem, (1, 2, "YES", True, False), *options])) == 4


def test_json(spark):
    resolved = grid.resolved_cells(*fixtures.demo_grid(spark))
    (row,) = grid.nested_sheets(grid.sub_questions(resolved), grid.remarks(resolved), grid.source_rows(resolved)).collect()
    sheet = json.loads(row.json)["Questionnaire HK"]
    assert [q["question_id"] for q in sheet["questions"]] == [f"Q{i}" for i in range(1, 8)] and sheet["remarks"][0]["cell"] == "AP10"
    assert sheet["questions"][6]["source_rows"] == list(range(33, 42)) and len(sheet["questions"][6]["sub_questions"]) == 4
    assert [b["role"] for b in sheet["questions"][1]["sub_questions"][0]["blocks"]] == ["prompt", "hint", "answer"]


def test_empty(spark):
    cells, merges, lists = (d.limit(0) for d in fixtures.demo_grid(spark))
    assert grid.sub_questions(grid.resolved_cells(cells, merges, lists)).count() == 0


SCHEMAS = (
    "file_name string, sheet string, row int, col int, value string, fill_rgb string, fill_type string, bold boolean, italic boolean, font_size double",
    "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int",
    "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int, options string, pos int",
)


def _random_sheet(rnd, name):
    """Cells, merges that don't overlap and lists of a sheet of 40 rows; texts of questions, headers, labels and slots."""
    cells, merges, lists, taken = {}, [], [], set()
    for _ in range(rnd.randrange(25)):
        r, c, h, w = rnd.randint(1, 40), rnd.choice([1, 2, 5, 11, 12, 14, 20, 40, 42]), rnd.choice([1, 1, 2, 5]), rnd.choice([1, 3, 16])
        area = {(x, y) for x in range(r, r + h) for y in range(c, c + w)}
        if not area & taken:
            taken |= area
            merges.append(("f", name, r, r + h - 1, c, c + w - 1))
    for k in range(rnd.randrange(6)):
        r, c = rnd.randint(1, 40), rnd.choice([2, 3, 6, 14])
        lists.append(("f", name, r, rnd.choice([r, r + 4, 1048576]), c, rnd.choice([c, c + 3, 16384]), f'"list {k}"', k))
    inner = {p for _, _, r1, r2, c1, c2 in merges for p in ((x, y) for x in range(r1, r2 + 1) for y in range(c1, c2 + 1)) if p != (r1, c1)}
    for _ in range(120):
        at = (rnd.randint(1, 40), rnd.choice([1, 2, 3, 5, 11, 12, 14, 15, 20, 40, 41, 42, 60]))
        if at not in inner:
            text = rnd.choice(["Q1", "Q2", "Q33", "PART ONE", "a text", "YES", "0", None, None, " ", "more"])
            cells[at] = ("f", name, *at, text, rnd.choice([None, "00D9D9D9", "00FFFF00"]), "rgb", text == "PART ONE", rnd.random() < 0.2, 14.0 if text == "PART ONE" else 11.0)
    return cells, merges, lists


def test_ranges_by_bands_and_cell_by_cell(spark):
    """What a reader gets from files that leave out the inner cells of merges is what it gets from files that hold them all."""
    rnd = random.Random(4)
    few, every, merges, lists = [], [], [], []
    for k in range(12):
        cells, m, v = _random_sheet(rnd, f"s{k}")
        used = {r for r, _ in cells}
        few += cells.values()
        whole = dict(cells)
        for _, name, r1, r2, c1, c2 in m:
            for at in ((x, y) for x in range(r1, r2 + 1) for y in range(c1, c2 + 1) if x in used):
                whole.setdefault(at, ("f", name, *at, None, None, None, False, False, None))
        every += whole.values()
        merges += m
        lists += v
    few, every = (spark.createDataFrame(rows, SCHEMAS[0]) for rows in (few, every))
    merges, lists = spark.createDataFrame(merges, SCHEMAS[1]), spark.createDataFrame(lists, SCHEMAS[2])
    rows = lambda df: sorted(map(str, df.collect()))
    a, b = cut(grid.resolved_cells(few, merges, lists)), cut(grid.resolved_cells(every, merges, lists))
    for view in (grid.sub_questions, grid.remarks, grid.row_kinds, grid.source_rows):
        assert rows(view(a)) == rows(view(b)), view.__name__
    assert rows(grid.slot_answers(few, merges)) == rows(grid.slot_answers(every, merges))
    # Each cell's anchor and options, cell by cell.
    spans, rules, texts = merges.collect(), lists.collect(), {(r.sheet, r.row, r.col): r for r in every.collect()}
    option = lambda s, r, c: max(((v.pos, v.options.strip('"')) for v in rules if v.sheet == s and v.min_row <= r <= v.max_row and v.min_col <= c <= v.max_col), default=(0, None))[1]
    for r in b.collect():
        anchor = next(((m.min_row, m.min_col) for m in spans if m.sheet == r.sheet and m.min_row <= r.row <= m.max_row and m.min_col <= r.col <= m.max_col), (r.row, r.col))
        own = texts.get((r.sheet, *anchor))
        assert (r.anchor_row, r.anchor_col) == anchor and r.text == (own.value if own and own.value else "").strip()
        assert r.options == (option(r.sheet, r.row, r.col) or option(r.sheet, *anchor))


def test_ranges_over_whole_rows_and_columns(spark):
    cells = spark.createDataFrame([("f", "s", r, 14, f"t{r}", None, None, False, False, 11.0) for r in range(1, 30)], SCHEMAS[0])
    merges = spark.createDataFrame([("f", "s", 30, 1048576, 1, 16384), ("f", "s", 3, 3, 14, 16384)], SCHEMAS[1])
    lists = spark.createDataFrame([("f", "s", 1, 1048576, c, c, f'"{c}"', c) for c in range(10, 26)] + [("f", "s", 5, 5, 14, 14, '"later"', 99)], SCHEMAS[2])
    found = {(r.row, r.col): r for r in grid.resolved_cells(cells, merges, lists).collect()}
    assert len(found) == 29 and {r.options for k, r in found.items() if k[0] != 5} == {"14"} and found[5, 14].options == "later"
    assert band_rows(merges, lists) < 60


def band_rows(*ranges):
    return sum(band_index(r).count() for r in ranges)


def test_cells_are_made_behind_the_shuffle(spark):
    """Before, each task sorted all cells of the ranges that it had read."""
    columns = "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int, options string, pos int"
    rows = [("a", "s", 60, 70, 2, 3, '"X"', 0), ("a", "s", 64, 64, 3, 4, '"Y"', 1), ("b", "s", 1, 130, 2, 2, '"Z"', 2), ("b", "t", 5, 4, 2, 2, '"R"', 3)]
    out = grid.dropdown_cells(spark.createDataFrame(rows, columns).withColumn("file_name", F.lit("f")))
    wanted = {(s, r, c): o for _, s, a, b, left, right, o, _ in rows for r in range(min(a, b), max(a, b) + 1) for c in range(left, right + 1)}
    found = out.collect()
    assert {(r.sheet, r.row, r.col): f'"{r.options}"' for r in found} == wanted and len(found) == len(wanted)
    above, below = out._jdf.queryExecution().executedPlan().initialPlan().toString().split("Exchange hashpartitioning")
    assert "max_by" in above and "max_by" not in below
