from __future__ import annotations

import json

import pytest

from surveyframe import fixtures, plans
from surveyframe.operators import grid, windows
from surveyframe.sources import extract, xlsx


def _parsed(spark, tmp_path):
    header = ["file_name", "sheet", "question_id", "prompt", "answer", "side_answer", "option_label", "sub_idx"]
    for name, rows in {
        "a": [("a.xlsx", "s", "Q1", "Firm name", "Acme", "", "", 0), ("a.xlsx", "s", "Q2", "Tax number (if any)", "", "", "", 0), ("a.xlsx", "s", "Q3", " ", "lost", "", "", 0)],
        "b": [("b.xlsx", "s", "Q1", "Firm Name?", "N/A", "", "", 0), ("b.xlsx", "s", "Q9", "Address", "Street", "YES", "Head office", 1)],
        "old_analysis": [("x", "s", "Q1", "skipped", "x", "", "", 0)], "~$lock": [("x", "s", "Q1", "skipped", "x", "", "", 0)],
    }.items():
        (tmp_path / f"{name}.xlsx").write_bytes(xlsx.workbook_bytes({"notes": (["x"], [("y",)]), "questions": (header, rows)}))
    return str(tmp_path)


def test_round_trip():
    book = xlsx.Workbook(xlsx.workbook_bytes({"q": (["a", "b <&>"], [("x\ny", 1), (None, 2.5), (" pad ", True)])}))
    assert book.table("q") == (["a", "b <&>"], [["x\ny", "1"], [None, "2.5"], [" pad ", "True"]])


def test_analyse_files(spark, tmp_path):
    folder = _parsed(spark, tmp_path)
    out = str(tmp_path / "report_analysis.xlsx")
    tables = plans.analyse_files(spark, folder, out)
    per = {r.questionnaire: r for r in tables["questionnaire_missing"].collect()}
    assert (per["a.xlsx | s"].n_questions, per["a.xlsx | s"].n_answered, per["a.xlsx | s"].n_optional_blank) == (2, 1, 1)
    assert (per["b.xlsx | s"].n_blank, per["b.xlsx | s"].required_answer_rate) == (1, 0.5)
    assert {r.canonical_text for r in tables["question_presence"].collect()} == {"Tax number (if any)", "Head office - Address"}
    lines = plans.digest(tables)
    assert any("a.xlsx | s: 1 of 2 (50%)" in x for x in lines) and lines[0] == "Missing answers"
    assert [n for n, _ in xlsx.Workbook(open(out, "rb").read()).sheets] == list(tables)


def test_compare_files(spark, tmp_path):
    folder = _parsed(spark, tmp_path)
    for name in ("a", "b"):  # the comparison reads first sheets
        data = xlsx.Workbook((tmp_path / f"{name}.xlsx").read_bytes()).table("questions")
        (tmp_path / f"{name}.xlsx").write_bytes(xlsx.workbook_bytes({"one": (data[0], [tuple(r) for r in data[1]])}))
    rows = [r.asDict() for r in plans.compare_files(spark, folder).collect()]
    assert [(r["Questionnaire"], r["Actual_Question Q1"], r["Q1 Answer"]) for r in rows] == [("a.xlsx", "Firm name", "Acme"), ("b.xlsx", "Firm Name?", "")]
    assert rows[1]["Actual_Question Q3"] == "Head office - Address" and rows[1]["Q3 Answer"] == "YES - Street" and rows[0]["Q3 Match Percentage"] is None


def test_no_input(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(xlsx.workbook_bytes({"a": (["z"], [("1",)])}))
    with pytest.raises(ValueError, match="no questions"):
        plans.analyse_files(spark, str(tmp_path))


def test_retry():
    calls, slept = [], []

    def fails(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return x

    assert extract.retry(fails, sleep=slept.append)(7) == 7 and slept == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        extract.retry(lambda: 1 / 0, attempts=2, sleep=slept.append)()


def test_extract_items(spark):
    def page(sheet, no, items):
        return (sheet, no, json.dumps(items).encode())

    full = {"question_id": "Q2", "question": "Two", "answer": "a long answer"}
    pages = spark.createDataFrame([page("s", 1, [{"question_id": " Q10 ", "question": "Ten", "answer": ""}]), page("s", 2, [{"question_id": "Q2", "question": "Two", "answer": "a lo"}]), page("s", 3, [full, {"question_id": " ", "question": "x", "answer": ""}]), page("bad", 1, ["broken"])], "sheet string, page_no int, png binary")
    truth = spark.createDataFrame([("s", "Q2", "A long  answer that goes on")], "sheet string, question_id string, answer string")

    def make():
        def run(images, numbers):
            if b"broken" in images[0]:
                raise ValueError("unreadable")
            return extract.stub_extractor(images, numbers)

        return run

    rows = plans.extract_items(pages, make, truth=truth, attempts=1).collect()
    assert [(r.question_id, r.answer, r.source_pages, r.answer_source) for r in rows] == [("Q2", "A long  answer that goes on", [1, 2, 3], "xlsx_reconciled"), ("Q10", "", [1, 2], "llm")]


def test_files_with_the_same_sheet_and_id_stay_apart(spark, tmp_path):
    image = lambda answer: json.dumps([{"question_id": "Q1", "question": "Name", "answer": answer}]).encode()
    pages = spark.createDataFrame([("a.xlsx", "Sheet1", 1, image("from a")), ("b.xlsx", "Sheet1", 1, image("from b"))], "file_name string, sheet string, page_no int, png binary")
    cells = [(f, "Sheet1", r, c, v, rgb, "rgb") for f, full in (("a.xlsx", "from a and more"), ("b.xlsx", "from b and so on")) for r, c, v, rgb in ((1, 12, "Q1", None), (1, 14, "Name", None), (2, 14, full, "00D9D9D9"))]
    truth = grid.slot_answers(spark.createDataFrame(cells, "file_name string, sheet string, row int, col int, value string, fill_rgb string, fill_type string"))
    items = plans.extract_items(pages, lambda: extract.stub_extractor, truth=truth)
    assert [(r.file_name, r.answer) for r in items.collect()] == [("a.xlsx", "from a and more"), ("b.xlsx", "from b and so on")]
    assert [(r.file_name, len(json.loads(r.json)["questions"])) for r in windows.nested_items(items).orderBy("file_name").collect()] == [("a.xlsx", 1), ("b.xlsx", 1)]


@pytest.mark.parametrize(("n", "w", "s", "expected"), [(0, 2, 1, []), (1, 2, 1, [[1]]), (2, 2, 1, [[1, 2]]), (5, 2, 1, [[1, 2], [2, 3], [3, 4], [4, 5]]), (5, 2, 3, [[1, 2], [4, 5]]), (6, 2, 3, [[1, 2], [4, 5], [5, 6]]), (7, 3, 2, [[1, 2, 3], [3, 4, 5], [5, 6, 7]])])
def test_windows(spark, n, w, s, expected):
    found = windows.page_windows(spark.createDataFrame([("s", n)], "sheet string, n_pages int"), w, s)
    assert [r.pages for r in found.orderBy("window_no").collect()] == expected


def test_stream(spark, tmp_path):
    from surveyframe import streaming

    rows = spark.sql("select timestamp'2024-01-01 00:00:01' as ts, 's' as sheet, 'Q1' as question_id, 'q' as question, '' as answer, array(1) as source_pages, 0L as arrival union all select timestamp'2024-01-01 00:00:02', 's', 'Q1', 'q', 'yes', array(2), 1L union all select timestamp'2024-01-01 02:00:00', 's', 'Q1', 'q', 'no', array(3), 2L")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.dedupe_stream(stream).writeStream.outputMode("append").format("memory").queryName("items").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.answer, r.source_pages) for r in spark.table("items").collect()] == [("yes", [1, 2])]
    assert sorted(r.answer for r in streaming.dedupe_stream(rows).collect()) == ["no", "yes"]


def test_demo_workbook_style_reading(spark):
    cells, _, _ = fixtures.demo_grid(spark)
    assert cells.count() == len(fixtures.DEMO)


def test_render_pages(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", b"xy"), ("b.xlsx", b"z"), ("bad.pdf", b"")], "file_name string, content binary")

    def make():
        def run(data, dpi):
            if not data:
                raise ValueError("empty")
            return [("s1", data), ("s2", data), ("s1", data)] if data == b"z" else [data[i : i + 1] for i in range(len(data))]

        return run

    pages = extract.render_pages(files, make)
    rows = sorted(((r.file_name, r.sheet, r.page_no, r.error) for r in pages.collect()), key=str)
    assert rows == [("a.pdf", "a", 1, None), ("a.pdf", "a", 2, None), ("b.xlsx", "s1", 1, None), ("b.xlsx", "s1", 2, None), ("b.xlsx", "s2", 1, None), ("bad.pdf", None, None, "empty")]
    extract.write_pages(pages, str(tmp_path))
    assert (tmp_path / "a.pdf" / "a" / "page_002.png").read_bytes() == b"y"


def test_command_line(spark, tmp_path, capsys):
    from surveyframe.__main__ import main

    folder = _parsed(spark, tmp_path)
    assert main(["analyse", folder, "-o", str(tmp_path / "out_analysis.xlsx"), "--id-by", "file", "--treat-as-blank", "street, x"]) == 0
    assert "a.xlsx: 1 of 2" in capsys.readouterr().out and (tmp_path / "out_analysis.xlsx").exists()
    main(["parse", folder, str(tmp_path / "parsed"), "--debug"])
    from datetime import date

    assert (tmp_path / "parsed" / f"{tmp_path.name}_{date.today().isoformat()}.xlsx").exists() and (tmp_path / "parsed" / "row_kinds").is_dir()
    assert main(["analyse", str(tmp_path / "nothing")]) == 1 and main(["parse", str(tmp_path / "parsed" / "row_kinds")]) == 1


def test_command_line_extract(spark, tmp_path, monkeypatch):
    from surveyframe.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdf").write_bytes(json.dumps([{"question_id": "Q1", "question": "Name", "answer": "x"}]).encode())
    (tmp_path / "in" / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "tools.py").write_text("def renderer():\n    def run(data, dpi):\n        if data == b'no zip':\n            raise ValueError('unreadable')\n        return [data]\n    return run\n\ndef extractor():\n    from surveyframe.sources.extract import stub_extractor\n    return stub_extractor\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "tools.py"))
    flags = ["--extractor", "tools:extractor", "--renderer", "tools:renderer", "--output-dir", str(tmp_path / "out")]
    assert main(["extract", str(tmp_path / "in"), *flags]) == 0
    assert json.loads((tmp_path / "out" / "one.json").read_text())["questions"][0]["answer"] == "x"
    assert main(["extract", str(tmp_path / "in" / "broken.xlsx"), *flags]) == 2


def test_dates_and_merges_from_a_file():
    import io
    import zipfile

    data = xlsx.workbook_bytes({"s": (["When", "What"], [("x", "y")])})
    out = io.BytesIO()
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" s="1"><v>45293</v></c><c r="B1" s="2"><v>0.75</v></c><c r="C1" s="0"><v>45293</v></c><c r="D1" s="3"><v>45293.5</v></c></row></sheetData><mergeCells count="1"><mergeCell ref="A1:B2"/></mergeCells><dataValidations count="1"><dataValidation type="list" sqref="C1:C3"><formula1>"YES,NO"</formula1></dataValidation></dataValidations></worksheet>'
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="dd/mm/yyyy\\ hh:mm"/></numFmts><fonts><font><b/><sz val="14"/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFD9D9D9"/></patternFill></fill></fills><cellXfs><xf/><xf numFmtId="14" fillId="1"/><xf numFmtId="20"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            b.writestr(name, sheet if name.endswith("sheet1.xml") else a.read(name))
        b.writestr("xl/styles.xml", styles)
    book = xlsx.Workbook(out.getvalue())
    assert [(c[2], c[3], c[4], c[5], c[7], c[9]) for c in book.cells()] == [(1, 1, "2024-01-02 00:00:00", "FFD9D9D9", True, 14.0), (1, 2, "18:00:00", None, True, 14.0), (1, 3, "45293", None, True, 14.0), (1, 4, "2024-01-02 12:00:00", None, True, 14.0)]
    assert list(book.merges()) == [("s", 1, 2, 1, 2)] and list(book.dropdowns()) == [("s", 1, 3, 3, 3, '"YES,NO"', 0)]
    assert [xlsx.is_date_format(f) for f in ("0.00", "General", '"days" 0', "[Red]0", "[h]:mm", "yyyy")] == [False, False, False, False, True, True]


def _styled(path):
    """A workbook with merges, lists, styles and shared strings, as a spreadsheet program writes them."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda ref, text, style: f'<c r="{ref}" s="{style}" t="inlineStr"><is><t>{text}</t></is></c>' if text is not None else f'<c r="{ref}" s="{style}"/>'
    rows = {
        1: [("N1", "COMPANY PROFILE", 1)], 2: [("L2", "Q1", 0), ("N2", "Which channels?", 0)], 3: [("B3", "YES", 2), ("N3", "Branch", 0)], 4: [("B4", "NO", 2), ("N4", "Online", 0)],
        6: [("B6", "YES", 2), ("L6", "Q2", 0), ("N6", "Regulator", 0)], 7: [("N7", "e.g. SFC", 3)], 8: [("N8", "HKMA", 2)], 9: [("AQ9", "check this", 0)], 10: [("N10", None, 2)],
    }
    data = "".join(f'<row r="{r}">{"".join(cell(*c) for c in cells)}</row>' for r, cells in rows.items())
    merges = ["N1:AC1", "N2:AC2", "B3:G3", "B4:G4", "B6:G6", "N8:AC8"]
    sheet = f'<worksheet {main}><sheetData>{data}</sheetData><mergeCells>{"".join(f"""<mergeCell ref="{m}"/>""" for m in merges)}</mergeCells><dataValidations><dataValidation type="list" sqref="B1:B1048576"><formula1>"YES,NO"</formula1></dataValidation><dataValidation type="whole" sqref="C1"/><dataValidation type="list" sqref="Z1 Z2"><formula1>"x"</formula1></dataValidation></dataValidations></worksheet>'
    styles = f'<styleSheet {main}><fonts><font><sz val="11"/></font><font><b/><sz val="14"/></font><font><i/><sz val="11"/></font></fonts><fills><fill><patternFill/></fill><fill><patternFill><fgColor rgb="00D9D9D9"/></patternFill></fill></fills><cellXfs><xf fontId="0" fillId="0"/><xf fontId="1" fillId="0"/><xf fontId="0" fillId="1"/><xf fontId="2" fillId="0"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>shared</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row></sheetData></worksheet>')


def test_a_styled_file_end_to_end(spark, tmp_path):
    _styled(tmp_path / "s.xlsx")
    tables = plans.parse_files(spark, str(tmp_path))
    rows = tables["sub_questions"].orderBy("segment", "sub_idx").collect()
    assert [(r.section, r.question_id, r.sub_idx, r.option_label, r.prompt, r.hint, r.answer, r.answer_cell, r.side_answer, r.side_answer_options, r.side_answer_cell) for r in rows] == [
        ("COMPANY PROFILE", "Q1", 0, "", "Which channels?", "", "Branch", "", "", "", ""),
        ("COMPANY PROFILE", "Q2", 0, "", "Regulator\ne.g. SFC", "e.g. SFC", "HKMA", "N8", "YES", "YES,NO", "B6"),
        ("COMPANY PROFILE", "Q2", 1, "", "", "", "", "N10", "", "", ""),
    ]
    assert [(r.sheet, r.cell, r.value) for r in tables["remarks"].orderBy("sheet", "cell").collect()] == [("One", "AQ9", "check this"), ("Two", "A1", "shared")]
    files = xlsx.list_files(spark, str(tmp_path))
    parts = xlsx.read_parts(files)
    assert sorted(xlsx.merges_of(parts).collect()) == sorted(xlsx.read_merges(files).collect()) and sorted(map(str, xlsx.dropdowns_of(parts).collect())) == sorted(map(str, xlsx.read_dropdowns(files).collect()))
    assert {(r.min_row, r.max_row, r.pos) for r in xlsx.dropdowns_of(parts).collect()} == {(1, 1048576, 0), (1, 1, 2), (2, 2, 2)}


def test_xlsx_source(spark, tmp_path):
    from surveyframe.sources.xlsx_source import XlsxCells

    _styled(tmp_path / "s.xlsx")
    _styled(tmp_path / "t.xlsx")
    (tmp_path / "~$s.xlsx").write_bytes(b"lock")
    spark.dataSource.register(XlsxCells)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        cells = spark.read.format("xlsx_cells").load(str(tmp_path))
        assert sorted(map(str, cells.collect())) == sorted(map(str, xlsx.read_cells(xlsx.list_files(spark, str(tmp_path))).collect()))
        some = cells.where("sheet = 'One' and file_name = 's.xlsx' and col between 2 and 41 and row > 2")
        assert some.rdd.getNumPartitions() == 1 and {r.row for r in some.collect()} == {3, 4, 6, 7, 8, 10}
        few = spark.read.format("xlsx_cells").schema("row int, value string").load(str(tmp_path / "s.xlsx"))
        assert few.columns == ["row", "value"] and few.where("row = 1").count() == 3
        assert cells.where("sheet = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_sheet_of_many_rows_is_read_by_rows(tmp_path):
    import tracemalloc

    path = tmp_path / "big.xlsx"
    path.write_bytes(xlsx.workbook_bytes({"q": (["a", "b"], [(f"text {i}", i) for i in range(60_000)])}))
    tracemalloc.start()
    with open(path, "rb") as f:
        assert sum(1 for _ in xlsx.Workbook(f).parts(0)) == 120_002
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_named_files(spark, tmp_path):
    from surveyframe.sources.named_files import write_named

    files = spark.range(300, numPartitions=5).selectExpr("concat('d', id % 7, '/f', id, '.bin') as name", "cast(concat('x\n', id) as binary) as content", "id as more")
    write_named(files, str(tmp_path / "out"))
    found = sorted(p for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert len(found) == 300 and (tmp_path / "out/d3/f10.bin").read_bytes() == b"x\n10" and not list((tmp_path / "out").glob("_temporary*"))
    write_named(spark.createDataFrame([("d3/f10.bin", "äö")], "name string, content string"), str(tmp_path / "out"))
    assert (tmp_path / "out/d3/f10.bin").read_text() == "äö" and len(list((tmp_path / "out/d3").iterdir())) == 43
    for bad in (["a", "a"], ["../a"], ["/a"], [None]):
        with pytest.raises(Exception):
            write_named(spark.createDataFrame([(n, "x") for n in bad], "name string, content string"), str(tmp_path / "bad"))
        assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] and not (tmp_path / "a").exists()


def test_half_written_files_never_show(spark, tmp_path):
    from surveyframe.sources.named_files import NamedWriter

    writer = NamedWriter(str(tmp_path / "o"))
    row = lambda n: {"name": n, "content": b"1"}
    writer.write(iter([row("a")]))  # an attempt that was lost before its commit
    kept = writer.write(iter([row("a"), row("b")]))
    assert not (tmp_path / "o/a").exists()
    writer.commit([kept, None])
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a", "b"]
    failing = NamedWriter(str(tmp_path / "o"))
    failing.write(iter([row("c")]))
    failing.abort([None])
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a", "b"]


def test_workbook_of_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    many = spark.range(30_000, numPartitions=6).select((30_000 - F.col("id")).alias("n"), F.concat(F.lit("text <&> \n"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("half"), (F.col("id") % 2 == 0).alias("even"))
    path = str(tmp_path / "w.xlsx")
    xlsx.write_workbook({"many": many.orderBy("n"), "none": many.where("n < 0"), "a" * 40: many.limit(1)}, path)
    book = xlsx.Workbook(open(path, "rb").read())
    assert [n for n, _ in book.sheets] == ["many", "none", "a" * 31] and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["w.xlsx"]
    header, rows = book.table("many")
    assert header == ["n", "text", "half", "even"] and len(rows) == 30_000 and [r[0] for r in rows] == [str(i) for i in range(1, 30_001)]
    assert rows[0] == ["1", "text <&> \n29999", "14999.5", "False"] and rows[2][2] == "" and rows[1][2] == "14999.0" and rows[3][3] == "True"
    assert book.table("none") == (["n", "text", "half", "even"], [])
    broken = many.select(F.raise_error("no").cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        xlsx.write_workbook({"many": many, "broken": broken}, path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["w.xlsx"] and len(xlsx.Workbook(open(path, "rb").read()).sheets) == 3


def test_windows_in_flight():
    import threading
    import time

    lock, calls, now, most = threading.Lock(), {}, [0], [0]

    def call(n):
        with lock:
            calls.setdefault(n, []).append(time.monotonic())
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        if n % 10 == 3 and len(calls[n]) < 3 or n == 50:
            raise OSError(f"no {n}")
        return n * n

    start = time.monotonic()
    out = list(extract.in_flight(call, ((n,) for n in range(100)), attempts=3, base_delay=0.1, at_once=16))
    took = time.monotonic() - start
    assert out == [(n * n, None) if n != 50 else (None, "no 50") for n in range(100)]
    assert took < 100 * 0.05 / 4 and most[0] <= 16 and {len(c) for n, c in calls.items() if n % 10 == 3 or n == 50} == {3}
    assert all(b - a >= d for n, c in calls.items() if len(c) == 3 for a, b, d in zip(c, c[1:], (0.1, 0.2)))
    assert list(extract.in_flight(call, [])) == []


def test_prompt_reaches_the_model():
    seen = []
    extractor = extract.prompted(lambda prompt, urls: seen.append((prompt, urls)) or "[]")
    assert extractor([b"png"], [3, 4]) == "[]" and seen[0][0].startswith(extract.PROMPT) and seen[0][0].endswith("Pages: 3, 4.") and extract.decode_image_url(seen[0][1][0]) == b"png"
