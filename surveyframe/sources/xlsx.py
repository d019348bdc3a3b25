"""Reads and writes workbooks with the standard library alone.

Files are read with Spark's binaryFile source, a row and so a task's work for each, from any store that Spark reaches; or by
``xlsx_source``, a task for each sheet. A sheet is read by events, so only one of its rows is held at a time.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from itertools import accumulate, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column_number
from ..storage import cut, numbered, shared_dir

# Name spaces and content types of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The built-in number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Rows that a sheet can hold.
MAX_ROWS = 1_048_576
CELL_SCHEMA = "file_name string, sheet string, sheet_pos int, row int, col int, value string, fill_rgb string, fill_type string, bold boolean, italic boolean, font_size double, value_type string"
MERGE_SCHEMA = "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int"
DROPDOWN_SCHEMA = MERGE_SCHEMA + ", options string, pos int"


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    return int(digits), column_number(letters)


def _range(ref: str) -> tuple[int, int, int, int]:
    """(min_row, max_row, min_col, max_col)"""
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = _place(a), _place(b or a)
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def _on(node, tag: str) -> bool:
    found = node.find(_MAIN + tag)
    return found is not None and found.get("val", "1") not in ("0", "false")


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: it has y, m, d, h or s outside quotes, escapes and colours."""
    first = code.split(";")[0]
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", first), re.I)) and first.lower() != "general"


class Workbook:
    """The cells, merged ranges and list validations of a workbook's sheets. Formulas give their cached values.

    ``data``: the file's bytes, or a file that can be read at any place.
    """

    def __init__(self, data):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        names = set(self.zip.namelist())
        self._shared = "xl/sharedStrings.xml" in names
        self._strings: list[str] | None = None
        self.dates: set[int] = set()
        self.styles = self._styles() if "xl/styles.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets, book = [], self._xml("xl/workbook.xml")
        self.epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(_MAIN + "workbookPr")) else datetime(1899, 12, 30)
        for s in book.iter(_MAIN + "sheet"):
            target = targets[s.get(_REL + "id")]
            if "worksheets/" in target:
                self.sheets.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))

    @property
    def strings(self) -> list[str]:
        """The shared strings, read when the first is asked for."""
        if self._strings is None:
            self._strings = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in self._events("xl/sharedStrings.xml", {"si"})] if self._shared else []
        return self._strings

    def _events(self, name: str, tags: set[str]) -> Iterator:
        """The elements of these tags as they end, in the file's order. What has been seen is dropped."""
        wanted = {_MAIN + t for t in tags}
        with self.zip.open(name) as f:
            path, inside = [], 0
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    path.append(node)
                    inside += node.tag in wanted
                    continue
                path.pop()
                inside -= node.tag in wanted
                if node.tag in wanted:
                    yield node
                if path and not inside:
                    path[-1].remove(node)

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _styles(self) -> list[tuple]:
        root = self._xml("xl/styles.xml")
        fonts = []
        for f in root.find(_MAIN + "fonts") if root.find(_MAIN + "fonts") is not None else []:
            size = f.find(_MAIN + "sz")
            fonts.append((_on(f, "b"), _on(f, "i"), float(size.get("val")) if size is not None else None))
        fills = []
        for f in root.find(_MAIN + "fills") if root.find(_MAIN + "fills") is not None else []:
            colour = f.find(f"{_MAIN}patternFill/{_MAIN}fgColor")
            kind = None if colour is None else next((k for k in ("rgb", "theme", "indexed") if colour.get(k)), None)
            fills.append((colour.get("rgb") if kind == "rgb" else None, kind))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(_MAIN + "numFmt")}
        xfs = root.find(_MAIN + "cellXfs")
        formats = [int(x.get("numFmtId", 0)) for x in (xfs if xfs is not None else [])]
        self.dates = {i for i, f in enumerate(formats) if (is_date_format(own[f]) if f in own else f in DATE_FORMATS)}
        pick = lambda rows, i, default: rows[i] if i < len(rows) else default
        return [(*pick(fills, int(x.get("fillId", 0)), (None, None)), *pick(fonts, int(x.get("fontId", 0)), (False, False, None))) for x in (xfs if xfs is not None else [])]

    def _value(self, c) -> str | None:
        kind, v = c.get("t"), c.find(_MAIN + "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(_MAIN + "t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind in ("str", "e"):
            return v.text
        number = float(v.text)
        if int(c.get("s", 0)) in self.dates:
            return self._moment(number)
        return str(int(number)) if number.is_integer() and "." not in v.text else repr(number)

    def _moment(self, days: float) -> str:
        """A date and time, or a time alone for less than a day. The day that the format has too many in 1900 is left out."""
        if 0 <= days < 1:
            return str((datetime.min + timedelta(milliseconds=round(days * 86_400_000))).time())
        early = self.epoch.year == 1899 and 1 <= days < 60
        return str(self.epoch + timedelta(days=int(days) + early, milliseconds=round(days % 1 * 86_400_000)))

    def parts(self, pos: int, kinds: set[str] = frozenset(("cell", "merge", "list"))) -> Iterator[tuple[str, tuple]]:
        """(kind, row) of a sheet, in one pass: ("cell", (row, col, value, fill_rgb, fill_type, bold, italic, font_size, value_type)) of cells with a
        value or a fill, ("merge", range), ("list", (*range, options, pos)). A range: (min_row, max_row, min_col, max_col)."""
        rules = 0
        tags = {"c"} if kinds == {"cell"} else {"mergeCell", "dataValidation"} | ({"c"} if "cell" in kinds else set())
        for node in self._events(self.sheets[pos][1], tags | {"row"}):
            if node.tag == _MAIN + "c" and "cell" in kinds:
                value, style = self._value(node), int(node.get("s", 0))
                rgb, kind, bold, italic, size = self.styles[style] if style < len(self.styles) else (None, None, False, False, None)
                if value is not None or rgb is not None:
                    given = node.get("t", "n")
                    yield "cell", (*_place(node.get("r")), value, rgb, kind, bold, italic, size, given if given in ("n", "b") else "s")
            elif node.tag == _MAIN + "mergeCell" and "merge" in kinds:
                yield "merge", _range(node.get("ref"))
            elif node.tag == _MAIN + "dataValidation":
                formula = node.find(_MAIN + "formula1")
                if node.get("type") == "list" and formula is not None and "list" in kinds:
                    for ref in (node.get("sqref") or "").split():
                        yield "list", (*_range(ref), formula.text or "", rules)
                rules += 1

    def _of_all(self, kind: str) -> Iterator[tuple]:
        for pos, (name, _) in enumerate(self.sheets):
            for _, row in self.parts(pos, {kind}):
                yield (name, pos, *row) if kind == "cell" else (name, *row)

    def cells(self) -> Iterator[tuple]:
        """(sheet, sheet_pos, row, col, value, fill_rgb, fill_type, bold, italic, font_size, value_type) of cells with a value or a fill."""
        return self._of_all("cell")

    def merges(self) -> Iterator[tuple]:
        return self._of_all("merge")

    def dropdowns(self) -> Iterator[tuple]:
        return self._of_all("list")

    def table(self, sheet: str | None = "questions") -> tuple[list[str], list[list[str | None]]]:
        """Header and rows of the named sheet, else of the first; all cells as text."""
        names = [n for n, _ in self.sheets]
        pos = names.index(sheet) if sheet in names else 0
        rows: dict[int, dict[int, str | None]] = {}
        for _, (row, col, value, *_) in self.parts(pos, {"cell"}) if names else ():
            rows.setdefault(row, {})[col] = value
        if not rows:
            return [], []
        first = min(rows)
        header = {c: v for c, v in sorted(rows.pop(first).items()) if v}
        return list(header.values()), [[rows[r].get(c) for c in header] for r in sorted(rows)]


def list_files(spark: SparkSession, path: str, kind: str = "tables") -> DataFrame:
    """path, file_name, content of the workbooks that a run takes, by ``kind``: "parse" (every .xlsx), "pages" (.xlsx,
    .xlsm, .pdf in any case, no lock files), "tables" (.xlsx without lock files and earlier reports). A path that is a file is
    taken whatever its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), "content")
    lock = F.col("file_name").startswith("~$")
    wanted = {"parse": F.col("file_name").endswith(".xlsx"), "pages": F.col("file_name").rlike(r"(?i)\.(xlsx|xlsm|pdf)\z") & ~lock, "tables": F.col("file_name").endswith(".xlsx") & ~lock & ~F.col("file_name").rlike(r"(_analysis|_comparison)\.xlsx\z")}[kind]
    return files.where(wanted) if is_folder(spark, path) else files


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """None if there is nothing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return found.getFileStatus(target).isDirectory() if found.exists(target) else None


#: Rows of one batch on their way out of Python.
_BATCH = 20_000


def _each(files: DataFrame, schema: str, rows, skip_broken: bool = False) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def found(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for r in rows(Workbook(data)):
                yield (name, *r)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError):
            if not skip_broken:
                raise

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["file_name"], frame["content"], strict=True):
                left = found(name, bytes(data))
                while some := list(islice(left, _BATCH)):
                    yield pd.DataFrame(some, columns=columns, dtype=object)

    return files.select("file_name", "content").mapInPandas(run, schema)


PART_SCHEMA = CELL_SCHEMA + ", kind string, min_row int, max_row int, min_col int, max_col int, options string, pos int"


def read_parts(files: DataFrame, skip_broken: bool = False) -> DataFrame:
    """Cells, merges and lists of all workbooks in one pass, told apart by ``kind`` (cell, merge, list). See ``cells_of`` and its
    like; write the table once before using several of them."""

    def rows(book: Workbook):
        for pos, (name, _) in enumerate(book.sheets):
            for kind, row in book.parts(pos):
                cell, rest = (row, ()) if kind == "cell" else ((None,) * 9, row)
                yield (name, pos, *cell, kind, *rest, *(None,) * (6 - len(rest)))

    return _each(files, PART_SCHEMA, rows, skip_broken)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def cells_of(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'cell'").select(*_columns(CELL_SCHEMA))


def merges_of(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'merge'").select(*_columns(MERGE_SCHEMA))


def dropdowns_of(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'list'").select(*_columns(DROPDOWN_SCHEMA))


def read_cells(files: DataFrame, skip_broken: bool = False) -> DataFrame:
    """The cells of all workbooks; one that can't be read fails the run, or gives no rows if ``skip_broken``."""
    return _each(files, CELL_SCHEMA, Workbook.cells, skip_broken)


def read_merges(files: DataFrame) -> DataFrame:
    return _each(files, MERGE_SCHEMA, Workbook.merges)


def read_dropdowns(files: DataFrame) -> DataFrame:
    return _each(files, DROPDOWN_SCHEMA, Workbook.dropdowns)


def read_tables(files: DataFrame, columns: list[str], sheet: str | None = "questions") -> DataFrame:
    """The tables of all files as text: ``columns`` (null where a file lacks one), and ord, by file name, then row.

    A file without any of the columns gives no rows. Files keep apart in ord by 2^20 rows, as many as a sheet can have.
    """
    schema = "file_name string, " + "row_no long, " + ", ".join(f"c_{c} string" for c in columns)

    def rows(book: Workbook):
        header, body = book.table(sheet)
        at = [header.index(c) if c in header else None for c in columns]
        if any(a is not None for a in at):
            yield from ((i, *(None if a is None else r[a] for a in at)) for i, r in enumerate(body))

    found = _each(files, schema, rows)
    rank = numbered(found.select("file_name").distinct(), "nth", F.col("file_name")).select("file_name", (F.col("nth") - 1).alias("rank"))
    ordered = found.join(rank, "file_name")
    return ordered.select((F.col("rank").cast("long") * MAX_ROWS + F.col("row_no")).alias("ord"), F.col("file_name").alias("source_file"), *[F.col(f"c_{c}").alias(c) for c in columns])


# --- Writing.

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _frame(names: list[str]) -> dict[str, str]:
    """The parts of a workbook that hold it together, by path."""
    kinds, links, sheets = [], [], []
    for k, name in enumerate(names, 1):
        kinds.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        links.append(f'<Relationship Id="rId{k}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        sheets.append(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>')
    return {
        "[Content_Types].xml": f'{_TYPES}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(kinds)}</Types>',
        "_rels/.rels": f'{_TYPES}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'{_TYPES}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>',
        "xl/workbook.xml": f'{_TYPES}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{"".join(sheets)}</sheets></workbook>',
    }


def _row(r: int, values) -> str:
    return f'<row r="{r}">{"".join(_cell(f"{_letters(c)}{r}", v) for c, v in enumerate(values, 1))}</row>'


def _sheet_start(header: list[str], wide: list[float], freeze: bool) -> str:
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(wide, 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if freeze else ""
    return f'{_TYPES}<worksheet xmlns="{_MAIN[1:-1]}">{view}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{_row(1, header)}'


_SHEET_END = "</sheetData></worksheet>"


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]], widths: dict[str, list[float]] | None = None, freeze: bool = True, wide_columns: set[str] = frozenset()) -> bytes:
    """A small workbook of (header, rows) by sheet name; names are cut to 31 characters, the header row stays in view."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, (header, rows)) in enumerate(sheets.items(), 1):
            if len(rows) >= MAX_ROWS:
                raise ValueError(f"{name} has more rows than a sheet can hold")
            wide = (widths or {}).get(name) or fitted_widths(header, rows, wide_columns)
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet_start(header, wide, freeze) + "".join(_row(r, row) for r, row in enumerate(rows, 2)) + _SHEET_END)
        for part, text in _frame(list(sheets)).items():
            z.writestr(part, text)
    return out.getvalue()


def fitted_widths(header: list[str], rows: list[tuple], wide_columns: set[str] = frozenset(), least: int = 10, most: int = 70, wide: int = 60) -> list[float]:
    """Column widths from the first 200 rows; columns of texts are wide."""
    fit = lambda i, h: min(most, max(least, 2 + max(len(str(x)) for x in (h, *(r[i] for r in rows[:200])))))
    return [wide if h in wide_columns or "text" in h.lower() else fit(i, h) for i, h in enumerate(header)]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Through Spark's file systems, so that any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_workbook(tables: dict[str, DataFrame], path: str, widths: dict[str, list[float]] | None = None, freeze: bool = True, wide_columns: set[str] = frozenset()) -> None:
    """Tables, in their order, as the sheets of one workbook; one with more rows than a sheet can hold is an error.

    Tasks write the rows of a sheet as pieces of its XML to the shared folder. The driver's JVM copies these, piece after piece, into the
    file, so no table passes through the driver's memory. A run that fails leaves no file.
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    folder = f"{shared_dir(spark)}/workbook-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    target = place(path)
    store, work = target.getFileSystem(conf), place(folder).getFileSystem(conf)
    draft = place(f"{path}.{uuid.uuid4().hex}.draft")
    try:
        starts = [_write_rows(df, name, f"{folder}/{k}", (widths or {}).get(name), freeze, wide_columns) for k, (name, df) in enumerate(tables.items(), 1)]
        out = jvm.java.util.zip.ZipOutputStream(store.create(draft, True))
        try:
            for k, start in enumerate(starts, 1):
                out.putNextEntry(jvm.java.util.zip.ZipEntry(f"xl/worksheets/sheet{k}.xml"))
                out.write(bytearray(start.encode()))
                parts = [s.getPath() for s in work.listStatus(place(f"{folder}/{k}")) if s.getPath().getName().startswith("part-")]
                for p in sorted(parts, key=lambda p: int(p.getName().split("-")[1])):
                    piece = work.open(p)
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 16, False)
                    piece.close()
                out.write(bytearray(_SHEET_END.encode()))
            for part, text in _frame(list(tables)).items():
                out.putNextEntry(jvm.java.util.zip.ZipEntry(part))
                out.write(bytearray(text.encode()))
        finally:
            out.close()
        store.delete(target, False)
        if not store.rename(draft, target):
            raise OSError(f"{path} can't be written")
    finally:
        store.delete(draft, False)
        work.delete(place(folder), True)


def _write_rows(df: DataFrame, name: str, folder: str, wide: list[float] | None, freeze: bool, wide_columns: set[str]) -> str:
    """Writes the rows of a sheet below its header; gives what stands before them."""
    held = cut(df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("id", F.monotonically_increasing_id()))
    counts = held.groupBy(F.expr("id >> 33").alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row for each partition
    if sum(r.n for r in counts) >= MAX_ROWS:
        raise ValueError(f"{name} has more rows than a sheet can hold")
    before = dict(zip((r.part for r in counts), accumulate([2, *(r.n for r in counts)]), strict=False))
    first = held.orderBy("id").limit(200).drop("id").collect()

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            rows = zip(*columns, strict=True) if columns else [()] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([_row(before[i >> 33] + (i & 0x1FFFFFFFF), ("" if v is None else v for v in row)) for i, row in zip(ids, rows, strict=True)], pa.string())], ["value"])

    held.mapInArrow(run, "value string").write.option("compression", "none").option("lineSep", "\n").text(folder)
    return _sheet_start(df.columns, wide or fitted_widths(df.columns, [tuple("" if v is None else v for v in r) for r in first], wide_columns), freeze)
