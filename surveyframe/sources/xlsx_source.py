"""``spark.read.format("xlsx_cells")``: the cells of workbooks as a data source, a task for each sheet.

Register it once with ``spark.dataSource.register(XlsxCells)``. The path is a workbook or a folder of them, in a store that pyarrow
reaches (local, HDFS, S3, GCS by URI); ``list_files`` and ``read_cells`` of ``xlsx`` read through Spark's own file systems instead. A
task opens its file at the places that it needs: the sheet and the tables of strings and styles. A schema with fewer
columns is read as such. With spark.sql.python.filterPushdown.enabled comparisons of file_name, sheet, row and col with
constants reach the source: files and sheets that they rule out make no task, and cells outside stay in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .xlsx import _BATCH, CELL_SCHEMA, Workbook

_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
_PUSHED = {"file_name", "sheet", "sheet_pos", "row", "col"}


@dataclass
class Sheet(InputPartition):
    path: str
    file_name: str
    name: str
    pos: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and column in _PUSHED and f.value is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _passes(self, **values) -> bool:
        return all(_TESTS[kind](values[column], value) for column, kind, value in self.tests if column in values)

    def partitions(self) -> list[Sheet]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.path)
        found = []
        for i in names:
            if i.type == fs.FileType.File and (i is info or i.base_name.endswith(".xlsx") and not i.base_name.startswith("~$")) and self._passes(file_name=i.base_name):
                with store.open_input_file(i.path) as f:
                    found += [Sheet(i.path, i.base_name, name, pos) for pos, (name, _) in enumerate(Workbook(f).sheets) if self._passes(sheet=name, sheet_pos=pos)]
        return found or [Sheet("", "", "", -1)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if partition.pos < 0:
            return
        columns = [f.name for f in self.schema]
        kind, held, n = to_arrow_schema(self.schema), {c: [] for c in columns}, 0
        with _store(self.path)[0].open_input_file(partition.path) as f:
            for _, (row, col, value, rgb, fill_type, bold, italic, size, given) in Workbook(f).parts(partition.pos, {"cell"}):
                if not self._passes(row=row, col=col):
                    continue
                cell = {"file_name": partition.file_name, "sheet": partition.name, "sheet_pos": partition.pos, "row": row, "col": col, "value": value, "fill_rgb": rgb, "fill_type": fill_type, "bold": bold, "italic": italic, "font_size": size, "value_type": given}
                for c in columns:
                    held[c].append(cell[c])
                n += 1
                if n == _BATCH:
                    yield pa.RecordBatch.from_pydict(held, kind)
                    held, n = {c: [] for c in columns}, 0
        if n:
            yield pa.RecordBatch.from_pydict(held, kind)


class XlsxCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema: StructType) -> XlsxReader:
        unknown = [f.name for f in schema if f.name not in {c.split()[0] for c in CELL_SCHEMA.split(", ")}]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        return XlsxReader(self.options["path"], schema)
