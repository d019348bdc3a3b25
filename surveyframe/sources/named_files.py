"""``df.write.format("named_files")``: a file for each row, under the name in its column.

Register it once with ``spark.dataSource.register(NamedFiles)``. Rows have ``name`` (relative to the path, folders included) and ``content`` (string
or binary). Tasks write under temporary names; the commit, which sees names only, moves all files to their own. So a repeated
task or a run that fails leaves no half file. The path is in a store that pyarrow reaches; ``write_named`` falls back
to the driver, one file at a time, for any other that Spark reaches.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .xlsx import write_bytes
from .xlsx_source import _store


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def checked(name: str | None) -> str:
    """The name, if it stays below the folder."""
    if not name or name.startswith("/") or ".." in name.split("/") or posixpath.normpath(name) in (".", ""):
        raise ValueError(f"{name!r} can't name a file")
    return posixpath.normpath(name)


class NamedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, root = _store(self.path)
        return store, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, _, work = self._place()
        own, files = f"{work}/{uuid.uuid4().hex}", []
        store.create_dir(own)
        for n, row in enumerate(iterator):
            name, content = checked(row["name"]), row["content"]
            with store.open_output_stream(f"{own}/{n}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files.append((f"{own}/{n}", name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, work = self._place()
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several rows have the same name")
        for folder in sorted({posixpath.dirname(n) for n in names}):
            store.create_dir(f"{root}/{folder}" if folder else root)
        for written, name in files:
            store.move(written, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, work = self._place()
        if store.get_file_info(work).type != fs.FileType.NotFound:
            store.delete_dir(work)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("columns name and content are needed")
        return NamedWriter(self.options["path"])


def write_named(files: DataFrame, folder: str) -> None:
    """``files`` (name, content) as files in the folder; a file that is there already is replaced."""
    spark = files.sparkSession
    try:
        _store(folder)
    except (pa.ArrowInvalid, OSError):
        for r in files.toLocalIterator():
            write_bytes(spark, f"{folder}/{checked(r.name)}", r.content.encode() if isinstance(r.content, str) else bytes(r.content))
        return
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").save(folder)
