"""What the operators share: word splitting over UTF-8 bytes, Arrow batches and cut lineage.

Every operator selects the columns that it reads under names of its own, so further columns of any name in its
input neither clash nor cost anything. A null text counts as an empty one unless an operator says otherwise.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handed on in slices of about so many bytes of text, so that what Python builds
#: beside them stays small. A longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: A key is hot if it holds more than so many rows, which a task takes with ease, and more than one in ``SHARE`` of all. There
#: are fewer than ``SHARE`` such keys, whatever the input's size.
EASY = 20_000
SHARE = 1000


def _fold_table() -> bytes:
    """Maps A-Z to a-z, keeps digits, a-z and every byte of a non-ASCII character, and makes the rest a space."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    upper = range(0x41, 0x5B)
    return bytes(b + 32 if b in upper else b if b in keep else 0x20 for b in range(256))


FOLD = _fold_table()


def folded_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(FOLD).split()


def spaced_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased; bytes know no other letters or spaces."""
    return text.lower().split()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts reach ``size`` bytes."""
    for batch in batches:
        start = held = 0
        lengths = pc.binary_length(batch.column(name)).to_pylist()
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow with ``fn`` on slices of bounded size."""

    def run(batches):
        for piece in slices(batches, text):
            yield fn(piece)

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a session without executors of its
    own, as in tests, gets a local one; a cluster has to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later steps read them again and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """The same rows, written as Parquet to the shared folder, and what removes them again. For rows with texts: they lie
    there compressed and by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), lambda: remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and in ``n`` how many rows hold it. ``table`` has to be
    cut before, as it is asked for its sizes.

    Hot keys, fewer than ``SHARE``, are broadcast, so their rows stay where they are; the others are joined by a shuffle.
    """
    total, top = table.agg(F.sum(n), F.max(n)).first()
    least = max(EASY, (total or 0) // SHARE)
    if (top or 0) <= least:
        return rows.join(table, key)
    hot = F.broadcast(table.where(F.col(n) > least))
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(few.join(table.where(F.col(n) <= least), key))


def ordered_sum(value: Column, partition: list[Column], order: list[Column]) -> Column:
    """Sum of the rows before this one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))
