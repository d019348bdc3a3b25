"""Exact dedup over a cuckoo-filter index of live digests.

``CuckooIndex`` keeps, for each live digest, one fingerprint in one of two buckets of a filter and its stored key
(the whole digest with its payload) in the content bucket that its first hash names. A lookup that misses the filter
is surely new. A hit is verified against the content bucket, so false positives of the filter never count. When an
insertion finds no room after the usual evictions, the filter is built anew with twice the buckets from the stored keys.

``exact_duplicates`` deals the digests to as many partitions as their number asks for, each with an index of its own.
Rows that are equal in id and text are counted before the shuffle, so a group of copies that holds a third of all rows
reaches the index as one row for each of its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Slots of a bucket and evictions before the filter counts as full.
SLOTS = 4
KICKS = 200
#: Distinct digests that one index partition should hold, about 60 MB in Python.
KEYS_PER_PARTITION = 200_000
_SPREAD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class CuckooIndex:
    """A dictionary from digests (at least 16 bytes) to payloads that is asked through a cuckoo filter."""

    def __init__(self, capacity: int = 1024):
        self.resizes = 0
        self.false_hits = 0
        self.content: dict[int, list[tuple[bytes, object]]] = {}
        self.size = 0
        self._build(max(2, 1 << max(1, (capacity * 5 // 4 // SLOTS)).bit_length()))

    def _build(self, buckets: int) -> None:
        self.n = buckets
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    @staticmethod
    def _hash(digest: bytes) -> tuple[int, int]:
        """Fingerprint (16 bits, never 0) and the number that names the buckets."""
        return (int.from_bytes(digest[:2], "little") or 1), int.from_bytes(digest[2:10], "little")

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * _SPREAD & _MASK) >> 20) & (self.n - 1)

    def _stored(self, number: int) -> list[tuple[bytes, object]]:
        return self.content.get(number & 0xFFFFFF, [])

    def may_hold(self, digest: bytes) -> bool:
        mark, number = self._hash(digest)
        first = number & (self.n - 1)
        return mark in self.slots[first] or mark in self.slots[self._other(first, mark)]

    def get(self, digest: bytes):
        """The payload of a live digest, else None."""
        if not self.may_hold(digest):
            return None
        for key, payload in self._stored(self._hash(digest)[1]):
            if key == digest:
                return payload
        self.false_hits += 1
        return None

    def _place(self, digest: bytes) -> bool:
        mark, number = self._hash(digest)
        bucket = number & (self.n - 1)
        for b in (bucket, self._other(bucket, mark)):
            if len(self.slots[b]) < SLOTS:
                self.slots[b].append(mark)
                return True
        for kick in range(KICKS):
            row = self.slots[bucket]
            mark, row[kick % SLOTS] = row[kick % SLOTS], mark
            bucket = self._other(bucket, mark)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return True
        return False

    def insert(self, digest: bytes, payload) -> None:
        """Adds a digest that isn't live."""
        self.content.setdefault(self._hash(digest)[1] & 0xFFFFFF, []).append((digest, payload))
        self.size += 1
        if not self._place(digest):
            self._resize()

    def _resize(self) -> None:
        """Doubles the buckets until every stored key has its place."""
        while True:
            self.resizes += 1
            self._build(self.n * 2)
            if all(self._place(key) for row in self.content.values() for key, _ in row):
                return

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out; False if it isn't live, and then nothing changes."""
        if self.get(digest) is None:
            return False
        mark, number = self._hash(digest)
        first = number & (self.n - 1)
        for b in (first, self._other(first, mark)):
            if mark in self.slots[b]:
                self.slots[b].remove(mark)
                break
        row = self._stored(number)
        row[:] = [x for x in row if x[0] != digest]
        if not row:
            del self.content[number & 0xFFFFFF]
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for row in self.content.values():
            yield from row


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs the digests of a partition through its index: a larger id deletes the live entry and takes its place."""
    index = CuckooIndex()
    for batch in batches:
        for digest, doc, copies in zip(*(batch.column(k).to_pylist() for k in ("digest", "doc_id", "copies")), strict=True):
            live = index.get(digest)
            if live is None:
                index.insert(digest, (doc, copies))
                continue
            keep, size = live
            if doc is not None and (keep is None or doc > keep):
                keep = doc
            index.delete(digest)
            index.insert(digest, (keep, size + copies))
    rows: list[tuple] = []
    for digest, (keep, size) in index.items():
        rows.append((digest, keep, size))
        if len(rows) == 20_000:
            yield _found(rows)
            rows = []
    yield _found(rows)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "keep_id", "group_size"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, digest, copies)``, equal rows counted: the sha256 of each text, null as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))


def live_digests(counted: DataFrame) -> DataFrame:
    """Rows ``(digest, keep_id, group_size)``, one for each distinct text, out of the index partitions."""
    spark = counted.sparkSession
    # A hot group has many ids: they are brought together before the digest's own partition sees them.
    merged = counted.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt")).agg(F.max("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // KEYS_PER_PARTITION))
    return merged.select("digest", "doc_id", "copies").repartition(parts, "digest").mapInArrow(_index_partition, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null is empty, nothing else is changed) the row with the largest id stays; a null id is smaller
    than any other. Of rows equal in id and text one stays. No rows give no rows.
    """
    counted = cut(digests(docs, id_col, text_col))
    joined = join_hot(counted, cut(live_digests(counted)), "digest", "group_size")
    nth = F.explode(F.sequence(F.lit(1), F.col("copies")))
    every = joined.select("doc_id", "keep_id", "group_size", "digest", nth.alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return every.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    counted = cut(digests(docs, id_col, text_col))
    live = live_digests(counted).select("digest", F.col("keep_id").alias("doc_id"))
    kept = cut(live.join(counted.withColumnRenamed("doc_id", "own_id"), "digest").where(F.col("doc_id").eqNullSafe(F.col("own_id"))).select("digest", "doc_id", "copies"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"), F.col(id_col).cast("long").alias("own_id"))
    found = rows.join(kept, (rows.digest == kept.digest) & rows.own_id.eqNullSafe(kept.doc_id)).select("row", rows.digest, "own_id", "copies")
    single = found.where("copies = 1").select("row")
    # Rows that are equal in id and text: any other column decides, and of wholly equal rows either is the same.
    repeated = found.where("copies > 1").groupBy("digest", "own_id").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(repeated).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
