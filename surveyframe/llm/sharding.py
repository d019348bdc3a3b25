"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source the rows are put in a seeded order and ranked 1..n. A row's fractional rank is (rank - u) / n, where
u in [0, 1) is drawn from the source's name, so that many small sources don't all fall on the same spot. In the order of
fractional ranks every stretch holds each source in proportion; it is cut into shards whose row counts differ by one at
most.

Neither rank needs a source, or all rows, in one task: rows are dealt to buckets by the leading bits of their seeded hash
(then of their fractional rank), each bucket is ranked by itself, and the sums of the buckets before it are added. The
number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ordered_sum

#: Rows that one bucket should hold.
ROWS_PER_BUCKET = 20_000


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, source, position, shard, slot.

    ``size`` is the UTF-8 length of the text plus one (null: 1), ``text_crc32`` unsigned (null: 0). ``position`` runs
    over all rows from 0, ``slot`` over each shard's rows from 0. A null source is a source of its own. Rows equal in
    all columns that are read are interchangeable. No rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
    )
    rows = cut(rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    total = rows.count()
    buckets = max(16, 1 << (max(1, total // ROWS_PER_BUCKET) - 1).bit_length())
    key = F.xxhash64(F.lit(seed), F.lit("source"), F.coalesce("source", F.lit("")), F.col("source").isNull())

    # Rank within the source: rows of the source in earlier buckets, plus the rank within the bucket.
    rows = rows.withColumns({"key": key, "bucket": F.pmod(F.shiftrightunsigned("order", 40), F.lit(buckets))})
    held = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("key", "bucket", ordered_sum(F.col("n"), [F.col("key")], [F.col("bucket")]).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("of_source"))
    own = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(own)).join(before, ["key", "bucket"])
    start = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", "source", "order", "key", ((F.col("before") + F.col("nth") - start) / F.col("of_source")).alias("fraction")))

    # The place among all rows, in the same way.
    ranked = ranked.withColumn("stretch", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    held = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("stretch", ordered_sum(F.col("n"), [], [F.col("stretch")]).alias("before"))
    own = Window.partitionBy("stretch").orderBy("fraction", "key", "order", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("nth", F.row_number().over(own)).join(before, "stretch")
    position = (F.col("before") + F.col("nth") - 1).cast("long")
    placed = placed.select("doc_id", "size", "text_crc32", "source", position.alias("position"))
    shard = F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as long) * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("position") - first).cast("long"))
