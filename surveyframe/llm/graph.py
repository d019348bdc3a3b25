"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes in ``edges`` (a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each node sends its larger, then its smaller neighbours to the smallest
    one it knows, until nothing changes. A step shuffles narrow rows by node; each is written to the shared folder, so a
    lost executor costs no earlier step. The smallest neighbour is found by an aggregation, so the rows of a node with
    very many neighbours need not meet in one task.
    """
    current = cut(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    state = None
    while True:
        large = cut(_star(current, larger=True))
        current = cut(_star(large, larger=False))
        now = current.agg(F.count(F.lit(1)), F.sum(F.col("low").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("low", "high"))).first()
        if now == state:
            break
        state = now
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connects a node's larger (or its smaller or equal) neighbours with the smallest of its neighbours and itself."""
    if larger:
        both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
    else:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    found = both.join(least, "node")
    found = found.where("other > node") if larger else found
    pairs = found.select(F.col("least").alias("low"), F.col("other").alias("high"))
    if not larger:
        pairs = pairs.unionByName(least.select(F.col("least").alias("low"), F.col("node").alias("high")))
    return pairs.where("low < high").distinct()


def ranked_within(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``nth``, from 1 within its keys."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
