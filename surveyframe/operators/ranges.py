"""Range join: which ranges of a sheet (merges, lists) lie over its rows and cells.

Ranges are indexed by bands of rows. A range's level is the smallest of ``LEVELS`` whose bands of 2^level rows are at least as
high as the range, so it lies in two bands at most, however high it is. A row looks up one band for each level, and what it
finds is checked behind the equality join. So a list on a whole column costs two index rows, and no row or cell that
isn't asked about is ever made. Spark broadcasts the index where it is small and shuffles by sheet and band where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["file_name", "sheet"]
#: Binary logarithms of the heights of bands. A sheet has 2^20 rows.
LEVELS = (0, 4, 8, 12, 16, 20)


def _level(height: Column) -> Column:
    level = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        level = F.when(height <= 1 << k, k).otherwise(level)
    return level


def band_index(ranges: DataFrame) -> DataFrame:
    """``ranges`` (KEY, min_row, max_row, ...) once for each band that they lie in, with level and band."""
    leveled = ranges.where("min_row <= max_row").withColumn("level", _level(F.col("max_row") - F.col("min_row") + 1))
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    return leveled.withColumn("band", F.explode(F.array_distinct(F.array(shift("min_row"), shift("max_row")))))


def over_rows(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """KEY, row and the other columns of every range that lies over the row. ``rows``: KEY, row, distinct."""
    levels = F.explode(F.array(*[F.lit(k) for k in LEVELS])).alias("level")
    probes = rows.select(*KEY, "row", levels).withColumn("band", F.call_function("shiftright", F.col("row"), F.col("level")))
    met = probes.join(band_index(ranges), [*KEY, "level", "band"]).where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    return met.drop("level", "band")


def located(points: DataFrame, merges: DataFrame | None, lists: DataFrame | None) -> DataFrame:
    """``points`` (KEY, row, col, ...) with anchor_row and anchor_col of the merge over them (of several the one that starts last)
    and the options of the list over them (of several the one defined last); null where there is none."""
    rows, out = points.select(*KEY, "row").distinct(), points
    if merges is not None:
        found = _by_row(rows, merges, F.struct("min_row", "min_col", "max_col"))
        out = out.join(found, [*KEY, "row"], "left").withColumn("of", _last_over("of", "col"))
        out = out.withColumns({"anchor_row": F.col("of.min_row"), "anchor_col": F.col("of.min_col")}).drop("of")
    if lists is not None:
        found = _by_row(rows, lists, F.struct("pos", "min_col", "max_col", F.btrim("options", F.lit('"')).alias("options")))
        out = out.join(found, [*KEY, "row"], "left").withColumn("options", _last_over("of", "col")["options"]).drop("of")
    return out


def _by_row(rows: DataFrame, ranges: DataFrame, kept: Column) -> DataFrame:
    """KEY, row and ``of``: what is kept of the ranges over the row. Rows without any are left out."""
    return over_rows(rows, ranges).groupBy(*KEY, "row").agg(F.collect_list(kept).alias("of"))


def _last_over(ranges: str, col: str) -> Column:
    return F.array_max(F.filter(ranges, lambda r: F.col(col).between(r["min_col"], r["max_col"])))


def entry_cells(cells: DataFrame, merges: DataFrame, lists: DataFrame | None, first: int, side_last: int) -> DataFrame:
    """KEY, row, col of cells that the grid lacks and a reader needs: in every row in use, each merge's first cell, its first from column
    ``first`` on, and the first that it shares with a list up to ``side_last``."""
    rows = cells.select(*KEY, "row").distinct()
    over = over_rows(rows, merges).select(*KEY, "row", "min_col", "max_col")
    starts = F.array("min_col", F.greatest("min_col", F.lit(first)))
    found = over.select(*KEY, "row", "max_col", F.explode(starts).alias("col")).where("col <= max_col").drop("max_col")
    if lists is not None:
        other = over_rows(rows, lists).select(*KEY, "row", F.col("min_col").alias("list_min"), F.col("max_col").alias("list_max"))
        shared = over.join(other, [*KEY, "row"]).withColumn("col", F.greatest("min_col", "list_min", F.lit(first))).where(F.col("col") <= F.least("max_col", "list_max", F.lit(side_last)))
        found = found.unionByName(shared.select(*KEY, "row", "col"))
    return found.distinct().join(cells.select(*KEY, "row", "col"), [*KEY, "row", "col"], "left_anti")
