"""Cutting lineage in the folder that all executors share, and numbering rows on top of it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder in spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


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


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with a column that numbers its rows from 1 in ``order``, without bringing them to one task.

    The rows are sorted in ranges and written once; each range is numbered by itself, behind the rows of the ranges before it.
    """
    held = cut(df.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    sizes = held.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return held.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + nth).cast("long")).drop("__range", "__before")
