"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypomill.runtime import materialize


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the row's number from 1 within its keys by ``order`` (column names, ascending).

    Rows are range partitioned by keys and order and written once; a row's number is its number
    within its range plus the rows of its group in lower ranges. A group that holds a third
    of all rows spreads over a third of the ranges, where a window over the keys alone would
    sort it in one task. Rows equal in keys and order are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    offsets = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), before.alias("_before"))
    same: Column = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.withColumn("_within", within).join(offsets, same).withColumn(out, F.col("_before") + F.col("_within")).select(*df.columns, out)
