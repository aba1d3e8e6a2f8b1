"""Ranks of rows in an order, without one task per group.

Rows are dealt out by ranges of the order and sorted where they are; what a range has to know of
others is one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.staging import stage


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the 0-based rank within ``group`` (nulls are a group) by ``order``, nulls
    first. Written; rows that tie in all columns of the order get the next ranks in any order."""
    part = spark_ranges(df, [*group, *order])
    part = stage(part, "ranked")
    counts = part.groupBy("__range", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offset = counts.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], (F.col("__before") - F.col("__first")).alias("__offset"))
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return part.join(offset, same).select(*df.columns, (F.col("__at") + F.col("__offset")).alias(name))


def spark_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted in ranges of ``order``, with the range and an ascending number."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return d.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
