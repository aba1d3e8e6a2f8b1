"""Sums of nanoseconds and counts that 64 bits may not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.staging import stage

#: Largest value of a long.
MOST = 2**63 - 1


def wide_sum(col: str | Column) -> Column:
    """Exact sum of whole numbers, as a decimal of 38 digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")


def fitted(df: DataFrame, *cols: str) -> DataFrame:
    """A result of few rows with those of its wide sums as longs that fit; one that doesn't fit stays a
    decimal, for all rows. The result is staged, so it isn't computed twice."""
    d = stage(df, "sums")
    fits = d.agg(*[F.coalesce(F.max(F.abs(c)) <= F.lit(MOST), F.lit(True)).alias(c) for c in cols]).first()
    return d.withColumns({c: F.col(c).cast("long") for c in cols if fits[c]})
