"""Column expressions on times: nanoseconds as longs, half-open windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(df: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Rows that overlap [lo, hi)."""
    d = df if hi is None else df.filter(F.col("start_ns") < hi)
    return d if lo is None else d.filter(F.col("end_ns") > lo)


def within(df: DataFrame, lo: int | None, hi: int | None, at: str = "ts_ns") -> DataFrame:
    """Rows whose point lies in [lo, hi)."""
    d = df if lo is None else df.filter(F.col(at) >= lo)
    return d if hi is None else d.filter(F.col(at) < hi)


def clipped(lo: int | Column | None, hi: int | Column | None, start: str | Column = "start_ns", end: str | Column = "end_ns") -> Column:
    """Nanoseconds of the part inside [lo, hi)."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (e if hi is None else F.least(e, as_col(hi))) - (s if lo is None else F.greatest(s, as_col(lo)))


def positive_intervals(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows with 0 <= start < end that overlap the window, cut to it."""
    d = overlaps(df.filter((F.col("start_ns") >= 0) & (F.col("end_ns") > F.col("start_ns"))), lo, hi)
    s = F.col("start_ns") if lo is None else F.greatest("start_ns", F.lit(lo))
    e = F.col("end_ns") if hi is None else F.least("end_ns", F.lit(hi))
    return d.withColumns({"start_ns": s, "end_ns": e})


def bucket_of(t: str | Column, width: int, anchor: int = 0) -> Column:
    """Start of the bucket that holds ``t``; floors also before the anchor."""
    c = F.col(t) if isinstance(t, str) else t
    return c - F.pmod(c - anchor, F.lit(width))


def duration_filter(op: str, *ns: int) -> Column:
    """``>``, ``>=``, ``<``, ``<=`` a number, or ``range`` with both ends."""
    d = F.col("end_ns") - F.col("start_ns")
    if op == "range":
        return d.between(*ns)
    tests = {">": d > ns[0], ">=": d >= ns[0], "<": d < ns[0], "<=": d <= ns[0]}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op]
