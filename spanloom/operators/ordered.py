"""Neighbours, ordinals and running values in order of time, without one task per key.

Rows are cut into chunks of time at quantiles, so that about ``CHUNK_ROWS`` rows lie in one however
they are spread: a burst gets many chunks, and a row with a wrong time moves no edge. Rows of one key
and chunk meet in a window; what a chunk has to know of others (their first row, count, sum or
maximum) is one row per key and chunk. A device, thread, counter or name that holds most of a table, or
a trace of a minute, is so dealt to as many tasks as its rows need. Times that are equal lie in
one chunk. The edges are found by a sketch of the times, and are ``MOST_CHUNKS`` at
most: beyond some billion rows chunks grow with the table instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS, MOST_CHUNKS = 262_144, 4096


def chunk_edges(df: DataFrame, t: str, rows: int | None = None) -> tuple[list[int], int]:
    """Ascending times at which chunks begin but the first, and the least time (0 without rows). A
    table of one chunk needs no sketch."""
    seen = df.agg(F.count(t).alias("n"), F.min(t).alias("lo")).first()
    parts = min(MOST_CHUNKS, -(-seen["n"] // (rows or CHUNK_ROWS)))
    if parts < 2:
        return [], seen["lo"] or 0
    at = ",".join(f"{i / parts}D" for i in range(1, parts))
    return sorted(set(df.agg(F.expr(f"percentile_approx({t}, array({at}), {4 * MOST_CHUNKS})")).first()[0]) - {seen["lo"]}), seen["lo"]


def chunk_of(t: str, edges: list[int]) -> Column:
    """Number of edges at or before a time, by halving."""
    steps, size = [], 1
    while size <= len(edges):
        steps, size = [size, *steps], size * 2
    if not steps:
        return F.lit(0)
    known = F.expr(f"array({','.join(f'{e}L' for e in edges)})")
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, x: at + F.when(F.coalesce(F.get(known, at + x - 1) <= F.col(t), F.lit(False)), x).otherwise(0))


def _cut(df: DataFrame, t: str, rows: int | None) -> tuple[DataFrame, bool]:
    """``df`` with ``__chunk``, ascending in time ``t``, and whether there may be several."""
    if "__chunk" in df.columns:
        return df, True
    edges = chunk_edges(df, t, rows)[0]
    return df.withColumn("__chunk", chunk_of(t, edges)), bool(edges)


def chunked(df: DataFrame, t: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``__chunk``, ascending in time ``t``; as it is if it has one."""
    return _cut(df, t, rows)[0]


def _same(by: tuple[str, ...]) -> Column:
    """Rows of one key (nulls are a key) and chunk."""
    same = F.col("__chunk") == F.col("__at")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return same


def _neighbour(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cols: tuple[str, ...], name: str, after: bool, rows: int | None) -> DataFrame:
    d, many = _cut(df, order[0], rows)
    mine, value = W.partitionBy(*by, "__chunk").orderBy(*order), F.struct(*cols)
    if not many:
        return d.withColumn(name, (F.lead(value) if after else F.lag(value)).over(mine)).drop("__chunk")
    edge = F.struct(*order, value.alias("__v"))
    edges = d.groupBy(*by, "__chunk").agg((F.min(edge) if after else F.max(edge))["__v"].alias("__v"))
    over = W.partitionBy(*by).orderBy("__chunk")
    edges = edges.select(*by, "__chunk", (F.lead("__v") if after else F.lag("__v")).over(over).alias("__far"))
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__chunk").alias("__at"), "__far")
    d = d.withColumn("__near", (F.lead(value) if after else F.lag(value)).over(mine))
    d = d.join(edges, _same(by))
    return d.withColumn(name, F.coalesce("__near", "__far")).drop("__chunk", "__near", "__far", "__at", *[f"__{k}" for k in by])


def with_next(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cols: tuple[str, ...], name: str = "next", rows: int | None = None) -> DataFrame:
    """``df`` with a struct of ``cols`` of the next row of the same key; null at the end."""
    return _neighbour(df, by, order, cols, name, True, rows)


def with_previous(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cols: tuple[str, ...], name: str = "previous", rows: int | None = None) -> DataFrame:
    """``df`` with a struct of ``cols`` of the row before it of the same key; null at the start."""
    return _neighbour(df, by, order, cols, name, False, rows)


def with_ordinal(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str, rows: int | None = None) -> DataFrame:
    """``df`` with the number of rows of the same key that come before."""
    d, many = _cut(df, order[0], rows)
    here = F.row_number().over(W.partitionBy(*by, "__chunk").orderBy(*order)) - 1
    if not many:
        return d.withColumn(name, here.cast("long")).drop("__chunk")
    counts = d.groupBy(*by, "__chunk").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__chunk").alias("__at"), before.alias("__before"))
    d = d.withColumn("__here", here)
    d = d.join(counts, _same(by)).withColumn(name, (F.col("__before") + F.col("__here")).cast("long"))
    return d.select(*[c for c in df.columns if c != name], name)
