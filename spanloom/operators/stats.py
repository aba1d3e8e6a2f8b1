"""Statistics of spans by composable axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.sums import wide_sum
from spanloom.functions.windows import clipped, overlaps

#: Bounds of the duration histogram in nanoseconds, half decades from 10 ns to 1 s (fixed values).
BOUNDS = (10, 32, 100, 316, 1_000, 3_162, 10_000, 31_623, 100_000, 316_228, 1_000_000, 3_162_278, 10_000_000, 31_622_776, 100_000_000, 316_227_766, 1_000_000_000)


def _disc(p: float, col: str = "ns") -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").cast("long")


def measures(col: str = "ns") -> list[Column]:
    """n, total, mean (half even), extremes and discrete quantiles of a column."""
    return [
        F.count("*").alias("n"), F.sum(col).alias("total"), F.bround(F.avg(col)).cast("long").alias("mean"), F.min(col).alias("least"), F.max(col).alias("most"),
        _disc(0.5, col).alias("p50"), _disc(0.95, col).alias("p95"), _disc(0.99, col).alias("p99"),
    ]


def span_stats(spans: DataFrame, by: tuple[str, ...], window: tuple[int, int] | None = None, histogram: bool = False) -> DataFrame:
    """Per group: measures of the (clipped) duration, bytes, gbps and the group's share of the
    whole, which may be more than 64 bits hold. Rows without time in the window are dropped."""
    lo, hi = window or (None, None)
    d = overlaps(spans, lo, hi).withColumn("ns", clipped(lo, hi)).filter("ns > 0")
    more = [F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")] if "bytes" in spans.columns else []
    if histogram:
        edges = (0, *BOUNDS, None)
        inside = lambda a, b: (F.col("ns") >= a) & ((F.col("ns") < b) if b is not None else F.lit(True))
        more.append(F.array(*[F.count(F.when(inside(a, b), 1)) for a, b in zip(edges, edges[1:], strict=False)]).alias("histogram"))
    g = d.groupBy(*by).agg(*measures(), *more)
    if "bytes" in spans.columns:
        g = g.withColumn("gbps", F.when(F.col("total") > 0, F.col("bytes") / F.col("total")))
    whole = d.agg(wide_sum("ns").cast("double").alias("whole"))
    return g.crossJoin(whole).withColumn("share", F.col("total") / F.col("whole")).drop("whole")  # one row


def size_stats(spans: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same measures over bytes, for kinds that have them."""
    return spans.filter(F.col("kind").isin("memcpy", "memset") & (F.col("bytes") > 0)).groupBy(*by).agg(*measures("bytes"))


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, first start, last end."""
    out = None
    for name, df in tables.items():
        start = next((c for c in ("start_ns", "ts_ns") if c in df.columns), None)
        end = "end_ns" if "end_ns" in df.columns else start
        null = F.lit(None).cast("long")
        s = df.agg(F.count("*").alias("n"), (F.min(start) if start else null).alias("first_ns"), (F.max(end) if end else null).alias("last_ns"))
        s = s.select(F.lit(name).alias("table_name"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def trace_origin(summary: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """Bounds of the primary tables, or of all where those are empty; and of all tables."""
    first = F.col("table_name").isin(*primary)
    return summary.agg(
        F.coalesce(F.min(F.when(first, F.col("first_ns"))), F.min("first_ns")).alias("primary_start"), F.coalesce(F.max(F.when(first, F.col("last_ns"))), F.max("last_ns")).alias("primary_end"),
        F.min("first_ns").alias("full_start"), F.max("last_ns").alias("full_end"),
    )


def compare(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two results side by side by key: value_a, value_b, change; missing counts as null."""
    x, y = a.select(*key, F.col(value).alias("value_a")), b.select(*key, F.col(value).alias("value_b"))
    d = x.join(y, key, "full")
    return d.withColumn("change", F.coalesce("value_b", F.lit(0)) - F.coalesce("value_a", F.lit(0)))


def replays(spans: DataFrame, key: tuple[str, ...] = ("process_id", "device_id", "context_id", "correlation_id")) -> DataFrame:
    """Graph replays by identity: wall, sum, busy and idle time, events, kinds, streams."""
    from spanloom.operators.intervals import concurrency

    d = spans.filter(F.col("end_ns") > F.col("start_ns"))
    g = d.groupBy(*key).agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("sum_ns"), F.count("*").alias("events"),
        F.countDistinct("kind").alias("kinds"), F.countDistinct("stream_id").alias("streams"),
    )
    busy = concurrency(d, key).select(*key, F.col("union_ns").alias("busy_ns"))
    g = g.withColumn("wall_ns", F.col("end_ns") - F.col("start_ns")).join(busy, list(key))
    return g.withColumn("idle_ns", F.col("wall_ns") - F.col("busy_ns"))
