"""Hardware counters: point samples, interval samples, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.windows import bucket_of
from spanloom.functions.names import unit_of
from spanloom.operators.buckets import in_buckets
from spanloom.operators.ordered import with_previous

#: Units of counters that are summed in a bucket; all others are averaged (fixed values).
SUMMED = ("cycles active", "requests")


def _quantiles(value: str, approximate: bool) -> list[Column]:
    q = (lambda p: F.percentile_approx(value, p, 10_000)) if approximate else (lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"))
    return [q(p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]


def point_summary(samples: DataFrame, by: tuple[str, ...] = ("type_id", "metric"), counters: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Per counter: n, extremes, mean, quantiles, time spanned, longest time between samples.
    Counters of the dictionary without samples stay with n 0."""
    s = with_previous(samples, by, ("ts_ns", "row_id"), ("ts_ns",)).withColumn("step", F.col("ts_ns") - F.col("previous.ts_ns"))
    g = s.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), *_quantiles("value", approximate), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"), F.max("step").alias("max_gap_ns"))
    return g if counters is None else counters.join(g, list(by), "left").fillna(0, ["n"])


def point_series(samples: DataFrame, width: int, by: tuple[str, ...] = ("type_id", "metric"), anchor: int = 0) -> DataFrame:
    """Per counter and bucket: n and value - the sum where the unit in brackets at the end of
    the counter's name says so, else the mean."""
    d = samples.withColumn("bucket_ns", bucket_of("ts_ns", width, anchor))
    value = F.when(F.lower(unit_of(F.max("metric"))).isin(*SUMMED), F.sum("value")).otherwise(F.avg("value"))
    return d.groupBy(*by, "bucket_ns").agg(F.count("*").alias("n"), value.alias("value"))


def interval_summary(samples: DataFrame, by: tuple[str, ...] = ("global_id", "port_id", "metric"), counters: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Per counter: n, extremes, time-weighted mean, quantiles, covered time."""
    d = samples.withColumn("ns", F.col("end_ns") - F.col("start_ns")).filter("ns > 0")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("value") * F.col("ns")) / F.sum("ns")).alias("mean"), *_quantiles("value", approximate), F.sum("ns").alias("covered_ns"))
    return g if counters is None else counters.join(g, list(by), "left").fillna(0, ["n", "covered_ns"])


def every_counter(names: DataFrame, ports: DataFrame) -> DataFrame:
    """Counter dictionary times ports: both are dictionaries, not samples."""
    return names.crossJoin(ports)


def interval_series(samples: DataFrame, width: int, by: tuple[str, ...] = ("global_id", "port_id", "metric")) -> DataFrame:
    """Per counter and bucket: time-weighted mean over the parts inside the bucket."""
    d = in_buckets(samples, width)
    return d.groupBy(*by, "bucket_ns").agg(F.count("*").alias("n"), (F.sum(F.col("value") * F.col("part_ns")) / F.sum("part_ns")).alias("value"))


def coverage(samples: DataFrame, trace: DataFrame) -> DataFrame:
    """Time the samples span against the trace's (one row: start_ns, end_ns)."""
    g = samples.agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")).crossJoin(trace)  # one row each
    return g.select("n", "first_ns", "last_ns", ((F.col("last_ns") - F.col("first_ns")) / (F.col("end_ns") - F.col("start_ns"))).alias("coverage"))
