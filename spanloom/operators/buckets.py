"""Activity over time: buckets are made from the spans' side, never buckets times spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.windows import bucket_of, clipped, overlaps


def in_buckets(df: DataFrame, width: int, anchor: int = 0) -> DataFrame:
    """One row per span and bucket it touches: ``bucket_ns`` and ``part_ns``, its time there."""
    d = df.filter(F.col("end_ns") > F.col("start_ns"))
    d = d.withColumn("bucket_ns", F.explode(F.sequence(bucket_of("start_ns", width, anchor), bucket_of(F.col("end_ns") - 1, width, anchor), F.lit(width).cast("long"))))
    return d.withColumn("part_ns", clipped(F.col("bucket_ns"), F.col("bucket_ns") + width))


def activity(spans: DataFrame, width: int, anchor: int = 0, window: tuple[int, int] | None = None, kinds: tuple[str, ...] = ("kernel", "memcpy", "memset", "graph")) -> DataFrame:
    """Per bucket: n, total_ns and time by kind; empty buckets don't appear."""
    d = spans
    if window:
        d = overlaps(d, *window).withColumns({"start_ns": F.greatest("start_ns", F.lit(window[0])), "end_ns": F.least("end_ns", F.lit(window[1]))})
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("part_ns")).otherwise(0)).alias(f"{k}_ns")
    return in_buckets(d, width, anchor).groupBy("bucket_ns").agg(F.count("*").alias("n"), F.sum("part_ns").alias("total_ns"), *[of(k) for k in kinds])


def density(spans: DataFrame, width: int, track: Column) -> DataFrame:
    """Per track and bin of start: n, total, longest, the kind with most time and time by kind."""
    d = spans.select(track.alias("track"), bucket_of("start_ns", width).alias("bin_ns"), "kind", (F.col("end_ns") - F.col("start_ns")).alias("ns"))
    k = d.groupBy("track", "bin_ns", "kind").agg(F.count("*").alias("n"), F.sum("ns").alias("ns"), F.max("ns").alias("longest"))
    return k.groupBy("track", "bin_ns").agg(
        F.sum("n").alias("n"), F.sum("ns").alias("total_ns"), F.max("longest").alias("longest_ns"), F.max_by("kind", F.struct("ns", "kind")).alias("top_kind"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("ns").cast("string")))), ",").alias("by_kind"),
    )
