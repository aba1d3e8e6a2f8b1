"""CPU samples with call chains, and the scheduler's switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import basename
from spanloom.functions.sums import wide_sum
from spanloom.functions.windows import bucket_of
from spanloom.operators.buckets import in_buckets
from spanloom.operators.ordered import with_next, with_previous


def leaves(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples with symbol and module of the innermost frame; unresolved ones by module."""
    leaf = frames.filter("stack_depth = 0").select("id", "symbol", "module", "unresolved", "kernel_mode")
    s = samples.join(leaf, "id", "left").withColumn("module", basename("module"))
    return s.withColumn("symbol", F.when(F.coalesce("unresolved", F.lit(True)), F.concat(F.lit("<unresolved>@"), F.coalesce("module", F.lit("?")))).otherwise(F.col("symbol")))


def hotspots(samples: DataFrame, by: str) -> DataFrame:
    """Per value: samples, share of all, and the earliest sample as an example."""
    g = samples.groupBy(by).agg(F.count("*").alias("n"), F.min_by("id", F.struct("start_ns", "id")).alias("example"))
    return g.crossJoin(samples.agg(F.count("*").alias("all"))).withColumn("share", F.col("n") / F.col("all")).drop("all")  # one row


def stacks(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples with their stack, innermost frame first, joined by ``;``."""
    s = frames.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stack_depth", "symbol"))), lambda x: x["symbol"]), ";").alias("stack"))
    return samples.join(s, "id")


def sampling_trust(samples: DataFrame, frames: DataFrame, deep: int) -> DataFrame:
    """Shares of samples whose leaf is unresolved or in the kernel, and of stacks cut at ``deep``."""
    f = frames.groupBy("id").agg(F.max(F.when(F.col("stack_depth") == 0, F.col("unresolved").cast("int"))).alias("u"), F.max(F.when(F.col("stack_depth") == 0, F.col("kernel_mode"))).alias("k"), F.max("stack_depth").alias("depth"))
    s = samples.select("id").join(f, "id", "left")
    share = lambda c: (F.count(F.when(c, 1)) / F.count("*"))
    return s.agg(F.count("*").alias("n"), share(F.col("u") == 1).alias("unresolved"), share(F.col("k") == 1).alias("kernel"), share(F.col("depth") + 1 >= deep).alias("cut"))


def sample_series(samples: DataFrame, by: str, width: int) -> DataFrame:
    """Samples per bucket and value."""
    return samples.groupBy(bucket_of("start_ns", width).alias("bucket_ns"), by).agg(F.count("*").alias("n"))


def quanta(sched: DataFrame) -> DataFrame:
    """Times on a CPU: a switch in whose next switch of the same thread on the same CPU is one
    out. ``state`` is the one the thread left in."""
    s = with_next(sched, ("global_tid", "cpu"), ("start_ns", "row_id"), ("start_ns", "is_in", "state")).filter("is_in = 1 and next.is_in = 0")
    return s.select("global_tid", "cpu", F.col("next.state").alias("state"), "start_ns", F.col("next.start_ns").alias("end_ns"), (F.col("next.start_ns") - F.col("start_ns")).alias("ns"))


def _with_idle(d: DataFrame) -> DataFrame:
    """Time seen but not on a CPU, and the mean quantum (null without one)."""
    d = d.fillna(0, ["on_ns", "quanta"])
    return d.withColumns({"off_ns": F.greatest(F.col("span_ns") - F.col("on_ns"), F.lit(0)).cast("long"), "mean_ns": F.when(F.col("quanta") > 0, F.expr("on_ns div quanta"))})


def thread_time(sched: DataFrame) -> DataFrame:
    """Per thread: time on and off CPUs, quanta, time seen, mean quantum."""
    on = quanta(sched).groupBy("global_tid").agg(F.sum("ns").alias("on_ns"), F.count("*").alias("quanta"))
    seen = sched.groupBy("global_tid").agg((F.max("start_ns") - F.min("start_ns")).alias("span_ns"))
    return _with_idle(seen.join(on, "global_tid", "left"))


def cpu_time(sched: DataFrame) -> DataFrame:
    """Per CPU: busy (a decimal) and idle time, quanta, threads, time seen, mean quantum."""
    on = quanta(sched).groupBy("cpu").agg(wide_sum("ns").alias("on_ns"), F.count("*").alias("quanta"), F.countDistinct("global_tid").alias("threads"))
    seen = sched.groupBy("cpu").agg((F.max("start_ns") - F.min("start_ns")).alias("span_ns"))
    return _with_idle(seen.join(on, "cpu", "left").fillna(0, ["threads"]))


def state_time(sched: DataFrame) -> DataFrame:
    """Per state in which threads left a CPU: time until the thread was on any CPU again, times
    it was left for, time of the quanta that ended so, and their mean. Times are decimals."""
    s = with_next(sched, ("global_tid",), ("start_ns", "row_id"), ("start_ns", "is_in")).filter("is_in = 0")
    away = F.when(F.col("next.is_in") == 1, F.col("next.start_ns") - F.col("start_ns")).otherwise(0)
    off = s.groupBy("state").agg(wide_sum(away).alias("off_ns"), F.count("*").alias("switches"))
    on = quanta(sched).groupBy("state").agg(wide_sum("ns").alias("on_ns"), F.count("*").alias("quanta"))
    d = off.join(on, off["state"].eqNullSafe(on["state"]), "full").select(F.coalesce(off["state"], on["state"]).alias("state"), "off_ns", "switches", "on_ns", "quanta")
    d = d.fillna(0, ["off_ns", "switches", "on_ns", "quanta"])
    return d.withColumn("mean_ns", F.when(F.col("quanta") > 0, F.expr("on_ns div quanta")))


def sched_trust(sched: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Per CPU: share of switches in unknown states, longest time without a switch."""
    s = with_previous(sched, ("cpu",), ("start_ns", "row_id"), ("start_ns",)).withColumn("gap", F.col("start_ns") - F.col("previous.start_ns"))
    return s.groupBy("cpu").agg((F.count(F.when(~F.col("state").isin(*known), 1)) / F.count("*")).alias("unknown"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_ns"))


def on_cpu_series(sched: DataFrame, by: str, width: int) -> DataFrame:
    """Time on CPUs per bucket and value."""
    return in_buckets(quanta(sched), width).groupBy("bucket_ns", by).agg(F.sum("part_ns").alias("ns"))
