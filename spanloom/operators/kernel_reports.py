"""Kernel reports: metric projections, source rollups, stalls, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import any_glob, is_additive, name_glob
from spanloom.staging import stage


def kernel_metrics(metrics: DataFrame, counters: str) -> DataFrame:
    """Long form: launch, counter, value, unit of the counters that match."""
    return metrics.filter(any_glob("counter", counters))


def kernel_metrics_wide(metrics: DataFrame, counters: str) -> DataFrame:
    """One row per launch with a map from counter to value."""
    m = kernel_metrics(metrics, counters).groupBy("launch").agg(F.array_sort(F.collect_list(F.struct("counter", "value"))).alias("m"))
    return m.select("launch", F.map_from_entries("m").alias("values"))


_PLACE = {"line": ["file", "line"], "file": ["file"], "sass": ["pc"]}
_CLASS = ("metric_type", "metric_subtype", "rollup")


def _with_additive(df: DataFrame) -> DataFrame:
    """``df`` with ``additive``. Counters are told by their names once each, in a table of the distinct
    ones, not row by row."""
    told = ["counter", *[c for c in _CLASS if c in df.columns]] if "metric_type" in df.columns else ["counter"]
    kinds = df.select(*told).distinct()
    kinds = kinds.withColumn("additive", is_additive("counter", *[c if c in told else None for c in _CLASS]) if len(told) > 1 else is_additive("counter"))
    kinds = stage(kinds.withColumnsRenamed({c: f"__{c}" for c in told}), "counters")  # written, so that the rules aren't pushed into the scan of instances
    same = F.lit(True)
    for c in told:
        same = same & df[c].eqNullSafe(F.col(f"__{c}"))
    return df.join(kinds, same).drop(*[f"__{c}" for c in told])


def _in_listing(df: DataFrame) -> Column:
    return F.coalesce(F.col("placement") != "out_of_cubin", F.lit(True)) if "placement" in df.columns else F.lit(True)


def source_metrics(instances: DataFrame, sass: DataFrame, by: str = "line", counters: str = "", on: tuple[str, ...] = ("pc",), file_glob: str | None = None, line: int | None = None) -> DataFrame:
    """Per launch (the columns of ``on`` but the address), place and counter: the sum and the
    number of addresses that carry it. By line and file only counters that may be summed count
    and only addresses with a source; by address (``sass``) all do, and where instances have a
    ``place`` the first of an address stands as it is, as an address is an identity and no sum. Instances without a value say
    nothing: a place that a counter has no value for has no row, which isn't a sum of 0. The
    filters on file and line come after the sums. Instances outside the listing or without a
    source are told by ``reconcile``."""
    i = instances.filter(any_glob("counter", counters) & _in_listing(instances) & F.col("value").isNotNull())
    i = i if by == "sass" else _with_additive(i).filter("additive")
    d = i.join(sass.select(*on, "file", "line").distinct(), list(on), "left" if by == "sass" else "inner")
    d = d if by == "sass" else d.filter("file is not null")
    keys = [*[c for c in on if c != "pc"], *_PLACE[by]]
    value = F.min_by("value", "place") if by == "sass" and "place" in d.columns else F.sum("value")
    g = d.groupBy(*keys, "counter").agg(value.alias("value"), F.countDistinct(*on).alias("pcs"))
    g = g if file_glob is None else g.filter(name_glob("file", file_glob))
    return g if line is None else g.filter(F.col("line") == line)


def source_metrics_wide(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per place with maps from counter to value and to addresses; what has no value there
    isn't in the maps."""
    m = metrics.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("counter", "value"))).alias("v"), F.array_sort(F.collect_list(F.struct("counter", "pcs"))).alias("c"))
    return m.select(*keys, F.map_from_entries("v").alias("values"), F.map_from_entries("c").alias("coverage"))


def skipped_counters(metrics: DataFrame, instances: DataFrame, by: str = "line", counters: str = "", on: tuple[str, ...] = ("launch",)) -> DataFrame:
    """Per launch the counters that ``source_metrics`` leaves out and why: no instance lies in the
    listing, or (by line and file) they may not be summed."""
    m = metrics.filter(any_glob("counter", counters))
    m = _with_additive(m).select(*on, "counter", "additive").distinct()
    here = instances.filter(_in_listing(instances)).select(*on, "counter", F.lit(True).alias("here")).distinct()
    d = m.join(here, [*on, "counter"], "left")
    why = F.when(F.col("here").isNull(), "not-a-source-counter").when(~F.col("additive") & F.lit(by != "sass"), "non-additive-rollup")
    return d.select(*on, "counter", why.alias("reason")).filter("reason is not null")


def reconcile(instances: DataFrame, sass: DataFrame, on: tuple[str, ...] = ("pc",)) -> DataFrame:
    """Per counter: total, and the parts with a source, without one, and outside the listing."""
    d = instances.join(sass.select(*on, "file", F.lit(True).alias("listed")).distinct(), list(on), "left")
    part = lambda c: F.sum(F.when(c, F.col("value")).otherwise(0.0))
    listed = F.coalesce("listed", F.lit(False))
    return d.groupBy("counter").agg(F.sum("value").alias("total"), part(listed & F.col("file").isNotNull()).alias("attributed"), part(listed & F.col("file").isNull()).alias("unattributed"), part(~listed).alias("outside"))


def warp_stalls(stalls: DataFrame, by: str = "line") -> DataFrame:
    """Samples by line, address or reason."""
    keys = {"line": ["file", "line", "reason"], "sass": ["pc", "reason"], "reason": ["reason"]}[by]
    return stalls.groupBy(*keys).agg(F.sum("samples").alias("samples"))


def stall_identity(launches: DataFrame, stalls: DataFrame, on: tuple[str, ...] = ("report", "launch")) -> DataFrame:
    """Per launch with stall samples: the total the report tells, what its rows in and outside the
    listing add up to, and whether these agree."""
    rows = stalls.groupBy(*on).agg(F.sum("samples").alias("listed"))
    d = launches.filter("total_samples is not null").join(rows, list(on), "left").fillna(0, ["listed", "out_of_cubin_samples"])
    return d.select(*on, "total_samples", "listed", "out_of_cubin_samples", (F.col("total_samples") == F.col("listed") + F.col("out_of_cubin_samples")).alias("agrees"))


def report_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: launches, ranges, graphs, metrics, rules, launches with a listing."""
    out = tables["launches"].agg(F.count("*").alias("launches"), F.coalesce(F.sum("n_metrics"), F.lit(0)).alias("metrics"), F.coalesce(F.sum("n_rules"), F.lit(0)).alias("rules"), F.count(F.when(F.col("has_listing"), 1)).alias("listed_launches"))
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s")
    return out.crossJoin(tables["workloads"].agg(kind("range"), kind("graph")))  # one row each


def launches_listing(launches: DataFrame, test: Column | None = None) -> DataFrame:
    """Launches that pass a test: names, shapes, stream, numbers of metrics and rules."""
    d = launches if test is None else launches.filter(test)
    return d.select("report", "launch", "name", "mangled", *[f"{c}_{a}" for c in ("grid", "block") for a in "xyz"], "stream_id", "n_metrics", "n_rules")


def cubins(launches: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per launch the code it ran from: the architecture its capability metrics tell (null unless
    both are there) and whether it has a listing."""
    part = lambda which: F.max(F.when(F.col("counter") == f"device__attribute_compute_capability_{which}", F.col("value").cast("long")))
    sm = metrics.groupBy("report", "launch").agg(part("major").alias("major"), part("minor").alias("minor"))
    name = F.concat(F.lit("sm_"), F.col("major").cast("string"), F.col("minor").cast("string"))
    return launches.select("report", "launch", "has_listing").join(sm, ["report", "launch"], "left").select("report", "launch", name.alias("sm"), "has_listing")


def inspect_launches(ids: DataFrame, launches: DataFrame, metrics: DataFrame) -> DataFrame:
    """Asked (report, launch) with all metrics by name and all rules in their order; ids that
    aren't there give ``found`` false."""
    m = metrics.groupBy("report", "launch").agg(F.array_sort(F.collect_list(F.struct("counter", "value", "unit"))).alias("metrics"))
    wide = launches.join(m, ["report", "launch"], "left").withColumn("found", F.lit(True))
    out = ids.join(wide, ["report", "launch"], "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def launch_sass(sass: DataFrame) -> DataFrame:
    """Per launch its instructions in order of address with their source."""
    one = F.struct("pc", "opcode", "operands", "file", "line")
    return sass.groupBy("report", "launch").agg(F.count("*").alias("instructions"), F.array_sort(F.collect_list(one)).alias("listing"))


def sass_listing(sass: DataFrame) -> DataFrame:
    """Addresses of every source line, in order."""
    return sass.filter("file is not null").groupBy("file", "line").agg(F.array_sort(F.collect_set("pc")).alias("pcs"))
