"""Nested ranges: trees, containment, attribution of calls and device work to ranges.

Containment is an equi-join: both sides are cut into time bins, long ranges are held in coarser
levels of bins (a range lies in at most two bins of its own level), and a call asks one bin of
every level that some range has. So neither long ranges nor fine bins multiply rows, and each pair meets
exactly once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import path_part
from spanloom.functions.sums import wide_sum
from spanloom.operators.ordered import with_ordinal
from spanloom.staging import stage

#: Finest bin and the factor between levels: 1 ms, then 16 times as wide, 12 levels.
BIN_NS, FACTOR, LEVELS = 1_000_000, 16, 12


def _width(level):
    return F.lit(float(BIN_NS)) * F.pow(F.lit(float(FACTOR)), level)


def contains_join(outer: DataFrame, inner: DataFrame, on: list[str]) -> DataFrame:
    """Pairs with outer.start <= inner.start and inner.end <= outer.end, equal in ``on``.
    ``outer`` has o_start, o_end; ``inner`` i_start, i_end."""
    span = F.greatest(F.col("o_end") - F.col("o_start"), F.lit(1)).cast("double")
    level = F.least(F.greatest(F.ceil(F.log(span / BIN_NS) / F.log(F.lit(float(FACTOR)))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    o = outer.withColumn("lv", level)
    bins = F.sequence(F.floor(F.col("o_start") / _width(F.col("lv"))), F.floor(F.col("o_end") / _width(F.col("lv"))))
    used = o.agg(F.collect_set("lv").alias("lvs"))  # one row
    o = o.withColumn("bin", F.explode(bins))
    i = inner.crossJoin(used).withColumn("lv", F.explode("lvs")).drop("lvs")
    i = i.withColumn("bin", F.floor(F.col("i_start") / _width(F.col("lv"))))
    met = i.join(o, [*on, "lv", "bin"]).filter((F.col("o_start") <= F.col("i_start")) & (F.col("i_end") <= F.col("o_end")))
    return met.drop("lv", "bin")


def nesting(ranges: DataFrame, by: tuple[str, ...] = ("global_tid", "domain_id")) -> DataFrame:
    """Ranges with depth, parent_id and path. A range lies under all that are open when it
    starts: that began before it (by start, then id) and end after; so touching ranges are
    siblings, and ranges that overlap nest too. The parent is the open one that closes first, of
    those that close together the earliest opened. An instant (null end) has a place but no
    children. A range without domain counts to domain 0.

    The path is the parent's and the own name; a parent that lies deeper than its child, because
    others have closed in between, isn't told, so the path begins anew. Paths double in a round."""
    r = ranges.withColumns({"domain_id": F.coalesce("domain_id", F.lit(0))}) if "domain_id" in by else ranges
    o = r.filter("end_ns > start_ns").select(*by, F.col("range_id").alias("o_id"), F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"))
    at = r.select(*by, "range_id", F.col("start_ns").alias("i_start"), F.col("start_ns").alias("i_end"))
    before = (F.col("o_start") < F.col("i_start")) | (F.col("o_id") < F.col("range_id"))
    open_ = contains_join(o, at, list(by)).filter((F.col("i_start") < F.col("o_end")) & before)
    up = open_.groupBy("range_id").agg(F.count("*").alias("depth"), F.min(F.struct("o_end", "o_start", "o_id"))["o_id"].alias("parent_id"))
    tree = stage(r.join(up, "range_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0))), "range_tree")
    above = tree.select(F.col("range_id").alias("parent_id"), F.col("depth").alias("d"))
    walk = tree.select("range_id", "parent_id", "depth", F.array(path_part(F.coalesce("name", F.lit("")))).alias("parts")).join(above, "parent_id", "left")
    walk = stage(walk.select("range_id", "parts", F.when(F.col("d") <= F.col("depth"), F.col("parent_id")).alias("next")), "range_paths")
    while not walk.filter("next is not null").isEmpty():
        more = walk.select(F.col("range_id").alias("next"), F.col("parts").alias("more"), F.col("next").alias("then"))
        walk = stage(walk.join(more, "next", "left").select("range_id", F.concat(F.coalesce("more", F.array().cast("array<string>")), "parts").alias("parts"), F.col("then").alias("next")), "range_paths")
    return tree.join(walk.select("range_id", F.array_join("parts", "/").alias("path")), "range_id")


#: Types of events that are ranges (fixed values): pushed and popped, started and ended.
RANGE_TYPES = (59, 60, 70, 71)


def range_tree(events: DataFrame) -> DataFrame:
    """``nesting`` of those events that are ranges; marks and created domains are left out."""
    return nesting(events.filter(F.col("event_type").isin(*RANGE_TYPES)))


def iter_index(ranges: DataFrame, by: tuple[str, ...] = ("global_tid", "domain_id", "name")) -> DataFrame:
    """Ordinal from 0 among ranges of one name."""
    return with_ordinal(ranges, by, ("start_ns", "range_id"), "iter_index")


def enclosing_ranges(ranges: DataFrame, launches: DataFrame, on: tuple[str, ...] = ("global_tid",), instants: bool = False) -> DataFrame:
    """Per host call with at least one: its ranges of all domains from outer to inner, array of
    (s, e, id, name, domain_id). With ``instants`` ranges without end are of length zero."""
    ranges = ranges.withColumn("end_ns", F.coalesce("end_ns", "start_ns")) if instants else ranges.filter("end_ns > start_ns")
    o = ranges.select(*on, F.col("range_id").alias("id"), "name", F.coalesce("domain_id", F.lit(0)).alias("domain_id"), F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"))
    i = launches.select(*on, "row_id", "process_id", "correlation_id", F.col("start_ns").alias("i_start"), F.col("end_ns").alias("i_end"))
    met = contains_join(o, i, list(on))
    chain = F.array_sort(F.collect_list(F.struct(F.col("o_start").alias("s"), (-F.col("o_end")).alias("e"), "id", "name", "domain_id")))
    return met.groupBy("row_id", "process_id", "correlation_id").agg(chain.alias("chain"))


def correlate_spans(spans: DataFrame, launches: DataFrame, contexts: DataFrame) -> DataFrame:
    """Spans with launch_id, launch_start, launch_end: joined by process, device, context and
    correlation; host calls get device and context from the contexts of their process."""
    host = launches.join(contexts, "process_id").select("process_id", "device_id", "context_id", "correlation_id", F.col("row_id").alias("launch_id"), F.col("start_ns").alias("launch_start"), F.col("end_ns").alias("launch_end"))
    return spans.join(host, ["process_id", "device_id", "context_id", "correlation_id"])


#: What device work and the host's side of it share.
IDENTITY = ["process_id", "device_id", "context_id", "correlation_id"]


def host_side(chains: DataFrame, contexts: DataFrame) -> DataFrame:
    """Chains of ranges with the devices and contexts of their process: what device work is joined to."""
    return chains.join(contexts.select("process_id", "device_id", "context_id").distinct(), "process_id")


class Stored(NamedTuple):
    """Tables stored for attribution: device work by identity, work without a correlation, the host's side."""

    spans: DataFrame
    rest: DataFrame
    hosts: DataFrame


def store_attribution(spans: DataFrame, chains: DataFrame, contexts: DataFrame, path: str, name: str, buckets: int | None = None) -> Stored:
    """Writes both sides of attribution once, in the same buckets of their whole identity, so that
    every later join of the two starts at its scans: nothing is shuffled again. Tables are registered
    as ``name``_spans and ``name``_hosts with files under ``path``; a bucket is one file, sorted by start.
    Work without a correlation, which is launched by nothing and would fill one bucket, lies apart.
    ``buckets`` (shuffle partitions, if None) should make files of some hundred MB."""
    spark = spans.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep(df: DataFrame, what: str, order: list[str]) -> DataFrame:
        w = df.repartition(n, *IDENTITY).write.format("parquet").mode("overwrite").option("path", f"{path}/{what}")
        w.bucketBy(n, *IDENTITY).sortBy(*order).saveAsTable(f"{name}_{what}")
        return spark.table(f"{name}_{what}")

    known = F.col("correlation_id").isNotNull()
    spans.filter(~known).write.mode("overwrite").parquet(f"{path}/rest")
    rest = spark.read.schema(spans.schema).parquet(f"{path}/rest")
    return Stored(keep(spans.filter(known), "spans", ["start_ns"]), rest, keep(host_side(chains, contexts).filter(known), "hosts", ["row_id"]))


def innermost_stored(stored: Stored) -> DataFrame:
    """``innermost_range`` of stored tables."""
    got = innermost_range(stored.spans, stored.hosts)
    none = stored.rest.withColumns({"range_depth": F.lit(None).cast("long"), "range_path": F.lit(None).cast("string"), "range_id": F.lit(None).cast("long"), "range_name": F.lit("__no_nvtx__"), "range_domain": F.lit(None).cast(got.schema["range_domain"].dataType)})
    return got.unionByName(none)


def innermost_range(spans: DataFrame, chains: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Spans with range_id, range_name, range_domain, range_depth and range_path of the innermost
    range around their launch; null where there is none. Without ``contexts`` the chains are a
    ``host_side``, as stored."""
    host = (chains if contexts is None else chains.join(contexts, "process_id")).select("process_id", "device_id", "context_id", "correlation_id", F.element_at("chain", -1).alias("r"), (F.size("chain") - 1).cast("long").alias("range_depth"), F.concat_ws("/", F.transform("chain", lambda x: path_part(x["name"]))).alias("range_path"))
    out = spans.join(host, ["process_id", "device_id", "context_id", "correlation_id"], "left")
    return out.withColumns({"range_id": F.col("r.id"), "range_name": F.coalesce("r.name", F.lit("__no_nvtx__")), "range_domain": F.col("r.domain_id")}).drop("r")


def with_iter_index(attributed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Attributed spans with the ordinal of their innermost range among those of its name."""
    return attributed.join(iter_index(ranges).select("range_id", "iter_index"), "range_id", "left")


def with_range_path(attributed: DataFrame, tree: DataFrame, missing: str = "__no_nvtx__") -> DataFrame:
    """Attributed spans with the path of their innermost range in the tree, and its domain: paths
    of one name in different domains, or in one domain of different processes, stay apart."""
    t = tree.select("range_id", F.col("path").alias("__path"), "domain_id", F.shiftright("global_tid", 24).bitwiseAND(F.lit(0xFFFFFF)).alias("domain_pid"))
    return attributed.join(t, "range_id", "left").withColumn("path", F.coalesce("__path", F.lit(missing))).drop("__path")


def under_range(spans: DataFrame, chains: DataFrame, contexts: DataFrame | None, test) -> DataFrame:
    """Spans launched inside any range whose name passes ``test`` (a function of a column). Without
    ``contexts`` the chains are a ``host_side``, as stored."""
    hit = chains.filter(F.exists("chain", lambda x: test(x["name"])))
    hit = hit.select(*IDENTITY) if contexts is None else hit.join(contexts, "process_id").select(*IDENTITY).distinct()
    return spans.join(hit, ["process_id", "device_id", "context_id", "correlation_id"], "left_semi")


def launched_under(spans: DataFrame, ranges: DataFrame, launches: DataFrame, contexts: DataFrame, test, like: str = "cudaGraphLaunch%") -> DataFrame:
    """Graph work whose launch (a call named ``like``) lies in ranges of which one's name, or all their
    names from outer to inner joined by ``/`` as they are, pass ``test``. Ranges without end count as
    of length zero."""
    calls = launches.filter(F.coalesce("name", F.lit("")).like(like) & F.col("correlation_id").isNotNull())
    chains = enclosing_ranges(ranges.withColumn("name", F.coalesce("name", F.lit("<unnamed>"))), calls, instants=True)
    path = F.concat_ws("/", F.transform("chain", lambda x: x["name"]))
    hit = chains.filter(F.exists("chain", lambda x: test(x["name"])) | test(path))
    hit = hit.join(contexts, "process_id").select("process_id", "device_id", "context_id", "correlation_id").distinct()
    return spans.join(hit, ["process_id", "device_id", "context_id", "correlation_id"], "left_semi")


def range_slices(ranges: DataFrame, spans: DataFrame, chains: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Per range and (process, device, stream) that worked for it: bounds on the device and
    time and count by kind; ranges without work stay, with nulls. Without ``contexts`` the chains
    are a ``host_side``, as stored."""
    by = ["process_id", "correlation_id"] if contexts is not None else IDENTITY
    own = chains.select(*by, F.explode("chain").alias("r")).select(*by, F.col("r.id").alias("range_id"))
    host = own if contexts is None else own.join(contexts, "process_id")
    work = spans.join(host, ["process_id", "device_id", "context_id", "correlation_id"])
    ns = F.col("end_ns") - F.col("start_ns")
    of = [F.sum(F.when(F.col("kind") == k, ns).otherwise(0)).alias(f"{k}_ns") for k in ("kernel", "memcpy", "memset")] + [F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_n") for k in ("kernel", "memcpy", "memset")]
    g = work.groupBy("range_id", "process_id", "device_id", "stream_id").agg(F.min("start_ns").alias("gpu_start"), F.max("end_ns").alias("gpu_end"), *of)
    return ranges.select("range_id", "name", "start_ns", "end_ns").join(g, "range_id", "left")


def slice_stats(slices: DataFrame, by: str = "name") -> DataFrame:
    """Per name: instances, total device time of all kinds (a decimal), interpolated p50 and p99."""
    ns = F.coalesce(F.sum(F.col("kernel_ns") + F.col("memcpy_ns") + F.col("memset_ns")), F.lit(0))
    each = slices.groupBy(by, "range_id").agg(ns.alias("ns"))
    return each.groupBy(by).agg(F.count("*").alias("instances"), wide_sum("ns").alias("total"), F.percentile("ns", 0.5).alias("p50"), F.percentile("ns", 0.99).alias("p99"))


def top_paths(tree: DataFrame, k: int) -> DataFrame:
    """Paths with most time, then instances, then by name."""
    g = tree.filter("end_ns is not null").groupBy("path").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("total"), F.count("*").alias("instances"))
    return g.orderBy(F.desc("total"), F.desc("instances"), "path").limit(k)


def domain_names(ranges: DataFrame, create_type: int = 75) -> DataFrame:
    """Names of domains from the events that create them, by process and domain."""
    return ranges.filter(F.col("event_type") == create_type).select(F.shiftright("global_tid", 24).alias("pid"), "domain_id", "name").distinct()
