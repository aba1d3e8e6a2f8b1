"""Who launched what: processes, launchers, lookups by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions.sums import wide_sum
from spanloom.functions.windows import clipped, overlaps
from spanloom.operators.ordered import with_ordinal

ID = ["process_id", "device_id", "context_id", "correlation_id"]


def resolve_process(spans: DataFrame, contexts: DataFrame, launches: DataFrame) -> DataFrame:
    """Spans whose ``process_id`` may be null, with ``process``: the given one; else that of the
    only process with the (device, context); else that of the host call of the same correlation
    that is nearest in time, unless calls of different processes are equally near."""
    one = contexts.groupBy("device_id", "context_id").agg(F.countDistinct("process_id").alias("n"), F.min("process_id").alias("by_context")).filter("n = 1").drop("n")
    s = spans.join(one, ["device_id", "context_id"], "left")
    open_ = s.filter("process_id is null and by_context is null").select("row_id", "kind", "correlation_id", F.col("start_ns").alias("t"))
    near = open_.join(launches.select("correlation_id", F.col("process_id").alias("p"), "start_ns"), "correlation_id")
    w = W.partitionBy("kind", "row_id").orderBy(F.abs(F.col("t") - F.col("start_ns")))
    near = near.withColumn("r", F.dense_rank().over(w)).filter("r = 1").groupBy("kind", "row_id").agg(F.countDistinct("p").alias("n"), F.min("p").alias("by_call")).filter("n = 1").drop("n")
    return s.join(near, ["kind", "row_id"], "left").withColumn("process", F.coalesce("process_id", "by_context", "by_call")).drop("by_context", "by_call")


def nearest_launcher(replays: DataFrame, launches: DataFrame, contexts: DataFrame, like: str) -> DataFrame:
    """For each replay (an identity and its start_ns) the host call of the same process and
    correlation, of a process that has the replay's device and context, that fits best: named like
    ``like`` first, then at or before the start, then nearest, then by id. Replays without one stay."""
    r = replays.select(*ID, F.col("start_ns").alias("replay_start_ns"))
    known = r.join(contexts.select("process_id", "device_id", "context_id").distinct(), ["process_id", "device_id", "context_id"], "left_semi")
    m = known.join(launches.select("process_id", "correlation_id", "row_id", "name", "start_ns"), ["process_id", "correlation_id"])
    named = F.when(F.coalesce(F.col("name"), F.lit("")).like(like), 0).otherwise(1)
    late = F.when(F.col("start_ns") <= F.col("replay_start_ns"), 0).otherwise(1)
    best = F.min(F.struct(named.alias("a"), late.alias("b"), F.abs(F.col("start_ns") - F.col("replay_start_ns")).alias("c"), "row_id", "name"))
    m = m.groupBy(*ID, "replay_start_ns").agg(best.alias("m")).select(*ID, "replay_start_ns", F.col("m.row_id").alias("launch_id"), F.col("m.name").alias("name"))
    return r.join(m, [*ID, "replay_start_ns"], "left")


def replay_nodes(spans: DataFrame, n: int) -> DataFrame:
    """Per replay the ``n`` nodes with most time: events, streams, sum, longest, share of wall."""
    d = spans.filter("end_ns > start_ns").withColumn("ns", F.col("end_ns") - F.col("start_ns"))
    wall = d.groupBy(*ID).agg((F.max("end_ns") - F.min("start_ns")).alias("wall"))
    g = d.groupBy(*ID, "graph_node_id", "kind", "name").agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"), F.sum("ns").alias("sum_ns"), F.max("ns").alias("max_ns"))
    order = W.partitionBy(*ID).orderBy(F.desc("sum_ns"), F.col("graph_node_id").asc_nulls_last(), "kind", "name")
    g = g.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).join(wall, ID)
    return g.withColumn("share", F.col("sum_ns") / F.col("wall")).drop("wall")


_SIDE = ("kind", "row_id", "start_ns", "end_ns")


def correlate(ids: DataFrame, work: DataFrame, host: DataFrame, contexts: DataFrame) -> DataFrame:
    """For asked (kind, row_id) all rows of one identity (process, device, context, correlation).

    ``work`` (kernels, copies, synchronisations, graphs: kind, row_id, the identity, start_ns, end_ns)
    is held to its own device and context, however often the correlation id is used in others.
    ``host`` (calls: kind, row_id, process_id, correlation_id, start_ns, end_ns) has neither: a call
    belongs to every context of its process, so asking for a call gives what all of them hold, and
    ``key`` tells the first that has work, or else the first of the process. Rows: kind, row_id, found,
    key, to_kind, to_row_id, start_ns, end_ns; one with ``found`` false for an id without correlation,
    of a kind that has none, of a process without contexts, or that isn't there."""
    at, pair = ["process_id", "device_id", "context_id"], ["process_id", "correlation_id"]
    known = contexts.select(*at).distinct()
    w = work.select(*_SIDE, *ID).filter("correlation_id is not null")
    h = host.select(*_SIDE, *pair).filter("correlation_id is not null").join(known.select("process_id").distinct(), "process_id", "left_semi")
    to = lambda d, on: d.select(*on, F.col("kind").alias("to_kind"), F.col("row_id").alias("to_row_id"), "start_ns", "end_ns")
    asked = ids.select("kind", "row_id").distinct()
    of_work = asked.join(w.select("kind", "row_id", *ID), ["kind", "row_id"])
    of_host = asked.join(h.select("kind", "row_id", *pair), ["kind", "row_id"])

    mine = to(w, ID).unionByName(to(h.join(known, "process_id"), ID))
    found = of_work.join(mine, ID).select("kind", "row_id", *ID, "to_kind", "to_row_id", "start_ns", "end_ns")
    place = F.min(F.struct("device_id", "context_id"))
    ran = w.groupBy(*pair).agg(place.alias("ran"))
    first = known.groupBy("process_id").agg(place.alias("first"))
    seeds = of_host.join(ran, pair, "left").join(first, "process_id").withColumn("on", F.coalesce("ran", "first"))
    merged = to(w, pair).unionByName(to(h, pair))
    by_call = seeds.select("kind", "row_id", *pair, F.col("on.device_id").alias("device_id"), F.col("on.context_id").alias("context_id")).join(merged, pair)
    found = found.unionByName(by_call.select(*found.columns))
    found = found.select("kind", "row_id", F.lit(True).alias("found"), N.correlation_key(*ID).alias("key"), "to_kind", "to_row_id", "start_ns", "end_ns")
    return asked.join(found, ["kind", "row_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def correlation_stats(spans: DataFrame, launches: DataFrame, contexts: DataFrame) -> DataFrame:
    """(what, n): contexts, processes, identities with any row, and rows by kind."""
    host = launches.join(contexts, "process_id").select(*ID, F.lit("runtime").alias("kind"))
    rows = spans.select(*ID, "kind").unionByName(host)
    kinds = rows.groupBy(F.concat("kind", F.lit("_rows")).alias("what")).agg(F.count("*").alias("n"))
    one = contexts.agg(F.countDistinct("process_id", "device_id", "context_id").alias("contexts"), F.countDistinct("process_id").alias("processes")).crossJoin(rows.agg(F.countDistinct(*ID).alias("groups")))  # one row each
    return one.select(F.stack(F.lit(3), *[x for c in ("contexts", "processes", "groups") for x in (F.lit(c), F.col(c))]).alias("what", "n")).unionByName(kinds)


def prior_launches(spans: DataFrame) -> DataFrame:
    """Kernels with ``ordinal``, the number of earlier ones of that name, and the number of
    processes that ran the name."""
    k = spans.filter("kind = 'kernel'")
    n = k.groupBy("name").agg(F.countDistinct("process_id").alias("processes"))
    return with_ordinal(k.select("row_id", "name", "start_ns"), ("name",), ("start_ns", "row_id"), "ordinal").drop("start_ns").join(n, "name")


def order_by(sort: str, defaults: dict[str, str], tie: tuple[str, ...]) -> list[Column]:
    """Columns to order by for ``total,-count,name:asc``: ``-`` or ``:desc`` is descending, ``+`` or
    ``:asc`` ascending, else the key's default. Nulls come last. Ties go by ``tie`` in the direction
    of the last key."""
    out, down = [], False
    for field in (f.strip() for f in sort.split(",") if f.strip()):
        key, _, way = field.partition(":")
        if key[0] in "+-":
            key, way = key[1:], "desc" if key[0] == "-" else "asc"
        key, way = key.strip(), (way.strip() or defaults.get(key.strip(), ""))
        if key not in defaults or way not in ("asc", "desc"):
            raise ValueError(f"can't sort by {field!r}; keys are {', '.join(defaults)}")
        down = way == "desc"
        out.append(F.col(key).desc_nulls_last() if down else F.col(key).asc_nulls_last())
    return out + [F.col(t).desc_nulls_last() if down else F.col(t).asc_nulls_last() for t in tie]


def listing(rows: DataFrame, sort: str, defaults: dict[str, str], tie: tuple[str, ...], limit: int, totals: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` rows in that order, each with ``matched``, the number of rows before the
    limit, and ``all_<column>``, the sums over them (decimals for whole numbers); place counts from 1."""
    whole_number = {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    whole = rows.agg(F.count("*").alias("matched"), *[(wide_sum(c) if c in whole_number else F.sum(c)).alias(f"all_{c}") for c in totals])
    order = order_by(sort, defaults, tie)
    top = rows.orderBy(*order).limit(limit)
    top = top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # ``limit`` rows
    return top.crossJoin(whole)  # one row


def search(spans: DataFrame, test, sort: str, k: int, details: list[str], ranges: DataFrame | None = None, markers: tuple[str, ...] = ()) -> DataFrame:
    """The first ``k`` of the matching rows (``sort`` as in ``order_by``, over ns, start_ns, end_ns,
    name, bytes); wide columns are fetched for them alone. Rows without duration are left out unless
    their kind is one of ``markers``. With ``ranges`` (row_id, range_name, ...: what
    ``innermost_range`` found) also the range around each."""
    keys = {"ns": "desc", "start_ns": "asc", "end_ns": "asc", "name": "asc", **({"bytes": "desc"} if "bytes" in spans.columns else {})}
    thin = spans.filter(test & ((F.col("end_ns") > F.col("start_ns")) | F.col("kind").isin(*markers))).withColumn("ns", F.col("end_ns") - F.col("start_ns"))
    top = listing(thin.select("kind", "row_id", *keys), sort, keys, ("row_id",), k).select("kind", "row_id", "ns", "matched", "place")
    out = top.join(spans.select("kind", "row_id", *details), ["kind", "row_id"])
    return out if ranges is None else out.join(ranges, ["kind", "row_id"], "left")


def inspect(ids: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Wide rows of asked ids; ids that aren't there give ``found`` false."""
    return ids.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def inspect_syncs(ids: DataFrame, syncs: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Asked synchronisations with their label, and the range around the call if ``ranges`` (row_id,
    range_name) is given. Device-wide ones have stream 0."""
    wide = syncs.withColumns({"stream_id": F.coalesce("stream_id", F.lit(0)), "sync_type_name": N.label("sync_type", N.SYNC_TYPES), "ns": F.col("end_ns") - F.col("start_ns")})
    return inspect(ids, wide if ranges is None else wide.join(ranges, "row_id", "left"), ["row_id"])


def inspect_cuda_events(ids: DataFrame, events: DataFrame, syncs: DataFrame) -> DataFrame:
    """Asked recorded events with the synchronisations that waited for them (by event_sync_id)."""
    waited = syncs.filter("event_sync_id is not null").groupBy("event_sync_id").agg(F.array_sort(F.collect_list("row_id")).alias("sync_ids"))
    return inspect(ids, events.join(waited, "event_sync_id", "left"), ["row_id"])


def inspect_graphs(ids: DataFrame, graphs: DataFrame) -> DataFrame:
    """Asked graph launches with their duration."""
    return inspect(ids, graphs.withColumn("ns", F.col("end_ns") - F.col("start_ns")), ["row_id"])


def inspect_graph_nodes(ids: DataFrame, nodes: DataFrame, kernels: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Asked node creations with the graph that owns the node, as a kernel of the node says (of
    several the smallest id), and the executable made from that graph, as a creation event says.
    Captures without these columns or tables leave them null. A marker without end lasts 0."""
    d = nodes.withColumn("ns", F.coalesce(F.col("end_ns") - F.col("start_ns"), F.lit(0)))
    none = F.lit(None).cast("long")
    if kernels is None or not {"graph_id", "graph_node_id"} <= set(kernels.columns):
        d = d.withColumns({"graph_id": none, "graph_exec_id": none})
    else:
        d = d.join(kernels.groupBy("graph_node_id").agg(F.min("graph_id").alias("graph_id")), "graph_node_id", "left")
        if events is None:
            d = d.withColumn("graph_exec_id", none)
        else:
            d = d.join(events.filter("event_class = 94").groupBy("graph_id").agg(F.min("graph_exec_id").alias("graph_exec_id")), "graph_id", "left")
    return inspect(ids, d, ["row_id"])


def inspect_graph_events(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Asked creations of graphs and executables with their label."""
    return inspect(ids, events.withColumns({"event_class_name": N.label("event_class", N.GRAPH_EVENTS), "ns": F.col("end_ns") - F.col("start_ns")}), ["row_id"])


def inspect_overheads(ids: DataFrame, overheads: DataFrame) -> DataFrame:
    """Asked rows of the profiler's own work with their label."""
    return inspect(ids, overheads.withColumns({"overhead_type_name": N.label("overhead_type", N.OVERHEADS), "ns": F.col("end_ns") - F.col("start_ns")}), ["row_id"])


def inspect_cpu_samples(ids: DataFrame, samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Asked CPU samples with their call chain, innermost frame first: symbol, module's base name and,
    where frames have an ``ip``, its address in hexadecimal."""
    at = F.concat(F.lit("0x"), F.lower(F.hex("ip"))) if "ip" in frames.columns else F.lit(None).cast("string")
    one = F.struct("stack_depth", "symbol", N.basename("module").alias("module"), at.alias("address"))
    chain = frames.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("chain"))
    return inspect(ids, samples.join(chain, "id", "left"), ["id"])


def _in_window(spans: DataFrame, window: tuple[int, int]) -> DataFrame:
    return overlaps(spans.filter("kind = 'kernel'"), *window).withColumn("ns", clipped(*window)).filter("ns > 0")


_SCORES = ("total", "count", "max")


def highlights(spans: DataFrame, by: str, n: int, window: tuple[int, int], score: str = "total") -> DataFrame:
    """Top names in a window by their clipped time (``total``), number (``count``) or longest (``max``):
    ``by``, total, n, longest, score, share (of the score of all names; null for ``max``, which
    doesn't add up) and place. Ties go by name."""
    if score not in _SCORES:
        raise ValueError(f"score is one of {', '.join(_SCORES)}, not {score!r}")
    g = _in_window(spans, window).groupBy(by).agg(F.sum("ns").alias("total"), F.count("*").alias("n"), F.max("ns").alias("longest"))
    g = g.withColumn("score", F.col({"total": "total", "count": "n", "max": "longest"}[score]))
    top = g.orderBy(F.desc("score"), by).limit(n)
    top = top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), by)))  # ``n`` rows
    share = F.lit(None).cast("double") if score == "max" else F.col("score") / F.col("all")
    return top.crossJoin(g.agg(F.sum("score").alias("all"))).withColumn("share", share).drop("all")  # one row


def highlighted_instances(spans: DataFrame, n: int, window: tuple[int, int], details: list[str], score: str = "total") -> DataFrame:
    """Top single kernels in a window: row_id, ns, score (its clipped time, or 1 for ``count``), share,
    place and ``details``. Ties go by time, start, and id as text. Only what ranks is sorted; the
    other columns are fetched for the ``n`` survivors."""
    if score not in _SCORES:
        raise ValueError(f"score is one of {', '.join(_SCORES)}, not {score!r}")
    thin = _in_window(spans, window).select("row_id", "ns", "start_ns").withColumn("score", F.lit(1).cast("long") if score == "count" else F.col("ns"))
    order = [F.desc("score"), F.desc("ns"), F.asc("start_ns"), F.asc(F.col("row_id").cast("string"))]
    top = thin.orderBy(*order).limit(n)
    top = top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # ``n`` rows
    share = F.lit(None).cast("double") if score == "max" else F.col("score") / F.col("all")
    top = top.crossJoin(thin.agg(F.sum("score").alias("all"))).select("row_id", "ns", "score", share.alias("share"), "place")  # one row
    return top.join(spans.filter("kind = 'kernel'").select("row_id", *details), "row_id")


def inspect_host_calls(ids: DataFrame, calls: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Asked calls of the runtime or the operating system with process and thread, duration, and the
    ranges around them where ``ranges`` (row_id, chain: what ``enclosing_ranges`` found) is given."""
    wide = calls.withColumns({"pid": N.pid_of("global_tid"), "tid": N.tid_of("global_tid"), "ns": F.col("end_ns") - F.col("start_ns")})
    if ranges is not None:
        wide = wide.join(ranges.select("row_id", F.concat_ws("/", F.transform("chain", lambda x: N.path_part(x["name"]))).alias("range_path")), "row_id", "left")
    return inspect(ids, wide, ["row_id"])


def tracks(spans: DataFrame, streams: int, launches: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Rows of a timeline figure (track_key, start_ns, end_ns, class, label): one track per device,
    its busiest streams, host calls per process, and ranges per depth on the device that their work
    ran on. ``ranges``: range_id, name, start_ns, end_ns, depth, process_id, device_id (null: none)."""
    d = spans.filter("end_ns > start_ns").withColumn("ns", F.col("end_ns") - F.col("start_ns"))
    lanes = d.groupBy("process_id", "device_id", "stream_id").agg(F.sum("ns").alias("busy"))
    order = W.partitionBy("process_id", "device_id").orderBy(F.desc("busy"), "stream_id")
    lanes = lanes.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= streams).select("process_id", "device_id", "stream_id")
    key = lambda kind, *cols: F.concat_ws("/", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in cols]).alias("track_key")
    rest = ("start_ns", "end_ns")
    out = d.select(key("gpu", "process_id", "device_id"), *rest, F.col("kind").alias("class"), F.col("name").alias("label"))
    out = out.unionByName(d.join(lanes, ["process_id", "device_id", "stream_id"]).select(key("gpu", "process_id", "device_id", "stream_id"), *rest, F.col("kind").alias("class"), F.col("name").alias("label")))
    if launches is not None:
        out = out.unionByName(launches.select(key("api", "process_id"), *rest, F.lit("runtime").alias("class"), F.col("name").alias("label")))
    if ranges is not None:
        out = out.unionByName(ranges.select(key("range", "process_id", "device_id", "depth"), "start_ns", F.coalesce("end_ns", "start_ns").alias("end_ns"), F.lit("range").alias("class"), F.col("name").alias("label")))
    return out


def ranges_on_devices(tree: DataFrame, slices: DataFrame) -> DataFrame:
    """Ranges of the tree once for each device that their work ran on; those without work once, with
    null device, under the process of their thread. Depths count from 1."""
    ran = slices.filter("device_id is not null").select("range_id", F.col("process_id").alias("__p"), "device_id").distinct()
    d = tree.join(ran, "range_id", "left").withColumn("process_id", F.coalesce("__p", F.shiftright("global_tid", 24).bitwiseAND(F.lit(0xFFFFFF))))
    return d.select("range_id", "name", "start_ns", "end_ns", (F.col("depth") + 1).alias("depth"), "process_id", "device_id")
