"""Spans: statistics, gaps, concurrency, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions import windows as T
from spanloom.operators import buckets, intervals, stats
from spanloom.plans.registry import query
from spanloom.sources import adapters as A
from spanloom.staging import stage

LO, HI = 1704067200_000_000_000 + 86400_000_000_000, 1704067200_000_000_000 + 4 * 86400_000_000_000
WINDOW, WIN = (LO, HI), f"start_ns < {HI} AND end_ns > {LO}"
CLIP = f"least(end_ns, {HI}) - greatest(start_ns, {LO})"
MEASURES = """CAST(count(*) AS BIGINT) AS n, CAST(sum({c}) AS BIGINT) AS total, CAST(round_even(avg({c}), 0) AS BIGINT) AS mean, min({c}) AS least, max({c}) AS most,
    quantile_disc({c}, 0.5) AS p50, quantile_disc({c}, 0.95) AS p95, quantile_disc({c}, 0.99) AS p99"""
NS = MEASURES.format(c="ns")
BYTES = "CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, coalesce(sum(bytes), 0) / sum(ns) AS gbps, sum(ns) / (SELECT sum(ns) FROM d) AS share"
D = "WITH d AS (SELECT *, end_ns - start_ns AS ns FROM spans WHERE end_ns > start_ns)"


def _stats_sql(by: str) -> str:
    return f"{D} SELECT {by}, {NS}, {BYTES} FROM d GROUP BY {by}"


@query("spans", _stats_sql("kind, name"))
def a1_span_stats(spark, d):
    return stats.span_stats(A.spans(spark, d), ("kind", "name"))


@query("spans", f"WITH d AS (SELECT *, {CLIP} AS ns FROM spans WHERE {WIN} AND {CLIP} > 0) SELECT kind, {NS}, {BYTES} FROM d GROUP BY kind")
def a1_span_stats_window(spark, d):
    return stats.span_stats(A.spans(spark, d), ("kind",), WINDOW)


@query("spans", _stats_sql("process_id, device_id, context_id, stream_id"))
def a3_stats_by_location(spark, d):
    return stats.span_stats(A.spans(spark, d), ("process_id", "device_id", "context_id", "stream_id"))


@query("spans", _stats_sql("process_id, graph_id, graph_node_id"))
def a4_stats_by_graph_node(spark, d):
    return stats.span_stats(A.spans(spark, d), ("process_id", "graph_id", "graph_node_id"))


@query("spans", f"WITH d AS (SELECT *, end_ns - start_ns AS ns FROM spans WHERE end_ns > start_ns AND kind = 'kernel') SELECT process_id, grid_x, block_x, {NS}, {BYTES} FROM d GROUP BY process_id, grid_x, block_x")
def a5_stats_by_launch_shape(spark, d):
    return stats.span_stats(A.spans(spark, d).filter("kind = 'kernel'"), ("process_id", "grid_x", "block_x"))


@query("ranges", f"WITH d AS (SELECT *, end_ns - start_ns AS ns FROM ranges WHERE end_ns > start_ns) SELECT CASE WHEN event_type IN (59, 70) THEN 'push_pop' WHEN event_type IN (60, 71) THEN 'start_end' ELSE 'unknown' END AS style, name, {NS}, sum(ns) / (SELECT sum(ns) FROM d) AS share FROM d GROUP BY ALL")
def a8_stats_by_range_style(spark, d):
    return stats.span_stats(A.ranges(spark, d).withColumn("style", N.range_style("event_type")), ("style", "name"))


@query("launches", f"WITH d AS (SELECT regexp_replace(name, '_v[0-9]+$', '') AS api, end_ns - start_ns AS ns FROM launches) SELECT api, {NS}, sum(ns) / (SELECT sum(ns) FROM d) AS share FROM d GROUP BY api")
def a9_stats_versions_folded(spark, d):
    return stats.span_stats(A.launches(spark, d).withColumn("api", N.fold_version("name")), ("api",))


#: Half decades, as the histogram has to be cut.
_EDGES = (0, 10, 32, 100, 316, 1_000, 3_162, 10_000, 31_623, 100_000, 316_228, 1_000_000, 3_162_278, 10_000_000, 31_622_776, 100_000_000, 316_227_766, 1_000_000_000, None)
#: Spans from a nanosecond to seconds, so that all buckets have some.
_TINY = "d AS (SELECT kind, process_id, end_ns - start_ns AS whole, row_id, greatest(1, (end_ns - start_ns) // CAST(pow(10, 3 + row_id % 10) AS BIGINT)) AS ns FROM spans WHERE end_ns > start_ns)"


@query("spans", f"WITH {_TINY} SELECT kind, concat_ws(',', " + ", ".join(f"count(*) FILTER (ns >= {a}" + (f" AND ns < {b})" if b else ")") for a, b in zip(_EDGES, _EDGES[1:], strict=False)) + ") AS histogram FROM d GROUP BY kind")
def a10_duration_histogram(spark, d):
    s = A.spans(spark, d).filter("end_ns > start_ns")
    ns = F.expr("greatest(1, (end_ns - start_ns) div cast(pow(10, 3 + row_id % 10) as bigint))")
    out = stats.span_stats(s.withColumn("end_ns", F.col("start_ns") + ns), ("kind",), histogram=True)
    return out.select("kind", F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram"))


@query("spans", f"SELECT kind, process_id, {MEASURES.format(c='bytes')} FROM spans WHERE kind IN ('memcpy', 'memset') AND bytes > 0 GROUP BY ALL")
def a12_size_stats(spark, d):
    return stats.size_stats(A.spans(spark, d), ("kind", "process_id"))


def _tables(spark, d):
    return {"spans": A.spans(spark, d), "launches": A.launches(spark, d), "ranges": A.ranges(spark, d), "samples": A.point_samples(spark, d)}


_SUMMARY = """WITH s AS (SELECT 'spans' AS table_name, count(*) AS n, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM spans
    UNION ALL SELECT 'launches', count(*), min(start_ns), max(end_ns) FROM launches UNION ALL SELECT 'ranges', count(*), min(start_ns), max(end_ns) FROM ranges
    UNION ALL SELECT 'samples', count(*), min(ts_ns), max(ts_ns) FROM point_samples)"""


@query("spans launches ranges point_samples", _SUMMARY + " SELECT * FROM s")
def a14_table_summary(spark, d):
    return stats.table_summary(_tables(spark, d))


@query("spans launches ranges point_samples", _SUMMARY + " SELECT min(first_ns) FILTER (table_name = 'spans') AS primary_start, max(last_ns) FILTER (table_name = 'spans') AS primary_end, min(first_ns) AS full_start, max(last_ns) AS full_end FROM s")
def x1_trace_origin(spark, d):
    return stats.trace_origin(stats.table_summary(_tables(spark, d)), ("spans",))


@query("spans", """WITH g AS (SELECT process_id, name, CAST(sum(end_ns - start_ns) AS BIGINT) AS t FROM spans WHERE end_ns > start_ns GROUP BY ALL)
    SELECT name, a.t AS value_a, b.t AS value_b, coalesce(b.t, 0) - coalesce(a.t, 0) AS change FROM (SELECT * FROM g WHERE process_id = 0) a FULL JOIN (SELECT * FROM g WHERE process_id = 1) b USING (name)""")
def x2_compare_captures(spark, d):
    s = A.spans(spark, d)
    of = lambda p: stats.span_stats(s.filter(F.col("process_id") == p), ("name",))
    return stats.compare(of(0), of(1), ["name"], "total")


# -- filters -------------------------------------------------------------------------------

@query("spans", r"SELECT row_id, name FROM spans WHERE name LIKE 'click:%' ESCAPE '\' OR name LIKE 'vie_:3' ESCAPE '\'")
def f1_name_glob(spark, d):
    return A.spans(spark, d).filter(N.name_glob("name", "click:*") | N.name_glob("name", "vie?:3")).select("row_id", "name")


@query("spans", "SELECT row_id, name FROM spans WHERE regexp_matches(name, '(click|error):[0-4]$')")
def f2_name_regex(spark, d):
    return A.spans(spark, d).filter(N.name_regex("name", "(click|error):[0-4]$")).select("row_id", "name")


@query("spans", f"SELECT row_id, {CLIP} AS ns FROM spans WHERE {WIN}")
def f3_f5_overlap_clipped(spark, d):
    return T.overlaps(A.spans(spark, d), *WINDOW).select("row_id", T.clipped(*WINDOW).alias("ns"))


@query("point_samples", f"SELECT row_id, ts_ns FROM point_samples WHERE ts_ns >= {LO} AND ts_ns < {HI}")
def f4_point_window(spark, d):
    return T.within(A.point_samples(spark, d), *WINDOW).select("row_id", "ts_ns")


@query("interval_samples", f"SELECT row_id, greatest(start_ns, {LO}) AS start_ns, least(end_ns, {HI}) AS end_ns FROM interval_samples WHERE start_ns >= 0 AND end_ns > start_ns AND {WIN}")
def f6_positive_intervals(spark, d):
    return T.positive_intervals(A.interval_samples(spark, d), *WINDOW).select("row_id", "start_ns", "end_ns")


@query("spans", "SELECT row_id FROM spans WHERE end_ns - start_ns BETWEEN 600000000000 AND 6000000000000")
def f8_duration_filter(spark, d):
    return A.spans(spark, d).filter(T.duration_filter("range", 600000000000, 6000000000000)).select("row_id")


@query("spans", "SELECT row_id, kind FROM spans WHERE process_id = 1 AND device_id = 2 AND stream_id = 3")
def f9_location(spark, d):
    return A.spans(spark, d).filter(N.at(1, 2, 3)).select("row_id", "kind")


@query("spans", "SELECT row_id FROM spans WHERE kind = 'kernel' AND grid_x = 3")
def f14_launch_shape(spark, d):
    s = A.spans(spark, d).withColumns({"grid_y": F.lit(1), "grid_z": F.lit(1)})
    return s.filter((F.col("kind") == "kernel") & N.match_dims("grid", "3x0x1")).select("row_id")


@query("point_samples", "SELECT row_id FROM point_samples WHERE metric LIKE 'click%' OR metric LIKE '%requests]'")
def f15_counter_globs(spark, d):
    return A.point_samples(spark, d).filter(N.any_glob("metric", "click*, *requests]")).select("row_id")


# -- gaps, islands, concurrency --------------------------------------------------------------

_GAPS = """WITH b AS (SELECT *, max(end_ns) OVER w AS busy, arg_max(row_id, struct_pack(e := end_ns, r := -row_id)) OVER w AS prev FROM spans
    WINDOW w AS (PARTITION BY {by} ORDER BY start_ns, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT {by}, busy AS start_ns, start_ns AS end_ns, start_ns - busy AS gap_ns, prev AS prev_row_id, row_id AS next_row_id FROM b WHERE start_ns > busy)"""


@query("spans", _GAPS.format(by="process_id, device_id, stream_id") + " SELECT * FROM g")
def i1_idle_gaps(spark, d):
    return intervals.idle_gaps(A.spans(spark, d), intervals.LANE)


@query("spans", """WITH n AS (SELECT *, lead(start_ns) OVER w AS nxt, lead(row_id) OVER w AS nid FROM spans WINDOW w AS (PARTITION BY process_id, device_id, stream_id ORDER BY start_ns, row_id))
    SELECT process_id, device_id, stream_id, end_ns AS start_ns, nxt AS end_ns, nxt - end_ns AS gap_ns, row_id AS prev_row_id, nid AS next_row_id FROM n WHERE nxt > end_ns""")
def i2_stream_gaps(spark, d):
    return intervals.stream_gaps(A.spans(spark, d))


_FLAGS = """f AS (SELECT *, CASE WHEN start_ns <= max(end_ns) OVER (PARTITION BY {by} ORDER BY start_ns, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {src}),
  l AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY start_ns, row_id) AS island FROM f),
  i AS (SELECT {by}, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM l GROUP BY {by}, island)"""
#: Spans of a tenth of their length, so that devices do fall idle.
_SHORT = "short AS (SELECT * REPLACE (start_ns + (end_ns - start_ns) // 100 AS end_ns) FROM spans WHERE (end_ns - start_ns) // 100 > 0)"


def _short(spark, d):
    s = A.spans(spark, d).withColumn("end_ns", F.col("start_ns") + F.expr("(end_ns - start_ns) div 100"))
    return s.filter("end_ns > start_ns")


@query("spans", "WITH " + _SHORT + ", " + _FLAGS.format(by="process_id, device_id", src="short") + """,
  x AS (SELECT *, max(end_ns) OVER (ORDER BY start_ns, process_id, device_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM i)
  SELECT busy AS start_ns, start_ns AS end_ns, start_ns - busy AS gap_ns FROM x WHERE start_ns > busy""")
def i3_trace_gaps(spark, d):
    return intervals.trace_gaps(_short(spark, d))


def _captured(spans):
    """The spans as a capture holds them, in a table of their own: a window is told to its scan."""
    return stage(spans.select(*intervals.LANE, "row_id", "start_ns", "end_ns"), "spans")


@query("spans", _GAPS.format(by="process_id, device_id, stream_id") + f" SELECT * FROM g WHERE {WIN}")
def i4_gaps_in_window(spark, d):
    return intervals.idle_gaps(_captured(A.spans(spark, d)), intervals.LANE, window=WINDOW)


#: The gaps query over short spans, which leave devices idle.
_SHORT_GAPS = "WITH " + _SHORT + ", " + _GAPS.format(by="process_id, device_id").removeprefix("WITH ").replace("FROM spans", "FROM short")


@query("spans", _SHORT_GAPS + " SELECT * FROM g")
def i1_device_gaps(spark, d):
    return intervals.idle_gaps(_short(spark, d))


@query("spans", _SHORT_GAPS + """ SELECT 'gap|pid:' || CAST(process_id AS VARCHAR) || '|dev:' || CAST(device_id AS VARCHAR) || '|@' || CAST(start_ns AS VARCHAR) AS key, gap_ns FROM g""")
def i1_gap_keys(spark, d):
    return intervals.idle_gaps(_short(spark, d)).select(N.gap_key("start_ns", "process_id", "device_id").alias("key"), "gap_ns")


@query("spans", _SHORT_GAPS + f" SELECT * FROM g WHERE {WIN}")
def i4_device_gaps_in_window(spark, d):
    return intervals.idle_gaps(_captured(_short(spark, d)), window=WINDOW)


@query("spans", f"""WITH n AS (SELECT *, lead(start_ns) OVER w AS nxt, lead(row_id) OVER w AS nid FROM spans WINDOW w AS (PARTITION BY process_id, device_id, stream_id ORDER BY start_ns, row_id)),
  g AS (SELECT process_id, device_id, stream_id, end_ns AS start_ns, nxt AS end_ns, nxt - end_ns AS gap_ns, row_id AS prev_row_id, nid AS next_row_id FROM n WHERE nxt > end_ns) SELECT * FROM g WHERE {WIN}""")
def i4_stream_gaps_in_window(spark, d):
    return intervals.stream_gaps(_captured(A.spans(spark, d)), window=WINDOW)


@query("spans", "WITH " + _SHORT + ", " + _FLAGS.format(by="process_id, device_id", src="short") + f""",
  x AS (SELECT *, max(end_ns) OVER (ORDER BY start_ns, process_id, device_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM i), g AS (SELECT busy AS start_ns, start_ns AS end_ns, start_ns - busy AS gap_ns FROM x WHERE start_ns > busy) SELECT * FROM g WHERE {WIN}""")
def i4_trace_gaps_in_window(spark, d):
    return intervals.trace_gaps(_captured(_short(spark, d)), window=WINDOW)


@query("spans", f"""SELECT process_id, device_id, stream_id, count(*) AS n, CAST(sum({CLIP}) AS BIGINT) AS busy_ns, least(max(end_ns), {HI}) - greatest(min(start_ns), {LO}) AS span_ns,
    sum({CLIP}) / (least(max(end_ns), {HI}) - greatest(min(start_ns), {LO})) AS busy_ratio FROM spans WHERE {WIN} AND {CLIP} > 0 GROUP BY ALL""")
def i5_lane_activity(spark, d):
    return intervals.lane_activity(A.spans(spark, d), WINDOW)


@query("spans", "WITH " + _SHORT + ", " + _FLAGS.format(by="process_id, device_id", src="short") + " SELECT * FROM i")
def i6_islands(spark, d):
    return intervals.merge_islands(_short(spark, d))


def _conc(by: str) -> str:
    return "WITH " + _SHORT + ", " + _FLAGS.format(by=by, src="short") + f""",
  e AS (SELECT {by}, start_ns AS t, 1 AS x FROM short UNION ALL SELECT {by}, end_ns, -1 FROM short),
  p AS (SELECT {by}, max(c) AS peak FROM (SELECT {by}, sum(x) OVER (PARTITION BY {by} ORDER BY t, x ROWS UNBOUNDED PRECEDING) AS c FROM e) GROUP BY {by}),
  u AS (SELECT {by}, CAST(sum(end_ns - start_ns) AS BIGINT) AS union_ns FROM i GROUP BY {by}),
  s AS (SELECT {by}, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS sum_ns FROM short GROUP BY {by})
  SELECT {by}, n, sum_ns, union_ns, sum_ns - union_ns AS overlap_ns, CAST(peak AS BIGINT) AS peak FROM s JOIN u USING ({by}) JOIN p USING ({by})"""


@query("spans", _conc("process_id, device_id"))
def i7_i8_concurrency(spark, d):
    return intervals.concurrency(_short(spark, d))


@query("spans", _conc("process_id, device_id, stream_id"))
def i9_stream_concurrency(spark, d):
    return intervals.concurrency(_short(spark, d), intervals.LANE)


def _union(kinds: str, name: str) -> str:
    by = "process_id, device_id"
    flags = _FLAGS.format(by=by, src=f"(SELECT * FROM short WHERE kind IN ({kinds}))")
    return f"(WITH {flags} SELECT {by}, CAST(sum(end_ns - start_ns) AS BIGINT) AS {name} FROM i GROUP BY {by})"


@query("spans", "WITH " + _SHORT + f""" SELECT process_id, device_id, compute_ns, copy_ns, all_ns, compute_ns + copy_ns - all_ns AS both_ns
  FROM {_union("'kernel','graph'", 'compute_ns')} JOIN {_union("'memcpy','memset'", 'copy_ns')} USING (process_id, device_id) JOIN {_union("'kernel','graph','memcpy','memset'", 'all_ns')} USING (process_id, device_id)""")
def i10_class_overlap(spark, d):
    return intervals.class_overlap(_short(spark, d))


@query("spans", "WITH " + _SHORT + f""", c AS (SELECT * REPLACE (greatest(start_ns, {LO}) AS start_ns, least(end_ns, {HI}) AS end_ns) FROM short WHERE {WIN}),
  b AS (SELECT *, max(end_ns) OVER (PARTITION BY process_id, device_id ORDER BY start_ns, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM c)
  SELECT process_id, device_id, busy AS start_ns, start_ns AS end_ns, start_ns - busy AS gap_ns FROM b WHERE start_ns > busy""")
def i12_gap_overlay(spark, d):
    return intervals.gap_overlay(_short(spark, d), WINDOW)


# -- time buckets ------------------------------------------------------------------------------

H6 = 21600_000_000_000


@query("spans", f"""WITH b AS (SELECT *, unnest(range(start_ns - start_ns % {H6}, end_ns, {H6})) AS bucket_ns FROM spans WHERE end_ns > start_ns),
  c AS (SELECT *, least(end_ns, bucket_ns + {H6}) - greatest(start_ns, bucket_ns) AS ns FROM b)
  SELECT bucket_ns, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total_ns, """ + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN ns ELSE 0 END) AS BIGINT) AS {k}_ns" for k in ("kernel", "memcpy", "memset", "graph")) + " FROM c GROUP BY bucket_ns")
def t1_activity(spark, d):
    return buckets.activity(A.spans(spark, d), H6)


@query("spans", """WITH k AS (SELECT CAST(device_id AS VARCHAR) AS track, start_ns - start_ns % 86400000000000 AS bin_ns, kind, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS ns, max(end_ns - start_ns) AS longest FROM spans GROUP BY ALL)
  SELECT track, bin_ns, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ns) AS BIGINT) AS total_ns, max(longest) AS longest_ns, arg_max(kind, struct_pack(a := ns, b := kind)) AS top_kind,
    string_agg(kind || '=' || CAST(ns AS VARCHAR), ',' ORDER BY kind) AS by_kind FROM k GROUP BY track, bin_ns""")
def t7_density(spark, d):
    return buckets.density(A.spans(spark, d), 86400_000_000_000, F.col("device_id").cast("string"))


# -- replays -------------------------------------------------------------------------------------

def _replay_spans(spark, d):
    return A.spans(spark, d).withColumn("correlation_id", F.expr("row_id div 20"))


_REPLAY = "r AS (SELECT * REPLACE (row_id // 20 AS correlation_id) FROM spans WHERE end_ns > start_ns)"
_ID = "process_id, device_id, context_id, correlation_id"


@query("spans", f"WITH {_REPLAY}, {_FLAGS.format(by=_ID, src='r')}, u AS (SELECT {_ID}, CAST(sum(end_ns - start_ns) AS BIGINT) AS busy_ns FROM i GROUP BY {_ID})" + f"""
  SELECT {_ID}, min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS sum_ns, count(*) AS events, count(DISTINCT kind) AS kinds, count(DISTINCT stream_id) AS streams,
    max(end_ns) - min(start_ns) AS wall_ns, any_value(busy_ns) AS busy_ns, max(end_ns) - min(start_ns) - any_value(busy_ns) AS idle_ns FROM r JOIN u USING ({_ID}) GROUP BY {_ID}""")
def a15_i11_replays(spark, d):
    return stats.replays(_replay_spans(spark, d))
