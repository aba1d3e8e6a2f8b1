"""Ranges, calls and device work: nesting, attribution, correlation, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions.sums import fitted
from spanloom.operators import correlate as C
from spanloom.operators import nesting as R
from spanloom.operators import stats
from spanloom.plans.registry import query
from spanloom.plans.timeline import CLIP, NS, WIN, WINDOW, _replay_spans
from spanloom.sources import adapters as A
from spanloom.staging import scratch

#: A range lies under those open when it starts; the path follows the parents.
_TREE = """rt AS (SELECT * FROM ranges WHERE event_type IN (59, 60, 70, 71)),
  up AS (SELECT r.range_id AS id, count(*) AS depth, arg_min(o.range_id, struct_pack(a := o.end_ns, b := o.start_ns, c := o.range_id)) AS parent_id FROM rt r JOIN rt o
    ON r.global_tid = o.global_tid AND r.domain_id = o.domain_id AND o.end_ns > o.start_ns AND r.start_ns < o.end_ns AND (o.start_ns < r.start_ns OR (o.start_ns = r.start_ns AND o.range_id < r.range_id)) GROUP BY 1),
  tr AS (SELECT r.*, coalesce(up.depth, 0) AS depth, up.parent_id FROM rt r LEFT JOIN up ON r.range_id = up.id),
  tp AS (SELECT t.range_id, t.name, CASE WHEN p.depth <= t.depth THEN t.parent_id END AS above FROM tr t LEFT JOIN tr p ON t.parent_id = p.range_id),
  pa AS (SELECT range_id, name AS path FROM tp WHERE above IS NULL UNION ALL SELECT tp.range_id, pa.path || '/' || tp.name FROM tp JOIN pa ON tp.above = pa.range_id),
  tree AS (SELECT tr.*, pa.path FROM tr JOIN pa USING (range_id))"""
_CHAIN = """chain AS (SELECT l.row_id, l.process_id, l.correlation_id, arg_max(r.range_id, struct_pack(a := r.start_ns, b := -r.end_ns, c := r.range_id)) AS inner_id,
    arg_max(r.name, struct_pack(a := r.start_ns, b := -r.end_ns, c := r.range_id)) AS inner_name, count(*) - 1 AS range_depth, string_agg(r.name, '/' ORDER BY r.start_ns, r.end_ns DESC, r.range_id) AS range_path
    FROM launches l JOIN ranges r ON l.global_tid = r.global_tid AND r.start_ns <= l.start_ns AND l.end_ns <= r.end_ns GROUP BY ALL)"""
_ATTR = _CHAIN + """, host AS (SELECT c.*, x.device_id, x.context_id FROM chain c JOIN contexts x USING (process_id)),
  att AS (SELECT s.*, h.inner_id AS range_id, coalesce(h.inner_name, '__no_nvtx__') AS range_name, h.range_depth, h.range_path FROM spans s LEFT JOIN host h USING (process_id, device_id, context_id, correlation_id))"""
ALL = "spans contexts launches ranges"


def _chains(spark, d):
    return R.enclosing_ranges(A.ranges(spark, d), A.launches(spark, d))


def _attributed(spark, d):
    return R.innermost_range(A.spans(spark, d), _chains(spark, d), A.contexts(spark, d))


@query("ranges", f"WITH RECURSIVE {{TABLES}}, {_TREE} SELECT range_id, depth, coalesce(parent_id, -1) AS parent_id, path FROM tree")
def n1_n2_range_tree(spark, d):
    return R.range_tree(A.ranges(spark, d)).select("range_id", "depth", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "path")


@query("ranges", "SELECT range_id, name, row_number() OVER (PARTITION BY global_tid, domain_id, name ORDER BY start_ns, range_id) - 1 AS iter_index FROM ranges")
def w9_iter_index(spark, d):
    return R.iter_index(A.ranges(spark, d)).select("range_id", "name", "iter_index")


@query("launches ranges", f"WITH {_CHAIN} SELECT row_id, inner_id, range_depth + 1 AS n, range_path FROM chain")
def n3_j4_enclosing_ranges(spark, d):
    return _chains(spark, d).select("row_id", F.element_at("chain", -1)["id"].alias("inner_id"), F.size("chain").cast("long").alias("n"), F.array_join(F.transform("chain", lambda x: x["name"]), "/").alias("range_path"))


@query(ALL, f"WITH {_ATTR}, it AS (SELECT range_id, row_number() OVER (PARTITION BY global_tid, domain_id, name ORDER BY start_ns, range_id) - 1 AS iter_index FROM ranges) SELECT row_id, range_id, range_name, range_depth, iter_index FROM att LEFT JOIN it USING (range_id)")
def n4_innermost_range(spark, d):
    att = R.with_iter_index(_attributed(spark, d), A.ranges(spark, d))
    return att.select("row_id", "range_id", "range_name", "range_depth", "iter_index")


def _stored(spark, d):
    at = scratch(spark, "attribution")
    name = "spanloom_" + at.split("/")[-2]
    return R.store_attribution(A.spans(spark, d), _chains(spark, d), A.contexts(spark, d), at, name)


@query(ALL, f"WITH {_ATTR} SELECT row_id, range_id, range_name, range_depth FROM att")
def s9_stored_attribution(spark, d):
    return R.innermost_stored(_stored(spark, d)).select("row_id", "range_id", "range_name", "range_depth")


@query(ALL, f"WITH {_ATTR} SELECT row_id FROM att WHERE range_path LIKE '%day%'")
def f16_under_range(spark, d):
    return R.under_range(A.spans(spark, d), _chains(spark, d), A.contexts(spark, d), lambda c: N.name_glob(c, "da?")).select("row_id")


@query(ALL, f"WITH {_ATTR}, d AS (SELECT *, end_ns - start_ns AS ns FROM att WHERE end_ns > start_ns) SELECT range_name, kind, {NS}, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, coalesce(sum(bytes), 0) / sum(ns) AS gbps, sum(ns) / (SELECT sum(ns) FROM d) AS share FROM d GROUP BY ALL")
def a6_stats_by_range(spark, d):
    return stats.span_stats(_attributed(spark, d), ("range_name", "kind"))


@query(ALL, f"""WITH RECURSIVE {{TABLES}}, {_ATTR}, {_TREE}, d AS (SELECT a.*, end_ns - a.start_ns AS ns, coalesce(t.path, '__no_nvtx__') AS path, coalesce(t.domain_id, -1) AS domain_id, coalesce(t.global_tid >> 24, -1) AS domain_pid
    FROM att a LEFT JOIN (SELECT range_id, path, domain_id, global_tid FROM tree) t USING (range_id) WHERE end_ns > a.start_ns)
  SELECT domain_pid, domain_id, path, {NS}, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, coalesce(sum(bytes), 0) / sum(ns) AS gbps, sum(ns) / (SELECT sum(ns) FROM d) AS share FROM d GROUP BY ALL""")
def a7_stats_by_range_path(spark, d):
    att = R.with_range_path(_attributed(spark, d), R.range_tree(A.ranges(spark, d)))
    return stats.span_stats(att.fillna(-1, ["domain_pid", "domain_id"]), ("domain_pid", "domain_id", "path"))


_SLICES = f"""{_CHAIN}, own AS (SELECT l.process_id, l.correlation_id, r.range_id FROM launches l JOIN ranges r ON l.global_tid = r.global_tid AND r.start_ns <= l.start_ns AND l.end_ns <= r.end_ns),
  w AS (SELECT range_id, s.* FROM own JOIN spans s USING (process_id, correlation_id)),
  g AS (SELECT range_id, process_id, device_id, stream_id, min(start_ns) AS gpu_start, max(end_ns) AS gpu_end, {', '.join(f"CAST(sum(CASE WHEN kind = '{k}' THEN end_ns - start_ns ELSE 0 END) AS BIGINT) AS {k}_ns" for k in ('kernel', 'memcpy', 'memset'))},
    {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_n" for k in ('kernel', 'memcpy', 'memset'))} FROM w GROUP BY ALL),
  slices AS (SELECT r.range_id, r.name, r.start_ns, r.end_ns, g.* EXCLUDE (range_id) FROM ranges r LEFT JOIN g USING (range_id))"""


_WORK = ("process_id", "device_id", "stream_id", "gpu_start", "gpu_end", "kernel_ns", "memcpy_ns", "memset_ns", "kernel_n", "memcpy_n", "memset_n")


def _slices(spark, d):
    return R.range_slices(A.ranges(spark, d), A.spans(spark, d), _chains(spark, d), A.contexts(spark, d))


@query(ALL, f"WITH {_SLICES} SELECT range_id, name, start_ns, end_ns, " + ", ".join(f"coalesce({c}, -1) AS {c}" for c in _WORK) + " FROM slices")
def n5_range_slices(spark, d):
    return _slices(spark, d).fillna(-1, list(_WORK))


@query(ALL, f"""WITH {_SLICES}, e AS (SELECT name, range_id, CAST(coalesce(sum(kernel_ns + memcpy_ns + memset_ns), 0) AS BIGINT) AS ns FROM slices GROUP BY ALL)
  SELECT name, count(*) AS instances, CAST(sum(ns) AS BIGINT) AS total, CAST(round(quantile_cont(ns, 0.5)) AS BIGINT) AS p50, CAST(round(quantile_cont(ns, 0.99)) AS BIGINT) AS p99 FROM e GROUP BY name""")
def n6_slice_stats(spark, d):
    return fitted(R.slice_stats(_slices(spark, d)).withColumns({c: F.round(c).cast("long") for c in ("p50", "p99")}), "total")


@query("ranges", f"WITH RECURSIVE {{TABLES}}, {_TREE} SELECT path, CAST(sum(end_ns - start_ns) AS BIGINT) AS total, count(*) AS instances FROM tree GROUP BY path ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5")
def a27_top_paths(spark, d):
    return R.top_paths(R.range_tree(A.ranges(spark, d)), 5)


@query("ranges", "SELECT DISTINCT global_tid >> 24 AS pid, domain_id, name FROM ranges WHERE event_type = 75")
def n19_domain_names(spark, d):
    return R.domain_names(A.ranges(spark, d))


@query("spans launches contexts", """SELECT s.row_id, l.row_id AS launch_id, s.start_ns - l.end_ns AS delay_ns FROM spans s JOIN (SELECT * FROM launches JOIN contexts USING (process_id)) l
  USING (process_id, device_id, context_id, correlation_id)""")
def j3_correlate_spans(spark, d):
    c = R.correlate_spans(A.spans(spark, d), A.launches(spark, d), A.contexts(spark, d))
    return c.select("row_id", "launch_id", (F.col("start_ns") - F.col("launch_end")).alias("delay_ns"))


@query("spans launches contexts", """WITH s AS (SELECT * REPLACE (CASE WHEN row_id % 3 = 0 THEN process_id END AS process_id) FROM spans),
  one AS (SELECT device_id, context_id, min(process_id) AS bc FROM contexts GROUP BY ALL HAVING count(DISTINCT process_id) = 1),
  o AS (SELECT s.*, bc FROM s LEFT JOIN one USING (device_id, context_id)),
  n AS (SELECT o.row_id, l.process_id AS p, abs(o.start_ns - l.start_ns) AS dist FROM o JOIN launches l USING (correlation_id) WHERE o.process_id IS NULL AND bc IS NULL),
  m AS (SELECT row_id, min(p) AS bp FROM n WHERE dist = (SELECT min(dist) FROM n x WHERE x.row_id = n.row_id) GROUP BY row_id HAVING count(DISTINCT p) = 1)
  SELECT row_id, coalesce(process_id, bc, bp) AS process FROM o LEFT JOIN m USING (row_id)""")
def j2_resolve_process(spark, d):
    s = A.spans(spark, d).withColumn("process_id", F.when(F.col("row_id") % 3 == 0, F.col("process_id")))
    return C.resolve_process(s, A.contexts(spark, d), A.launches(spark, d)).select("row_id", "process")


@query("spans launches", """WITH r AS (SELECT process_id, device_id, context_id, row_id // 20 AS correlation_id, min(start_ns) AS t FROM spans WHERE end_ns > start_ns GROUP BY ALL),
  l AS (SELECT * REPLACE (row_id // 20 AS correlation_id) FROM launches),
  m AS (SELECT r.*, l.row_id, l.name, row_number() OVER (PARTITION BY r.process_id, device_id, context_id, r.correlation_id, t ORDER BY CASE WHEN l.name LIKE 'api_view%' THEN 0 ELSE 1 END, CASE WHEN l.start_ns <= t THEN 0 ELSE 1 END, abs(t - l.start_ns), l.row_id) AS n
    FROM r LEFT JOIN l USING (process_id, correlation_id))
  SELECT process_id, device_id, correlation_id, t AS replay_start_ns, coalesce(row_id, -1) AS launch_id, coalesce(name, '') AS name FROM m WHERE n = 1""")
def j8_nearest_launcher(spark, d):
    r = A.spans(spark, d).filter("end_ns > start_ns").withColumn("correlation_id", F.expr("row_id div 20")).groupBy(*C.ID).agg(F.min("start_ns").alias("start_ns"))
    calls = A.launches(spark, d).withColumn("correlation_id", F.expr("row_id div 20"))
    out = C.nearest_launcher(r, calls, A.contexts(spark, d), "api_view%").drop("context_id")
    return out.fillna(-1, ["launch_id"]).fillna("", ["name"])


@query("spans", """WITH r AS (SELECT * REPLACE (row_id // 20 AS correlation_id), end_ns - start_ns AS ns FROM spans WHERE end_ns > start_ns),
  w AS (SELECT process_id, device_id, context_id, correlation_id, max(end_ns) - min(start_ns) AS wall FROM r GROUP BY ALL),
  g AS (SELECT process_id, device_id, context_id, correlation_id, graph_node_id, kind, name, count(*) AS events, count(DISTINCT stream_id) AS streams, CAST(sum(ns) AS BIGINT) AS sum_ns, max(ns) AS max_ns FROM r GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY process_id, device_id, context_id, correlation_id ORDER BY sum_ns DESC, graph_node_id NULLS LAST, kind, name) AS place FROM g)
  SELECT p.*, sum_ns / wall AS share FROM p JOIN w USING (process_id, device_id, context_id, correlation_id) WHERE place <= 3""")
def a16_replay_nodes(spark, d):
    return C.replay_nodes(_replay_spans(spark, d), 3)


@query("spans launches contexts", """WITH w AS (SELECT kind, row_id, process_id, device_id, context_id, row_id // 4 AS corr, start_ns, end_ns FROM spans UNION ALL SELECT 'sync', row_id, process_id, device_id, context_id, row_id // 4, end_ns, end_ns FROM spans WHERE kind = 'memcpy'),
  h AS (SELECT 'runtime' AS kind, row_id, process_id, row_id // 4 AS corr, start_ns, end_ns FROM launches),
  m AS (SELECT * FROM w UNION ALL SELECT h.kind, row_id, process_id, device_id, context_id, corr, start_ns, end_ns FROM h JOIN contexts USING (process_id)),
  r AS (SELECT process_id, corr, arg_min(device_id, (device_id, context_id)) AS device_id, arg_min(context_id, (device_id, context_id)) AS context_id FROM w GROUP BY ALL),
  c AS (SELECT process_id, arg_min(device_id, (device_id, context_id)) AS device_id, arg_min(context_id, (device_id, context_id)) AS context_id FROM contexts GROUP BY ALL),
  f AS (SELECT s.kind, s.row_id, s.process_id, s.device_id, s.context_id, s.corr, t.kind AS to_kind, t.row_id AS to_row_id, t.start_ns, t.end_ns FROM w s JOIN m t USING (process_id, device_id, context_id, corr)
    UNION ALL SELECT s.kind, s.row_id, s.process_id, coalesce(r.device_id, c.device_id), coalesce(r.context_id, c.context_id), s.corr, t.kind, t.row_id, t.start_ns, t.end_ns
      FROM h s JOIN c USING (process_id) LEFT JOIN r ON r.process_id = s.process_id AND r.corr = s.corr JOIN (SELECT kind, row_id, process_id, corr, start_ns, end_ns FROM w UNION ALL SELECT * FROM h) t ON t.process_id = s.process_id AND t.corr = s.corr),
  i AS (SELECT kind, row_id FROM w UNION ALL SELECT kind, row_id FROM h UNION ALL SELECT 'kernel', -5 UNION ALL SELECT 'range', 1)
  SELECT i.kind, i.row_id, f.kind IS NOT NULL AS found, coalesce(printf('p%x-d%x-c%x-r%x', process_id, device_id, context_id, corr), '') AS key, coalesce(to_kind, '') AS to_kind, coalesce(to_row_id, -1) AS to_row_id, coalesce(start_ns, -1) AS start_ns, coalesce(end_ns, -1) AS end_ns FROM i LEFT JOIN f USING (kind, row_id)""")
def n7_correlate(spark, d):
    s = A.spans(spark, d).withColumn("correlation_id", F.expr("row_id div 4"))  # ids are used on several devices
    syncs = s.filter("kind = 'memcpy'").withColumns({"kind": F.lit("sync"), "start_ns": F.col("end_ns")})
    work, host = s.unionByName(syncs), A.launches(spark, d).withColumns({"kind": F.lit("runtime"), "correlation_id": F.expr("row_id div 4")})
    ids = work.select("kind", "row_id").unionByName(host.select("kind", "row_id")).unionByName(spark.createDataFrame([("kernel", -5), ("range", 1)], "kind string, row_id long"))
    return C.correlate(ids, work, host, A.contexts(spark, d)).fillna(-1).fillna("", ["key", "to_kind"])


@query("spans launches contexts", """WITH r AS (SELECT process_id, device_id, context_id, correlation_id, kind FROM spans UNION ALL SELECT process_id, device_id, context_id, correlation_id, 'runtime' FROM launches JOIN contexts USING (process_id))
  SELECT 'contexts' AS what, count(DISTINCT (process_id, device_id, context_id)) AS n FROM contexts UNION ALL SELECT 'processes', count(DISTINCT process_id) FROM contexts
  UNION ALL SELECT 'groups', count(DISTINCT (process_id, device_id, context_id, correlation_id)) FROM r UNION ALL SELECT kind || '_rows', count(*) FROM r GROUP BY kind""")
def a17_correlation_stats(spark, d):
    return C.correlation_stats(A.spans(spark, d), A.launches(spark, d), A.contexts(spark, d))


@query("spans", """WITH k AS (SELECT * FROM spans WHERE kind = 'kernel') SELECT row_id, name, row_number() OVER (PARTITION BY name ORDER BY start_ns, row_id) - 1 AS ordinal, processes
  FROM k JOIN (SELECT name, count(DISTINCT process_id) AS processes FROM k GROUP BY name) USING (name)""")
def w10_prior_launches(spark, d):
    return C.prior_launches(A.spans(spark, d))


@query(ALL, f"""WITH {_ATTR}, t AS (SELECT *, end_ns - start_ns AS ns FROM att WHERE name LIKE 'purchase%' AND end_ns > start_ns)
  SELECT kind, row_id, ns, name, stream_id, bytes, coalesce(range_id, -1) AS range_id, range_name, (SELECT count(*) FROM t) AS matched, row_number() OVER (ORDER BY ns DESC, name, row_id) AS place FROM t ORDER BY ns DESC, name, row_id LIMIT 50""")
def q1_search(spark, d):
    around = _attributed(spark, d).select("kind", "row_id", F.coalesce("range_id", F.lit(-1)).alias("range_id"), "range_name")
    return C.search(A.spans(spark, d), N.name_glob("name", "purchase*"), "ns,+name", 50, ["name", "stream_id", "bytes"], around)


@query("spans", """WITH g AS (SELECT name, kind, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS total FROM spans WHERE end_ns > start_ns GROUP BY ALL)
  SELECT kind, name, n, total, (SELECT count(*) FROM g) AS matched, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS all_n, (SELECT CAST(sum(total) AS BIGINT) FROM g) AS all_total, row_number() OVER (ORDER BY kind, total DESC, name DESC) AS place FROM g ORDER BY kind, total DESC, name DESC LIMIT 12""")
def a11_w8_l1_listing(spark, d):
    g = stats.span_stats(A.spans(spark, d), ("kind", "name")).select("kind", "name", "n", "total")
    out = C.listing(g, "kind, -total", {"kind": "asc", "name": "asc", "total": "desc", "n": "desc"}, ("name",), 12, ("n", "total"))
    return fitted(out, "all_n", "all_total")


#: Spans with three names; the short one drops what follows the colon, some have no mangled one.
_NAMED = "nm AS (SELECT *, regexp_extract(name, '^[^:]*') AS short_name, name AS demangled_name, CASE WHEN row_id % 3 <> 0 THEN '_Z' || name END AS mangled_name, end_ns - start_ns AS ns FROM spans WHERE end_ns > start_ns)"
_AXES = {"short": "short_name", "demangled": "demangled_name", "mangled": "mangled_name", "none": "NULL", "missing": "demangled_name"}


@query("spans", f"WITH {_NAMED} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, kind, coalesce({c}, '-') AS axis_name, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total FROM nm GROUP BY ALL" for a, c in _AXES.items()))
def a2_stats_by_name_axis(spark, d):
    s = A.spans(spark, d).withColumns({"short_name": F.regexp_extract("name", "^[^:]*", 0), "demangled_name": F.col("name"), "mangled_name": F.when(F.col("row_id") % 3 != 0, F.concat(F.lit("_Z"), "name"))})
    out = None
    for axis in _AXES:
        t = s.drop("mangled_name") if axis == "missing" else s
        named = t.withColumn("axis_name", F.coalesce(N.name_axis("mangled" if axis == "missing" else axis, t.columns), F.lit("-")))
        g = stats.span_stats(named, ("kind", "axis_name")).select(F.lit(axis).alias("axis"), "kind", "axis_name", "n", "total")
        out = g if out is None else out.unionByName(g)
    return out


@query("spans", "WITH i AS (SELECT kind, row_id FROM spans UNION ALL SELECT 'memset', -1) SELECT kind, row_id, name, coalesce(start_ns, -1) AS start_ns, coalesce(bytes, -1) AS bytes, s.name IS NOT NULL AS found FROM i LEFT JOIN spans s USING (kind, row_id)")
def q2_q8_inspect(spark, d):
    s = A.spans(spark, d)
    ids = s.select("kind", "row_id").unionByName(spark.createDataFrame([("memset", -1)], "kind string, row_id long"))
    return C.inspect(ids, s.select("kind", "row_id", "name", "start_ns", "bytes"), ["kind", "row_id"]).fillna(-1)


@query("ranges", f"WITH RECURSIVE {{TABLES}}, {_TREE}, t AS (SELECT * FROM tree), i AS (SELECT range_id FROM ranges UNION ALL SELECT -1) SELECT range_id, coalesce(t.name, '') AS name, coalesce(t.start_ns, -1) AS start_ns, coalesce(path, '') AS path, coalesce(parent_id, -1) AS parent_id, t.name IS NOT NULL AS found FROM i LEFT JOIN t USING (range_id)")
def q3_inspect_ranges(spark, d):
    r = A.ranges(spark, d)
    ids = r.select("range_id").unionByName(spark.createDataFrame([(-1,)], "range_id long"))
    out = C.inspect(ids, R.range_tree(r).select("range_id", "name", "start_ns", "path", "parent_id"), ["range_id"])
    return out.fillna(-1, ["start_ns", "parent_id"]).fillna("", ["name", "path"])


@query("launches", """WITH i AS (SELECT row_id FROM launches UNION ALL SELECT -7) SELECT row_id, coalesce(name, '') AS name, coalesce((global_tid >> 24) & 16777215, -1) AS pid, coalesce(global_tid & 65535, -1) AS tid, coalesce(start_ns, -1) AS start_ns, coalesce(end_ns - start_ns, -1) AS ns, coalesce(correlation_id, -1) AS correlation_id, name IS NOT NULL AS found FROM i LEFT JOIN launches USING (row_id)""")
def q3_inspect_host_calls(spark, d):
    calls = A.launches(spark, d)
    ids = calls.select("row_id").unionByName(spark.createDataFrame([(-7,)], "row_id long"))
    out = C.inspect_host_calls(ids, calls)
    return out.select("row_id", F.coalesce("name", F.lit("")).alias("name"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("pid", "tid", "start_ns", "ns", "correlation_id")], "found")


_HIGH = f"WITH g AS (SELECT name, CAST(sum({CLIP}) AS BIGINT) AS total, count(*) AS n, max({CLIP}) AS longest FROM spans WHERE kind = 'kernel' AND {WIN} AND {CLIP} > 0 GROUP BY name)"


@query("spans", f"{_HIGH} SELECT *, total AS score, total / (SELECT sum(total) FROM g) AS share, row_number() OVER (ORDER BY total DESC, name) AS place FROM g ORDER BY total DESC, name LIMIT 5")
def q16_highlights(spark, d):
    return C.highlights(A.spans(spark, d), "name", 5, WINDOW)


@query("spans", f"{_HIGH} SELECT *, n AS score, n / (SELECT sum(n) FROM g) AS share, row_number() OVER (ORDER BY n DESC, name) AS place FROM g ORDER BY n DESC, name LIMIT 5")
def q16_highlights_by_count(spark, d):
    return C.highlights(A.spans(spark, d), "name", 5, WINDOW, "count")


@query("spans", f"{_HIGH} SELECT *, longest AS score, row_number() OVER (ORDER BY longest DESC, name) AS place FROM g ORDER BY longest DESC, name LIMIT 5")
def q16_highlights_by_longest(spark, d):
    return C.highlights(A.spans(spark, d), "name", 5, WINDOW, "max").drop("share")


@query("spans", f"""WITH g AS (SELECT row_id, {CLIP} AS ns, name, stream_id, start_ns FROM spans WHERE kind = 'kernel' AND {WIN} AND {CLIP} > 0)
  SELECT row_id, ns, ns AS score, ns / (SELECT sum(ns) FROM g) AS share, row_number() OVER (ORDER BY ns DESC, start_ns, CAST(row_id AS VARCHAR)) AS place, name, stream_id FROM g ORDER BY place LIMIT 20""")
def q16_highlighted_instances(spark, d):
    return C.highlighted_instances(A.spans(spark, d), 20, WINDOW, ["name", "stream_id"])


@query(ALL, f"""WITH RECURSIVE {{TABLES}}, {_SLICES}, {_TREE}, d AS (SELECT *, 'gpu/' || CAST(process_id AS VARCHAR) || '/' || CAST(device_id AS VARCHAR) AS key FROM spans WHERE end_ns > start_ns),
  t AS (SELECT process_id, device_id, stream_id, sum(end_ns - start_ns) AS busy FROM d GROUP BY ALL), lane AS (SELECT *, row_number() OVER (PARTITION BY process_id, device_id ORDER BY busy DESC, stream_id) AS r FROM t),
  on_ AS (SELECT DISTINCT range_id, process_id, device_id FROM slices WHERE device_id IS NOT NULL)
  SELECT key AS track_key, start_ns, end_ns, kind AS class, name AS label FROM d UNION ALL
  SELECT key || '/' || CAST(stream_id AS VARCHAR), start_ns, end_ns, kind, name FROM d JOIN lane USING (process_id, device_id, stream_id) WHERE r <= 2 UNION ALL
  SELECT 'api/' || CAST(process_id AS VARCHAR), start_ns, end_ns, 'runtime', name FROM launches UNION ALL
  SELECT 'range/' || CAST(coalesce(process_id, global_tid >> 24) AS VARCHAR) || '/' || coalesce(CAST(device_id AS VARCHAR), 'none') || '/' || CAST(depth + 1 AS VARCHAR), start_ns, coalesce(end_ns, start_ns), 'range', name FROM tree LEFT JOIN on_ USING (range_id)""")
def q17_l5_tracks(spark, d):
    on = C.ranges_on_devices(R.range_tree(A.ranges(spark, d)), _slices(spark, d))
    return C.tracks(A.spans(spark, d), 2, A.launches(spark, d), on)


#: Lookup tables: synchronisations, recorded events, graphs, their nodes and events, the profiler's own work.
_LOOK = """sy AS (SELECT row_id, start_ns, end_ns, device_id, context_id, CASE WHEN row_id % 4 <> 0 THEN stream_id END AS stream_id, row_id % 6 AS sync_type, correlation_id, CASE WHEN row_id % 3 = 0 THEN row_id // 3 END AS event_sync_id FROM spans),
  ce AS (SELECT row_id, start_ns, device_id, context_id, stream_id, row_id % 100 AS event_id, CASE WHEN row_id % 2 = 0 THEN row_id // 2 END AS event_sync_id, correlation_id FROM spans),
  gn AS (SELECT row_id, start_ns, CASE WHEN row_id % 2 = 0 THEN end_ns END AS end_ns, row_id % 900 AS graph_node_id FROM spans),
  kg AS (SELECT row_id % 450 AS graph_node_id, graph_id FROM spans WHERE kind = 'kernel'),
  ge AS (SELECT row_id, start_ns, end_ns, 93 + row_id % 3 AS event_class, graph_id, CASE WHEN row_id % 3 = 1 THEN row_id % 50 END AS graph_exec_id FROM spans WHERE kind = 'graph')"""


def _look(spark, d):
    s, r = A.spans(spark, d), F.col("row_id")
    where = ("row_id", "start_ns", "end_ns")
    sync = s.select(*where, "device_id", "context_id", F.when(r % 4 != 0, F.col("stream_id")).alias("stream_id"), (r % 6).alias("sync_type"), "correlation_id", F.when(r % 3 == 0, F.expr("row_id div 3")).alias("event_sync_id"))
    event = s.select("row_id", "start_ns", "device_id", "context_id", "stream_id", (r % 100).alias("event_id"), F.when(r % 2 == 0, F.expr("row_id div 2")).alias("event_sync_id"), "correlation_id")
    node = s.select("row_id", "start_ns", F.when(r % 2 == 0, F.col("end_ns")).alias("end_ns"), (r % 900).alias("graph_node_id"))
    kernel = s.filter("kind = 'kernel'").select((r % 450).alias("graph_node_id"), "graph_id")
    graph = s.filter("kind = 'graph'").select(*where, (93 + r % 3).alias("event_class"), "graph_id", F.when(r % 3 == 1, r % 50).alias("graph_exec_id"))
    return sync, event, node, kernel, graph


def _asked(spark, s):
    return s.select("row_id").unionByName(spark.createDataFrame([(-9,)], "row_id long"))


@query(ALL, f"""WITH {_ATTR}, {_LOOK}, i AS (SELECT row_id FROM sy UNION ALL SELECT -9)
  SELECT row_id, coalesce(end_ns - start_ns, -1) AS ns, coalesce(CASE WHEN sy.row_id IS NOT NULL THEN coalesce(stream_id, 0) END, -1) AS stream_id, CASE sync_type WHEN 1 THEN 'cudaEventSynchronize' WHEN 2 THEN 'cudaStreamWaitEvent' WHEN 3 THEN 'cudaStreamSynchronize' WHEN 4 THEN 'cudaDeviceSynchronize' ELSE CASE WHEN sy.row_id IS NULL THEN '' ELSE 'cudaSync' END END AS sync_type_name,
    coalesce(event_sync_id, -1) AS event_sync_id, coalesce(a.range_name, '') AS range_name, sy.row_id IS NOT NULL AS found FROM i LEFT JOIN sy USING (row_id) LEFT JOIN (SELECT row_id, range_name FROM att) a USING (row_id)""")
def q4_inspect_syncs(spark, d):
    sync = _look(spark, d)[0]
    out = C.inspect_syncs(_asked(spark, sync), sync, _attributed(spark, d).select("row_id", "range_name"))
    return out.select("row_id", "ns", "stream_id", "sync_type_name", "event_sync_id", "range_name", "found").fillna(-1).fillna("")


@query("spans", f"""WITH {_LOOK}, wa AS (SELECT event_sync_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS sync_ids FROM sy WHERE event_sync_id IS NOT NULL GROUP BY 1), i AS (SELECT row_id FROM ce UNION ALL SELECT -9)
  SELECT row_id, coalesce(event_id, -1) AS event_id, coalesce(event_sync_id, -1) AS event_sync_id, coalesce(sync_ids, '') AS sync_ids, ce.row_id IS NOT NULL AS found FROM i LEFT JOIN ce USING (row_id) LEFT JOIN wa USING (event_sync_id)""")
def q4_inspect_cuda_events(spark, d):
    sync, event, *_ = _look(spark, d)
    out = C.inspect_cuda_events(_asked(spark, event), event, sync).withColumn("sync_ids", F.array_join("sync_ids", ","))
    return out.select("row_id", "event_id", "event_sync_id", "sync_ids", "found").fillna(-1).fillna("")


@query("spans", f"""WITH {_LOOK}, own AS (SELECT graph_node_id, min(graph_id) AS graph_id FROM kg GROUP BY 1), ex AS (SELECT graph_id, min(graph_exec_id) AS graph_exec_id FROM ge WHERE event_class = 94 GROUP BY 1), i AS (SELECT row_id FROM gn UNION ALL SELECT -9)
  SELECT i.row_id, coalesce(end_ns - start_ns, CASE WHEN gn.row_id IS NULL THEN -1 ELSE 0 END) AS ns, coalesce(gn.graph_node_id, -1) AS graph_node_id, coalesce(own.graph_id, -1) AS graph_id, coalesce(graph_exec_id, -1) AS graph_exec_id, gn.row_id IS NOT NULL AS found
  FROM i LEFT JOIN gn USING (row_id) LEFT JOIN own ON gn.graph_node_id = own.graph_node_id LEFT JOIN ex ON own.graph_id = ex.graph_id""")
def q5_inspect_graph_nodes(spark, d):
    _, _, node, kernel, graph = _look(spark, d)
    out = C.inspect_graph_nodes(_asked(spark, node), node, kernel, graph)
    return out.select("row_id", "ns", "graph_node_id", "graph_id", "graph_exec_id", "found").fillna(-1)


@query("spans", f"""WITH {_LOOK}, i AS (SELECT row_id FROM ge UNION ALL SELECT -9) SELECT row_id, coalesce(end_ns - start_ns, -1) AS ns, CASE WHEN ge.row_id IS NULL THEN '' WHEN event_class = 94 THEN 'graph_exec_creation' WHEN event_class = 95 THEN 'graph_creation' ELSE 'graph_event_other' END AS event_class_name,
  coalesce(graph_id, -1) AS graph_id, coalesce(graph_exec_id, -1) AS graph_exec_id, ge.row_id IS NOT NULL AS found FROM i LEFT JOIN ge USING (row_id)""")
def q5_inspect_graph_events(spark, d):
    graph = _look(spark, d)[4]
    return C.inspect_graph_events(_asked(spark, graph), graph).select("row_id", "ns", "event_class_name", "graph_id", "graph_exec_id", "found").fillna(-1).fillna("")


@query("spans", "WITH i AS (SELECT row_id FROM spans WHERE kind = 'graph' UNION ALL SELECT -9) SELECT row_id, coalesce(end_ns - start_ns, -1) AS ns, coalesce(graph_id, -1) AS graph_id, coalesce(stream_id, -1) AS stream_id, s.row_id IS NOT NULL AS found FROM i LEFT JOIN (SELECT * FROM spans WHERE kind = 'graph') s USING (row_id)")
def q5_inspect_graphs(spark, d):
    g = A.spans(spark, d).filter("kind = 'graph'")
    return C.inspect_graphs(_asked(spark, g), g).select("row_id", "ns", "graph_id", "stream_id", "found").fillna(-1)


_KINDS = ("undefined", "unknown", "driver_compiler", "cupti_buffer_flush", "cupti_instrumentation", "cupti_resource", "runtime_module_loading", "lazy_function_loading", "command_buffer_full")


@query("launches", f"""WITH i AS (SELECT row_id FROM launches UNION ALL SELECT -9) SELECT row_id, coalesce(end_ns - start_ns, -1) AS ns, coalesce(global_tid, -1) AS global_tid,
  CASE WHEN l.row_id IS NULL THEN '' ELSE coalesce(list_extract({list(_KINDS)!r}, CAST(row_id % 10 + 1 AS INT)), 'overhead_other') END AS overhead_type_name, l.row_id IS NOT NULL AS found FROM i LEFT JOIN launches l USING (row_id)""")
def q6_inspect_overheads(spark, d):
    o = A.launches(spark, d).withColumn("overhead_type", F.col("row_id") % 10)
    return C.inspect_overheads(_asked(spark, o), o).select("row_id", "ns", "global_tid", "overhead_type_name", "found").fillna(-1).fillna("")
