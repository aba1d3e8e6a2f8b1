"""Queries over Chrome-format traces written from the events table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions.sums import fitted
from spanloom.operators import chrome as C
from spanloom.plans.registry import query
from spanloom.sources import adapters as A
from spanloom.sources import chrome as S
from spanloom.staging import scratch

#: Markers of flows have their event's id and this much.
MARK = 10**12
#: Chrome form of the events table in SQL: x. Every eleventh event has no rank.
_X = """x AS (SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'c10d::allreduce_' ELSE 'aten::op' END WHEN 'view' THEN 'nccl_all_reduce_kernel' WHEN 'purchase' THEN 'copy'
      WHEN 'signup' THEN CASE WHEN k % 5 = 4 THEN 'forward' ELSE 'ProfilerStep#' || CAST(k % 5 AS VARCHAR) END ELSE 'cudaLaunchKernel' END AS name,
    CASE event_type WHEN 'click' THEN 'cpu_op' WHEN 'view' THEN 'kernel' WHEN 'purchase' THEN 'gpu_memcpy' WHEN 'signup' THEN 'user_annotation' ELSE 'cuda_runtime' END AS cat,
    CASE event_type WHEN 'click' THEN 'cpu_op' WHEN 'view' THEN 'kernel' WHEN 'purchase' THEN 'memcpy' WHEN 'signup' THEN CASE WHEN k % 5 = 4 THEN 'annotation' ELSE 'step' END ELSE 'runtime' END AS type,
    event_type = 'view' OR (event_type = 'click' AND k % 3 = 0) AS comm, CASE WHEN event_type = 'view' OR (event_type = 'click' AND k % 3 = 0) THEN 'all_reduce' END AS collective,
    us * 1000 AS start_ns, us * 1000 + CAST(round(value * 100) AS BIGINT) * 200000000 AS end_ns, CASE WHEN event_id % 11 <> 0 THEN user_id % 2 END AS rank, CAST(user_id % 2 AS VARCHAR) AS pid, CAST(user_id % 8 AS VARCHAR) AS tid,
    user_id % 16 AS stream, event_id // 4 AS external_id, event_id // 4 AS correlation, CASE WHEN event_type = 'signup' AND k % 5 < 4 THEN k % 5 END AS step_no FROM ev)"""
_GPU = "('kernel', 'memcpy')"


def trace(spark, d, split=False):
    """Writes the events as trace files, a thousand events to a document, and reads them. Launches
    and kernels have markers of flows at their start."""
    e, u, k = A._events(spark, d), F.col("user_id"), F.col("k")
    pick = lambda *v: F.when(F.col("event_type") == "click", v[0]).when(F.col("event_type") == "view", v[1]).when(F.col("event_type") == "purchase", v[2]).when(F.col("event_type") == "signup", v[3]).otherwise(v[4])
    text = lambda c: c.cast("string")
    args = F.map_filter(
        F.create_map(
            F.lit("event"), text(F.col("event_id")), F.lit("rank"), F.when(F.col("event_id") % 11 != 0, text(u % 2)), F.lit("stream"), text(u % 16),
            F.lit("External id"), text(F.expr("event_id div 4")), F.lit("correlation"), text(F.expr("event_id div 4")),
        ),
        lambda _, v: v.isNotNull(),
    )
    name = pick(
        F.when(k % 3 == 0, "c10d::allreduce_").otherwise("aten::op"), F.lit("nccl_all_reduce_kernel"), F.lit("copy"),
        F.when(k % 5 == 4, "forward").otherwise(F.concat(F.lit("ProfilerStep#"), text(k % 5))), F.lit("cudaLaunchKernel"),
    )
    cat = pick(F.lit("cpu_op"), F.lit("kernel"), F.lit("gpu_memcpy"), F.lit("user_annotation"), F.lit("cuda_runtime"))
    lane = [F.col("us").cast("double").alias("ts"), text(u % 2).alias("pid"), text(u % 8).alias("tid")]
    none = F.lit(None).cast("string")
    one = F.struct(name.alias("name"), cat.alias("cat"), F.lit("X").alias("ph"), (F.round(F.col("value") * 100) * 200000).alias("dur"), none.alias("id"), *lane, args.alias("args"))
    phase = F.when(F.col("event_type") == "error", "s").when(F.col("event_type") == "view", "f")
    own = F.create_map(F.lit("event"), text(F.col("event_id") + MARK))
    mark = F.struct(F.lit("ac2g").alias("name"), F.lit("ac2g").alias("cat"), phase.alias("ph"), F.lit(0.0).alias("dur"), text(F.expr("event_id div 4")).alias("id"), *lane, own.alias("args"))
    rows = e.select("event_id", one.alias("e")).unionByName(e.filter(F.col("event_type").isin("error", "view")).select("event_id", mark.alias("e")))
    docs = rows.groupBy(F.expr("event_id div 1000").alias("part")).agg(F.collect_list("e").alias("traceEvents")).select(F.to_json(F.struct("traceEvents")).alias("value"))
    path = scratch(spark, "trace")
    docs.write.text(path)
    events = S.read_chrome_trace(spark, path, multi_line=False, split=split)
    return events.withColumns({"row_id": S.coalesce_args("args", "event", kind="long"), "trace": F.lit("t")})


@query("ev", f"WITH {_X} SELECT event_id AS row_id, name, type, comm, coalesce(collective, '') AS collective, start_ns, end_ns, coalesce(rank, -1) AS rank, stream, external_id FROM x")
def s4_s6_chrome_events(spark, d):
    e = C.timed(trace(spark, d)).select("row_id", "name", "type", "comm", F.coalesce("collective", F.lit("")).alias("collective"), "start_ns", "end_ns", "rank", "stream", "external_id")
    return e.fillna(-1, ["rank"])


@query("ev", f"WITH {_X} SELECT event_id AS row_id, name, type, comm, coalesce(collective, '') AS collective, start_ns, end_ns, coalesce(rank, -1) AS rank, stream, external_id FROM x")
def s4_split_documents(spark, d):
    e = C.timed(trace(spark, d, split=True)).select("row_id", "name", "type", "comm", F.coalesce("collective", F.lit("")).alias("collective"), "start_ns", "end_ns", "rank", "stream", "external_id")
    return e.fillna(-1, ["rank"])


@query("ev", f"""WITH {_X} SELECT event_id AS row_id, 'event' AS arg_key, CAST(event_id AS VARCHAR) AS arg_json FROM x UNION ALL SELECT event_id, 'stream', CAST(stream AS VARCHAR) FROM x UNION ALL SELECT event_id, 'rank', CAST(rank AS VARCHAR) FROM x WHERE rank IS NOT NULL
  UNION ALL SELECT event_id, 'External id', CAST(external_id AS VARCHAR) FROM x UNION ALL SELECT event_id, 'correlation', CAST(correlation AS VARCHAR) FROM x
  UNION ALL SELECT event_id + {MARK}, 'event', CAST(event_id + {MARK} AS VARCHAR) FROM x WHERE type IN ('kernel', 'runtime')""")
def s7_explode_args(spark, d):
    return S.explode_args(trace(spark, d))


@query("ev", f"""WITH {_X}, y AS (SELECT 'X' AS ph, cat, type FROM x UNION ALL SELECT CASE type WHEN 'kernel' THEN 'f' ELSE 's' END, 'ac2g', 'flow' FROM x WHERE type IN ('kernel', 'runtime'))
  SELECT 'phase' AS what, ph AS value, count(*) AS n FROM y GROUP BY ph UNION ALL SELECT 'category', cat, count(*) FROM y GROUP BY cat UNION ALL SELECT 'type', type, count(*) FROM y GROUP BY type
  UNION ALL SELECT 'argument', 'event', count(*) FROM y UNION ALL SELECT 'argument', a, count(*) FROM x, (VALUES ('stream'), ('External id'), ('correlation')) v(a) GROUP BY a UNION ALL SELECT 'argument', 'rank', count(rank) FROM x
  UNION ALL SELECT 'typed', 'rank', count(rank) FROM x UNION ALL SELECT 'typed', a, count(*) FROM x, (VALUES ('stream'), ('external_id'), ('correlation')) v(a) GROUP BY a UNION ALL SELECT 'typed', 'step_no', count(step_no) FROM x
  UNION ALL SELECT 'typed', 'device', 0 UNION ALL SELECT 'typed', 'bytes', 0 UNION ALL SELECT 'typed', 'shape', 0""")
def a25_schema_survey(spark, d):
    return S.schema_survey(trace(spark, d))


@query("ev", f"""WITH {_X} SELECT count(*) + count(*) FILTER (type IN ('kernel', 'runtime')) AS events, bool_or(type = 'runtime') AS has_runtime, false AS has_driver, bool_or(type IN {_GPU}) AS has_gpu, false AS has_memory, false AS has_python,
  false AS has_python_stack, bool_or(comm) AS has_comm, bool_or(type = 'step') AS has_steps, true AS has_flows, count(DISTINCT rank) AS ranks FROM x""")
def a25_capabilities(spark, d):
    return S.capabilities(trace(spark, d)).drop("devices")


@query("ev", f"WITH {_X} SELECT event_id AS row_id FROM x WHERE (type = 'memcpy' OR comm) AND stream < 8")
def f13_q9_filter_events(spark, d):
    return C.filter_events(trace(spark, d), ("memcpy",), True, F.col("stream") < 8).select("row_id")


_STEP = """s AS (SELECT c.event_id AS row_id, arg_min(o.event_id, struct_pack(a := o.end_ns - o.start_ns, b := o.start_ns, c := o.event_id)) AS step_id FROM x c JOIN x o
    ON o.step_no IS NOT NULL AND c.type <> 'step' AND (c.rank IS NULL OR o.rank IS NULL OR c.rank = o.rank) AND o.start_ns <= c.start_ns AND c.end_ns <= o.end_ns GROUP BY 1)"""


@query("ev", f"""WITH {_X}, {_STEP}, d AS (SELECT x.type, coalesce(CAST(o.step_no AS VARCHAR), CAST(x.step_no AS VARCHAR), 'none') AS step, coalesce(x.collective, 'none') AS comm_kind, x.end_ns - x.start_ns AS ns FROM x LEFT JOIN s ON x.event_id = s.row_id LEFT JOIN x o ON s.step_id = o.event_id)
  SELECT type, step, comm_kind, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total, CAST(round_even(avg(ns), 0) AS BIGINT) AS mean, min(ns) AS least, max(ns) AS most,
  quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99 FROM d GROUP BY ALL""")
def a13_event_stats(spark, d):
    return C.event_stats(C.with_axes(trace(spark, d)), ("type", "step", "comm_kind"))


_DAY = 86400_000_000_000


@query("ev", f"""WITH {_X}, b AS (SELECT *, unnest(range(start_ns - start_ns % {_DAY}, end_ns, {_DAY})) AS bucket_ns FROM x WHERE end_ns > start_ns), c AS (SELECT *, least(end_ns, bucket_ns + {_DAY}) - greatest(start_ns, bucket_ns) AS ns FROM b),
  t AS (SELECT bucket_ns, type, CAST(sum(ns) AS BIGINT) AS ns FROM c GROUP BY ALL), m AS (SELECT bucket_ns, string_agg(type || '=' || CAST(ns AS VARCHAR), ',' ORDER BY type) AS by_type FROM t GROUP BY ALL)
  SELECT bucket_ns, 'bucket|' || CAST(bucket_ns AS VARCHAR) || '..' || CAST(bucket_ns + {_DAY} AS VARCHAR) AS key, by_type, count(*) AS n, CAST(sum(CASE WHEN type NOT IN {_GPU} THEN ns ELSE 0 END) AS BIGINT) AS cpu_ns, CAST(sum(CASE WHEN type IN {_GPU} THEN ns ELSE 0 END) AS BIGINT) AS gpu_ns, CAST(sum(CASE WHEN comm THEN ns ELSE 0 END) AS BIGINT) AS comm_ns FROM c JOIN m USING (bucket_ns) GROUP BY ALL""")
def t2_event_buckets(spark, d):
    b = C.event_buckets(trace(spark, d), _DAY)
    said = F.array_join(F.transform(F.map_entries("by_type_ns"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return b.select("bucket_ns", N.bucket_key("bucket_ns", F.col("bucket_ns") + _DAY).alias("key"), said.alias("by_type"), "n", "cpu_ns", "gpu_ns", "comm_ns")


_PARENT = f"""h AS (SELECT * FROM x WHERE type NOT IN {_GPU} AND end_ns > start_ns),
  par AS (SELECT c.event_id AS row_id, arg_max(o.event_id, struct_pack(a := o.start_ns, b := -o.end_ns, c := o.event_id)) AS parent_id FROM h c JOIN h o ON c.rank IS NOT DISTINCT FROM o.rank AND c.tid = o.tid AND o.start_ns <= c.start_ns AND c.end_ns <= o.end_ns
    AND o.event_id <> c.event_id AND (o.start_ns < c.start_ns OR o.end_ns > c.end_ns OR o.event_id < c.event_id) GROUP BY 1)"""


@query("ev", f"WITH {_X}, {_PARENT} SELECT row_id, parent_id FROM par")
def n8_event_parents(spark, d):
    return C.event_parents(trace(spark, d))


@query("ev", f"WITH {_X}, {_STEP} SELECT row_id, step_id, step_no FROM s JOIN x ON step_id = event_id")
def n11_j10_assign_steps(spark, d):
    return C.assign_steps(trace(spark, d)).select("row_id", "step_id", "step_no")


def _slices_sql(inside: str = "true", own: str = "true", agree: str = "(c.rank IS NULL OR o.rank IS NULL OR c.rank = o.rank)", time: str = "c.end_ns - c.start_ns", kept: str = "true") -> str:
    add = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} AND {inside} AND {agree} THEN {time} ELSE 0 END), 0) AS BIGINT)"
    return f"""{_PARENT}, i AS (SELECT o.event_id AS slice_id, {add(f"c.type IN {_GPU}")} AS gpu_ns, {add("c.comm")} AS comm_ns, coalesce(bool_or({inside}), false) AS hit
    FROM x o JOIN x c ON o.type IN ('step', 'annotation') AND o.event_id <> c.event_id AND o.start_ns <= c.start_ns AND c.end_ns <= o.end_ns GROUP BY 1),
  ch AS (SELECT parent_id AS slice_id, count(*) AS children FROM par GROUP BY 1),
  sl AS (SELECT event_id AS slice_id, name AS slice, coalesce(step_no, -1) AS slice_step, end_ns - start_ns AS ns, coalesce(children, 0) AS children, coalesce(gpu_ns, 0) AS gpu_ns, coalesce(comm_ns, 0) AS comm_ns
    FROM x o LEFT JOIN i ON event_id = i.slice_id LEFT JOIN ch ON event_id = ch.slice_id WHERE type IN ('step', 'annotation') AND {own} AND {kept})"""


@query("ev", f"WITH {_X}, {_slices_sql()} SELECT * FROM sl")
def n9_event_slices(spark, d):
    return C.event_slices(trace(spark, d)).fillna(-1, ["slice_step"])


_LO, _HI = 1704067200_000_000_000 + 2 * _DAY, 1704067200_000_000_000 + 9 * _DAY


@query("ev", f"WITH {_X}, " + _slices_sql(
    f"coalesce(c.rank = 1 AND c.stream = 5, false) AND c.start_ns < {_HI} AND c.end_ns > {_LO}", f"(rank IS NULL OR rank = 1) AND (stream IS NULL OR stream = 5) AND start_ns < {_HI} AND end_ns > {_LO}", "true", f"least(c.end_ns, {_HI}) - greatest(c.start_ns, {_LO})",
    "(coalesce(rank = 1 AND stream = 5, false) OR coalesce(hit, false))") + " SELECT * FROM sl")
def j12_scoped_slices(spark, d):
    return C.event_slices(trace(spark, d), window=(_LO, _HI), rank=1, stream=5).fillna(-1, ["slice_step"])


@query("ev", f"WITH {_X}, {_slices_sql()} SELECT slice, count(*) AS instances, CAST(sum(ns) AS BIGINT) AS ns, CAST(sum(children) AS BIGINT) AS children, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns, CAST(sum(comm_ns) AS BIGINT) AS comm_ns FROM sl GROUP BY slice")
def n10_slice_stats(spark, d):
    return fitted(C.event_slice_stats(C.event_slices(trace(spark, d))), "ns", "gpu_ns", "comm_ns")


_LAUNCH = f"""kc AS (SELECT correlation, count(DISTINCT rank) AS ranks FROM x WHERE type IN {_GPU} OR type = 'runtime' GROUP BY 1),
  a AS (SELECT g.event_id AS row_id, arg_max(r.event_id, struct_pack(a := r.start_ns, b := r.event_id)) AS launcher FROM x g JOIN kc USING (correlation) JOIN x r ON g.type IN {_GPU} AND r.type = 'runtime' AND g.correlation = r.correlation AND r.start_ns <= g.start_ns
    AND (ranks <= 1 OR r.rank IS NOT DISTINCT FROM g.rank) GROUP BY 1)"""


@query("ev", f"WITH {_X}, {_LAUNCH} SELECT launcher, row_id FROM a")
def j9_asof_launcher(spark, d):
    return C.asof_launcher(trace(spark, d))


_FLOW = """fm AS (SELECT m.event_id, m.external_id AS flow, m.start_ns AS t, CASE m.type WHEN 'kernel' THEN 'f' ELSE 's' END AS ph, m.pid, m.tid FROM x m WHERE m.type IN ('kernel', 'runtime')),
  fb AS (SELECT m.event_id, m.flow, m.t, m.ph, arg_min(o.event_id, struct_pack(a := o.end_ns - o.start_ns, b := o.start_ns, c := o.event_id)) AS outer_id FROM fm m JOIN x o ON m.pid = o.pid AND m.tid = o.tid AND o.start_ns <= m.t AND m.t <= o.end_ns GROUP BY ALL),
  fe AS (SELECT DISTINCT f, t FROM (SELECT lag(outer_id) OVER (PARTITION BY flow ORDER BY t, ph, event_id) AS f, outer_id AS t FROM fb) WHERE f <> t)"""
_LINKS = f"""{_LAUNCH}, {_STEP}, {_PARENT}, {_FLOW},
  ke AS (SELECT external_id, count(DISTINCT rank) AS ranks FROM x GROUP BY 1),
  e AS (SELECT lag(event_id) OVER (PARTITION BY external_id, rank ORDER BY start_ns, event_id) AS f, event_id AS t FROM x
    UNION ALL SELECT CASE WHEN rank IS NULL THEN last_value(CASE WHEN rank IS NOT NULL THEN event_id END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN rank IS NULL THEN event_id END IGNORE NULLS) OVER w END, event_id FROM x JOIN ke USING (external_id) WHERE ranks = 1
      WINDOW w AS (PARTITION BY external_id ORDER BY start_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  links AS (SELECT parent_id AS from_row_id, row_id AS to_row_id, 'nesting' AS kind FROM par UNION ALL SELECT step_id, row_id, 'step' FROM s UNION ALL SELECT f, t, 'external' FROM e WHERE f IS NOT NULL UNION ALL SELECT launcher, row_id, 'correlation' FROM a UNION ALL SELECT f, t, 'flow' FROM fe)"""


@query("ev", f"WITH {_X}, {_LINKS} SELECT * FROM links")
def n14_event_links(spark, d):
    return C.event_links(C.narrow(trace(spark, d)))


_CAUSE = f"""ty AS (SELECT event_id, start_ns AS at_ns, CASE WHEN type IN {_GPU} THEN 'gpu' WHEN type = 'runtime' THEN 'call' ELSE 'root' END AS is_ FROM x),
  st AS (SELECT d.direction, d.a, d.b, d.kind, p.is_ AS a_is, q.is_ AS b_is, p.at_ns AS a_at, q.at_ns AS b_at FROM (SELECT 'down' AS direction, from_row_id AS a, to_row_id AS b, kind FROM links UNION ALL SELECT 'up', to_row_id, from_row_id, kind FROM links) d
    JOIN ty p ON p.event_id = d.a JOIN ty q ON q.event_id = d.b WHERE d.kind IN ('external', 'correlation', 'flow')),
  w AS (SELECT event_id AS seed, event_id AS row_id, v.direction, true AS goes FROM ty, (VALUES ('up'), ('down')) v(direction) WHERE is_ = 'call' OR (is_ = 'gpu') = (v.direction = 'up')
    UNION SELECT seed, b, w.direction, b = seed OR b_is = 'call' OR (w.direction = 'up' AND b_is = 'gpu') FROM w JOIN st ON w.direction = st.direction AND w.row_id = st.a AND w.goes AND (kind <> 'external'
      OR (w.direction = 'down' AND a_is <> 'gpu' AND (a = seed OR a_is <> 'root') AND (b = seed OR b_is <> 'root') AND b_at >= a_at) OR (w.direction = 'up' AND a_is <> 'root' AND (a = seed OR a_is <> 'gpu') AND b_at <= a_at))),
  sib AS (SELECT DISTINCT w.seed, c.from_row_id AS row_id, 'down' AS direction FROM w JOIN st ON w.direction = 'down' AND st.direction = 'down' AND w.row_id = st.a AND w.goes AND st.kind = 'correlation' AND b_is = 'gpu' JOIN links c ON c.kind = 'correlation' AND c.to_row_id = st.b)"""


@query("ev", f"WITH RECURSIVE {{TABLES}}, {_X}, {_LINKS}, {_CAUSE} SELECT DISTINCT seed, row_id, direction FROM (SELECT seed, row_id, direction FROM w UNION ALL SELECT * FROM sib) WHERE seed <> row_id")
def n15_causal_chain(spark, d):
    e = C.narrow(trace(spark, d))
    return C.causal_chain(e, e, C.event_links(e, C.CAUSAL)).select("seed", "row_id", "direction")


_COLLECTIVES = f"""ce AS (SELECT x.event_id, x.type, x.start_ns, x.end_ns, coalesce(x.rank, -1) AS rank, coalesce(o.step_no, x.step_no, -1) AS step, x.collective FROM x LEFT JOIN s ON x.event_id = s.row_id LEFT JOIN x o ON s.step_id = o.event_id WHERE x.comm),
  pr AS (SELECT *, row_number() OVER (PARTITION BY rank, step, collective ORDER BY start_ns, event_id) - 1 AS ordinal FROM ce WHERE type = 'cpu_op'),
  ge AS (SELECT *, row_number() OVER (PARTITION BY rank, step, collective ORDER BY start_ns, event_id) - 1 AS nth FROM ce WHERE type IN {_GPU}),
  rc AS (SELECT event_id AS p, event_id AS r FROM pr UNION SELECT p, to_row_id FROM rc JOIN links ON rc.r = from_row_id AND kind IN ('external', 'correlation', 'flow') AND to_row_id NOT IN (SELECT event_id FROM pr)),
  lk AS (SELECT pr.event_id AS cpu_id, ge.event_id AS kernel_id FROM rc JOIN pr ON rc.p = pr.event_id JOIN ge ON rc.r = ge.event_id AND ge.rank = pr.rank AND ge.step = pr.step AND ge.collective = pr.collective),
  fb2 AS (SELECT pr.event_id AS cpu_id, ge.event_id AS kernel_id FROM pr LEFT JOIN ge USING (rank, step, collective) WHERE ge.nth = pr.ordinal AND pr.event_id NOT IN (SELECT cpu_id FROM lk)),
  al AS (SELECT cpu_id, kernel_id, 'link' AS confidence FROM lk UNION ALL SELECT cpu_id, kernel_id, 'ordinal' FROM fb2 UNION ALL SELECT event_id, NULL, 'cpu-only' FROM pr WHERE event_id NOT IN (SELECT cpu_id FROM lk UNION ALL SELECT cpu_id FROM fb2)),
  le AS (SELECT *, row_number() OVER (PARTITION BY rank, step, collective ORDER BY start_ns, event_id) - 1 AS more FROM ge WHERE event_id NOT IN (SELECT kernel_id FROM al WHERE kernel_id IS NOT NULL)),
  np AS (SELECT rank, step, collective, count(*) AS primaries FROM pr GROUP BY ALL),
  cl AS (SELECT pr.rank, pr.step, pr.collective, pr.ordinal, cpu_id, confidence, string_agg(CAST(kernel_id AS VARCHAR), ',' ORDER BY kernel_id) AS kernels, least(min(pr.start_ns), min(ge.start_ns)) AS start_ns, greatest(max(pr.end_ns), max(ge.end_ns)) AS end_ns
      FROM al JOIN pr ON cpu_id = pr.event_id LEFT JOIN ge ON kernel_id = ge.event_id GROUP BY ALL
    UNION ALL SELECT rank, step, collective, CASE WHEN primaries IS NULL THEN nth ELSE primaries + more END, -1, 'kernel-only', CAST(event_id AS VARCHAR), start_ns, end_ns FROM le LEFT JOIN np USING (rank, step, collective))"""


def _collectives(spark, d):
    e = C.narrow(trace(spark, d))
    return C.collectives(e, C.event_links(e, C.CAUSAL))


def _flat(c):
    return c.withColumn("kernels", F.array_join("kernel_ids", ",")).fillna(-1, ["cpu_id"]).drop("kernel_ids", "skew_ns", "slow_rank")


@query("ev", f"WITH RECURSIVE {{TABLES}}, {_X}, {_LINKS}, {_COLLECTIVES} SELECT * REPLACE (coalesce(kernels, '') AS kernels) FROM cl")
def n16_n17_collectives(spark, d):
    return _flat(_collectives(spark, d))


#: Two ranks: the clock of rank 1 by the median difference of matched ends.
_SKEW = """, pq AS (SELECT a.collective, a.step, a.ordinal, a.start_ns AS s0, b.start_ns AS s1, b.end_ns - a.end_ns AS diff FROM cl a JOIN cl b USING (collective, step, ordinal) WHERE a.rank = 0 AND b.rank = 1),
  co AS (SELECT quantile_disc(diff, 0.5) AS off FROM pq), sk AS (SELECT collective, step, ordinal, abs(s1 - off - s0) AS skew_ns, CAST(s1 - off > s0 AS BIGINT) AS slow_rank FROM pq, co)"""


@query("ev", f"WITH RECURSIVE {{TABLES}}, {_X}, {_LINKS}, {_COLLECTIVES}{_SKEW} SELECT rank, step, collective, ordinal, cpu_id, CASE WHEN rank >= 0 THEN coalesce(skew_ns, -1) ELSE -1 END AS skew_ns, CASE WHEN rank >= 0 THEN coalesce(slow_rank, -1) ELSE -1 END AS slow_rank, CASE WHEN rank = 1 THEN coalesce(off, 0) ELSE 0 END AS offset_ns FROM cl LEFT JOIN sk USING (collective, step, ordinal), co")
def n17_rank_skew(spark, d):
    out = C.rank_skew(_collectives(spark, d)).select("rank", "step", "collective", "ordinal", "cpu_id", "skew_ns", "slow_rank", "offset_ns")
    return out.fillna(-1, ["cpu_id", "skew_ns", "slow_rank"]).fillna(0, ["offset_ns"])


@query("ev", f"WITH RECURSIVE {{TABLES}}, {_X}, {_LINKS}, {_COLLECTIVES} SELECT * REPLACE (coalesce(kernels, '') AS kernels) FROM cl WHERE (collective, step, ordinal) IN (SELECT (collective, step, ordinal) FROM cl WHERE rank = 1 AND step = 2)")
def u4_whole_collectives(spark, d):
    return _flat(C.collective_groups(_collectives(spark, d), rank=1, step=2))


@query("ev", f"""WITH {_X}, {_LINKS}, ch AS (SELECT from_row_id AS id, count(*) AS children FROM links WHERE kind = 'nesting' GROUP BY 1), bo AS (SELECT id, count(DISTINCT (kind, f, t)) AS links FROM (SELECT from_row_id AS id, kind, from_row_id AS f, to_row_id AS t FROM links UNION ALL SELECT to_row_id, kind, from_row_id, to_row_id FROM links) GROUP BY 1)
  SELECT event_id AS row_id, name, coalesce(parent_id, -1) AS parent_id, coalesce(step_id, -1) AS step_id, coalesce(children, 0) AS children, coalesce(links, 0) AS links, true AS found FROM x LEFT JOIN par ON event_id = par.row_id LEFT JOIN s ON event_id = s.row_id LEFT JOIN ch ON event_id = ch.id LEFT JOIN bo ON event_id = bo.id""")
def q10_inspect_events(spark, d):
    e = trace(spark, d)
    out = C.inspect_events(C.timed(e).select("row_id"), e, C.event_links(C.narrow(e)))
    return out.select("row_id", "name", "parent_id", "step_id", F.size("children").cast("long").alias("children"), F.size("links").cast("long").alias("links"), "found").fillna(-1, ["parent_id", "step_id"])
