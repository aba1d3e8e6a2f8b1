"""Counters, CPU samples and the scheduler."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.sums import fitted
from spanloom.operators import counters as K
from spanloom.operators import sampling as S
from spanloom.plans.registry import query
from spanloom.sources import adapters as A

DAY = 86400_000_000_000
Q = "quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99"


@query("point_samples", f"""WITH s AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY type_id, metric ORDER BY ts_ns, row_id) AS step FROM point_samples)
  SELECT type_id, metric, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, {Q}, max(ts_ns) - min(ts_ns) AS span_ns, coalesce(max(step), 0) AS max_gap_ns FROM s GROUP BY ALL""")
def c1_point_summary(spark, d):
    p = A.point_samples(spark, d)
    return K.point_summary(p, counters=p.select("type_id", "metric").distinct()).withColumn("mean", F.round("mean", 6)).fillna(0, ["max_gap_ns"])


@query("point_samples", f"""SELECT type_id, metric, ts_ns - ts_ns % {DAY} AS bucket_ns, count(*) AS n, round(CASE WHEN lower(regexp_extract(any_value(metric), '\\[([^\\]]*)\\]$', 1)) IN ('cycles active', 'requests') THEN sum(value) ELSE avg(value) END, 6) AS value FROM point_samples GROUP BY ALL""")
def c2_t3_point_series(spark, d):
    return K.point_series(A.point_samples(spark, d), DAY).withColumn("value", F.round("value", 6))


@query("interval_samples", f"""WITH s AS (SELECT *, end_ns - start_ns AS ns FROM interval_samples), g AS (SELECT global_id, port_id, metric, count(*) AS n, min(value) AS low, max(value) AS high, round(sum(value * ns) / sum(ns), 6) AS mean, {Q}, CAST(sum(ns) AS BIGINT) AS covered_ns FROM s GROUP BY ALL)
  SELECT global_id, port_id, metric, coalesce(n, 0) AS n, low, high, mean, p50, p95, p99, coalesce(covered_ns, 0) AS covered_ns FROM (SELECT DISTINCT metric FROM interval_samples) CROSS JOIN (SELECT DISTINCT global_id FROM interval_samples) CROSS JOIN (SELECT DISTINCT port_id FROM interval_samples) LEFT JOIN g USING (global_id, port_id, metric)""")
def c3_j6_interval_summary(spark, d):
    s = A.interval_samples(spark, d)
    ports = s.select("global_id").distinct().crossJoin(s.select("port_id").distinct())
    return K.interval_summary(s, counters=K.every_counter(s.select("metric").distinct(), ports)).withColumn("mean", F.round("mean", 6))


@query("interval_samples", f"""WITH b AS (SELECT *, unnest(range(start_ns - start_ns % {DAY}, end_ns, {DAY})) AS bucket_ns FROM interval_samples), c AS (SELECT *, least(end_ns, bucket_ns + {DAY}) - greatest(start_ns, bucket_ns) AS ns FROM b)
  SELECT global_id, port_id, metric, bucket_ns, count(*) AS n, round(sum(value * ns) / sum(ns), 6) AS value FROM c GROUP BY ALL""")
def c4_t4_interval_series(spark, d):
    return K.interval_series(A.interval_samples(spark, d), DAY).withColumn("value", F.round("value", 6))


@query("point_samples spans", "SELECT count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, (max(ts_ns) - min(ts_ns)) / (SELECT max(end_ns) - min(start_ns) FROM spans) AS coverage FROM point_samples")
def c5_coverage(spark, d):
    return K.coverage(A.point_samples(spark, d), A.spans(spark, d).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")))


_LEAF = """l AS (SELECT s.*, module, unresolved, CASE WHEN coalesce(unresolved, true) THEN '<unresolved>@' || coalesce(regexp_extract(module, '[^/]*$'), '?') ELSE symbol END AS symbol, regexp_extract(module, '[^/]*$') AS base
  FROM cpu_samples s LEFT JOIN (SELECT * FROM frames WHERE stack_depth = 0) f USING (id))"""


@query("cpu_samples frames", f"WITH {_LEAF} SELECT symbol, count(*) AS n, arg_min(id, struct_pack(a := start_ns, b := id)) AS example, count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY symbol")
def c6_hotspots_by_symbol(spark, d):
    return S.hotspots(S.leaves(A.cpu_samples(spark, d), A.frames(spark, d)), "symbol")


@query("cpu_samples frames", f"WITH {_LEAF} SELECT coalesce(base, '?') AS module, count(*) AS n, arg_min(id, struct_pack(a := start_ns, b := id)) AS example, count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY 1")
def c6_hotspots_by_module(spark, d):
    return S.hotspots(S.leaves(A.cpu_samples(spark, d), A.frames(spark, d)).withColumn("module", F.coalesce("module", F.lit("?"))), "module")


@query("cpu_samples frames", """WITH k AS (SELECT id, string_agg(symbol, ';' ORDER BY stack_depth, symbol) AS stack FROM frames GROUP BY id), s AS (SELECT * FROM cpu_samples JOIN k USING (id))
  SELECT stack, count(*) AS n, arg_min(id, struct_pack(a := start_ns, b := id)) AS example, count(*) / (SELECT count(*) FROM s) AS share FROM s GROUP BY stack""")
def c6_hotspots_by_stack(spark, d):
    return S.hotspots(S.stacks(A.cpu_samples(spark, d), A.frames(spark, d)), "stack")


@query("cpu_samples", "SELECT cpu, count(*) AS n, arg_min(id, struct_pack(a := start_ns, b := id)) AS example, count(*) / (SELECT count(*) FROM cpu_samples) AS share FROM cpu_samples GROUP BY cpu")
def c6_hotspots_by_cpu(spark, d):
    return S.hotspots(A.cpu_samples(spark, d), "cpu")


@query("cpu_samples frames", """WITH f AS (SELECT id, max(unresolved::INT) FILTER (stack_depth = 0) AS u, max(kernel_mode) FILTER (stack_depth = 0) AS k, max(stack_depth) AS depth FROM frames GROUP BY id)
  SELECT count(*) AS n, count(*) FILTER (u = 1) / count(*) AS unresolved, count(*) FILTER (k = 1) / count(*) AS kernel, count(*) FILTER (depth + 1 >= 7) / count(*) AS cut FROM cpu_samples LEFT JOIN f USING (id)""")
def c7_sampling_trust(spark, d):
    return S.sampling_trust(A.cpu_samples(spark, d), A.frames(spark, d), 7)


@query("cpu_samples frames", f"WITH {_LEAF} SELECT start_ns - start_ns % {30 * DAY} AS bucket_ns, symbol, count(*) AS n FROM l GROUP BY ALL")
def t5_sample_series(spark, d):
    return S.sample_series(S.leaves(A.cpu_samples(spark, d), A.frames(spark, d)), "symbol", 30 * DAY)


_QUANTA = """n AS (SELECT *, lead(start_ns) OVER w AS end_ns, lead(is_in) OVER w AS next_in, lead(state) OVER w AS left_in FROM sched WINDOW w AS (PARTITION BY global_tid, cpu ORDER BY start_ns, row_id)),
  q AS (SELECT global_tid, cpu, left_in AS state, start_ns, end_ns, end_ns - start_ns AS ns FROM n WHERE is_in = 1 AND next_in = 0)"""


@query("sched", f"WITH {_QUANTA} SELECT * FROM q")
def c8_quanta(spark, d):
    return S.quanta(A.sched(spark, d))


def _axis(key: str, more: str = "") -> str:
    return f"""WITH {_QUANTA}, o AS (SELECT {key}, CAST(sum(ns) AS BIGINT) AS on_ns, count(*) AS quanta, count(DISTINCT global_tid) AS threads FROM q GROUP BY {key}), s AS (SELECT {key}, max(start_ns) - min(start_ns) AS span_ns FROM sched GROUP BY {key})
  SELECT {key}, coalesce(on_ns, 0) AS on_ns, coalesce(quanta, 0) AS quanta, span_ns, greatest(span_ns - coalesce(on_ns, 0), 0) AS off_ns, coalesce(on_ns // quanta, -1) AS mean_ns{more} FROM s LEFT JOIN o USING ({key})"""


@query("sched", _axis("global_tid"))
def c9_j7_thread_time(spark, d):
    return S.thread_time(A.sched(spark, d)).fillna(-1, ["mean_ns"])


@query("sched", _axis("cpu", ", coalesce(threads, 0) AS threads"))
def c10_cpu_time(spark, d):
    return fitted(S.cpu_time(A.sched(spark, d)).fillna(-1, ["mean_ns"]), "on_ns")


@query("sched", f"""WITH {_QUANTA}, t AS (SELECT *, lead(start_ns) OVER w AS back, lead(is_in) OVER w AS in_again FROM sched WINDOW w AS (PARTITION BY global_tid ORDER BY start_ns, row_id)),
  f AS (SELECT state, CAST(sum(CASE WHEN in_again = 1 THEN back - start_ns ELSE 0 END) AS BIGINT) AS off_ns, count(*) AS switches FROM t WHERE is_in = 0 GROUP BY state), o AS (SELECT state, CAST(sum(ns) AS BIGINT) AS on_ns, count(*) AS quanta FROM q GROUP BY state)
  SELECT state, coalesce(off_ns, 0) AS off_ns, coalesce(switches, 0) AS switches, coalesce(on_ns, 0) AS on_ns, coalesce(quanta, 0) AS quanta, coalesce(on_ns // quanta, -1) AS mean_ns FROM f FULL JOIN o USING (state)""")
def c11_state_time(spark, d):
    return fitted(S.state_time(A.sched(spark, d)).fillna(-1, ["mean_ns"]), "off_ns", "on_ns")


@query("sched", """WITH g AS (SELECT *, start_ns - lag(start_ns) OVER (PARTITION BY cpu ORDER BY start_ns, row_id) AS gap FROM sched)
  SELECT cpu, count(*) FILTER (state NOT IN ('click', 'view')) / count(*) AS unknown, coalesce(max(gap), 0) AS max_gap_ns FROM g GROUP BY cpu""")
def c12_sched_trust(spark, d):
    return S.sched_trust(A.sched(spark, d), ("click", "view"))


@query("sched", f"""WITH {_QUANTA}, b AS (SELECT *, unnest(range(start_ns - start_ns % {DAY}, end_ns, {DAY})) AS bucket_ns FROM q WHERE end_ns > start_ns)
  SELECT bucket_ns, cpu, CAST(sum(least(end_ns, bucket_ns + {DAY}) - greatest(start_ns, bucket_ns)) AS BIGINT) AS ns FROM b GROUP BY ALL""")
def t6_on_cpu_series(spark, d):
    return S.on_cpu_series(A.sched(spark, d), "cpu", DAY)
