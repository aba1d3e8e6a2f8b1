"""Further queries: call chains, frames, flows, replays by range, listings, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.operators import chrome as C
from spanloom.operators import correlate as L
from spanloom.operators import nesting as R
from spanloom.operators import stats
from spanloom.plans.registry import query
from spanloom.sources import adapters as A
from spanloom.staging import scratch
from spanloom.streaming import live


@query("cpu_samples frames", """WITH k AS (SELECT id, string_agg(symbol || '@' || regexp_extract(module, '[^/]*$') || '@0x' || lower(to_hex(id * 64 + stack_depth)), ';' ORDER BY stack_depth, symbol) AS chain, count(*) AS depth FROM frames GROUP BY id)
  SELECT id, cpu, coalesce(chain, '') AS chain, coalesce(depth, 0) AS depth FROM cpu_samples LEFT JOIN k USING (id)""")
def q7_inspect_cpu_samples(spark, d):
    f = A.frames(spark, d).withColumn("ip", F.col("id") * 64 + F.col("stack_depth"))
    s = A.cpu_samples(spark, d)
    out = L.inspect_cpu_samples(s.select("id"), s, f)
    chain = F.array_join(F.transform("chain", lambda x: F.concat_ws("@", x["symbol"], x["module"], x["address"])), ";")
    return out.select("id", "cpu", F.coalesce(chain, F.lit("")).alias("chain"), F.coalesce(F.size("chain"), F.lit(0)).alias("depth").cast("long").alias("depth"))


@query("ev", """WITH RECURSIVE {TABLES}, p AS (SELECT event_id AS id, CASE WHEN event_id >= 3 THEN event_id // 3 END AS up, event_type AS name FROM ev),
  w AS (SELECT id, name AS path FROM p WHERE up IS NULL UNION ALL SELECT p.id, w.path || ' > ' || p.name FROM p JOIN w ON p.up = w.id) SELECT id AS row_id, path AS python_path FROM w""")
def n12_python_context(spark, d):
    e, up = A._events(spark, d), F.expr("event_id div 3")
    p = e.select(F.lit("t").alias("trace"), F.lit("python").alias("type"), F.col("event_id").alias("row_id"), F.col("event_id").alias("python_id"), F.when(F.col("event_id") >= 3, up).alias("python_parent"), F.col("event_type").alias("name"))
    return C.python_context(p)


@query("spans", """WITH m AS (SELECT row_id, process_id, stream_id, row_id // 2 AS flow, start_ns AS t FROM spans WHERE kind <> 'kernel'),
  b AS (SELECT m.row_id, m.flow, m.t, arg_min(k.row_id, struct_pack(a := k.end_ns - k.start_ns, b := k.start_ns, c := k.row_id)) AS outer_id FROM m JOIN spans k ON k.kind = 'kernel' AND k.process_id = m.process_id AND k.stream_id = m.stream_id AND k.start_ns <= t AND t <= k.end_ns GROUP BY ALL),
  f AS (SELECT lag(outer_id) OVER (PARTITION BY flow ORDER BY t, row_id) AS from_row_id, outer_id AS to_row_id FROM b) SELECT DISTINCT * FROM f WHERE from_row_id <> to_row_id""")
def n13_flow_edges(spark, d):
    s = A.spans(spark, d).withColumns({"trace": F.lit("t"), "pid": F.col("process_id"), "tid": F.col("stream_id"), "rank": F.lit(None).cast("long"), "flow_id": F.expr("row_id div 2")})
    marks = s.filter("kind <> 'kernel'").withColumns({"ph": F.lit("s"), "end_ns": F.col("start_ns")})
    return C.flow_edges(marks.unionByName(s.filter("kind = 'kernel'").withColumn("ph", F.lit("X"))))


@query("spans contexts launches ranges", """WITH p AS (SELECT l.row_id, l.process_id, l.correlation_id AS own, max(CASE WHEN r.name LIKE 'day/%shif%' THEN 1 ELSE 0 END) AS named, string_agg(r.name, '/' ORDER BY r.start_ns, coalesce(r.end_ns, r.start_ns) DESC, range_id) AS path
    FROM launches l JOIN ranges r ON r.global_tid = l.global_tid AND r.start_ns <= l.start_ns AND coalesce(r.end_ns, r.start_ns) >= l.end_ns WHERE l.name LIKE 'api_click%' GROUP BY ALL),
  hit AS (SELECT DISTINCT process_id, own FROM p WHERE named = 1 OR path LIKE 'day/%shif%'),
  r AS (SELECT * REPLACE (row_id // 20 AS correlation_id), correlation_id AS own FROM spans WHERE end_ns > start_ns)
  SELECT process_id, device_id, context_id, correlation_id, count(*) AS events, max(end_ns) - min(start_ns) AS wall_ns FROM r JOIN hit USING (process_id, own) GROUP BY ALL""")
def n18_replays_under_range(spark, d):
    inside = R.launched_under(A.spans(spark, d), A.ranges(spark, d), A.launches(spark, d), A.contexts(spark, d), lambda c: N.name_glob(c, "day/*shif*"), like="api_click%")
    return stats.replays(inside.withColumn("correlation_id", F.expr("row_id div 20"))).select("process_id", "device_id", "context_id", "correlation_id", "events", "wall_ns")


def _stream(spark, d, files: int = 1):
    """The events table, written to a folder in order of time that is then read as a stream of spans."""
    path = scratch(spark, "feed")
    rows = spark.read.parquet(f"{d}/events.parquet")
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    part = lambda i: lo + (hi - lo) * i / files
    for i in range(files):
        here = rows if files == 1 else rows.filter((F.col("ts") >= F.lit(part(i))) & ((F.col("ts") < F.lit(part(i + 1))) | F.lit(i == files - 1)))
        (here if files == 1 else here.coalesce(1)).write.mode("append").parquet(path)
    e = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 if files > 1 else 1000).parquet(path)
    us, u = F.unix_micros(F.col("ts").cast("timestamp")), F.col("user_id")
    return e.select(F.col("event_id").alias("row_id"), (u % 2).alias("process_id"), (u % 4 - u % 2).alias("device_id"), (us * 1000).alias("start_ns"), (us * 1000 + F.round(F.col("value") * 100).cast("long") * 1_000_000).alias("end_ns"))


def _drained(df, spark, name):
    """Runs the stream over what is there and reads what it wrote."""
    base = scratch(spark, name)
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("ev", """WITH b AS (SELECT us - us % 3600000000 AS h, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 1000000 AS total_ns FROM ev GROUP BY 1)
  SELECT h * 1000 AS bucket_ns, n, total_ns FROM b WHERE h + 3600000000 <= ((SELECT max(us) FROM ev) // 1000 - 600000) * 1000""")
def r1_live_activity(spark, d):
    return _drained(live.live_activity(_stream(spark, d), "1 hour", "10 minutes"), spark, "activity")


@query("ev", """WITH s AS (SELECT user_id % 2 AS process_id, user_id % 4 - user_id % 2 AS device_id, us * 1000 AS start_ns, us * 1000 + CAST(round(value * 100) AS BIGINT) * 1000000 AS end_ns FROM ev),
  b AS (SELECT *, max(end_ns) OVER (PARTITION BY process_id, device_id ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM s)
  SELECT process_id, device_id, busy AS start_ns, start_ns AS end_ns, start_ns - busy AS gap_ns FROM b WHERE start_ns > busy""")
def r2_live_gaps(spark, d):
    folder = scratch(spark, "gaps")
    q = live.start_gaps(_stream(spark, d, 8), folder, late_ns=3600_000_000_000)
    q.awaitTermination()
    return live.told_gaps(spark, folder).unionByName(live.last_gaps(spark, folder))


@query("ev", """WITH s AS (SELECT us * 1000 AS start_ns, us * 1000 + CAST(round(value * 100) AS BIGINT) * 1000000 AS end_ns FROM ev),
  b AS (SELECT *, unnest(range(start_ns - start_ns % 600000000000, end_ns, 600000000000)) AS bucket_ns FROM s WHERE end_ns > start_ns),
  g AS (SELECT bucket_ns, count(*) AS n, CAST(sum(least(end_ns, bucket_ns + 600000000000) - greatest(start_ns, bucket_ns)) AS BIGINT) AS total_ns FROM b GROUP BY 1)
  SELECT * FROM g WHERE bucket_ns + 600000000000 <= (SELECT max(bucket_ns) FROM b) - 600000000000""")
def r1_live_busy(spark, d):
    return _drained(live.live_busy(_stream(spark, d), 600_000_000_000, "10 minutes"), spark, "busy")
