"""Canonical trace tables made from the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("long")})


def spans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "memcpy").when(F.col("event_type") == "signup", "memset").when(F.col("event_type") == "error", "graph").otherwise("kernel")
    u, start = F.col("user_id"), F.col("us") * 1000
    return _events(spark, d).select(
        F.col("event_id").alias("row_id"), kind.alias("kind"), F.concat("event_type", F.lit(":"), (F.col("k") % 10).cast("string")).alias("name"), (u % 2).alias("process_id"),
        (u % 4 - u % 2).alias("device_id"), F.lit(1).cast("long").alias("context_id"), (u % 16).alias("stream_id"), F.col("event_id").alias("correlation_id"), start.alias("start_ns"),
        (start + F.round(F.col("value") * 100).cast("long") * 600000000).alias("end_ns"), F.when(F.col("event_type").isin("purchase", "signup"), F.col("k") * 1024).alias("bytes"),
        (F.col("k") % 7).alias("graph_node_id"), (u % 8).alias("graph_id"), (F.col("k") % 5 + 1).alias("grid_x"), (F.col("k") % 3 + 1).alias("block_x"),
    )


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("device_id", "context_id", "process_id").distinct()


def launches(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return _events(spark, d).select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("api_"), "event_type", F.lit("_v"), (F.col("k") % 3).cast("string")).alias("name"), ((u % 2) * 16777216 + u % 4).alias("global_tid"), (u % 2).alias("process_id"),
        F.col("event_id").alias("correlation_id"), (F.col("us") * 1000 - 2000).alias("start_ns"), (F.col("us") * 1000 - 1000).alias("end_ns"),
    )


#: name, every so many seconds, shifted by, seconds long (None: an instant), domain, type of event:
#: days and shifts nest, jobs overlap them and each other, phases lie in another domain, which
#: instants of the creating type name.
RANGES = (("day", 86400, 0, 86400, 0, 59), ("shift", 21600, 0, 21600, 0, 59), ("job", 21600, 10800, 36000, 0, 60), ("phase", 43200, 0, 43200, 1, 71), ("train", 86400, 0, None, 1, 75))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(((F.col("user_id") % 2) * 16777216 + F.col("user_id") % 4).alias("global_tid"), "us")
    out = None
    for which, (name, step, shift, length, domain, kind) in enumerate(RANGES):
        start = (F.col("us") - F.col("us") % (step * 1000000)) * 1000 + shift * 1000000000
        r = e.select("global_tid", start.alias("start_ns")).distinct()
        tid = F.col("global_tid") % 16777216 + 4 * F.expr("global_tid div 16777216")
        rid = F.expr("start_ns div 1000000000") * 100 + tid * 5 + which
        end = F.lit(None).cast("long") if length is None else F.col("start_ns") + length * 1000000000
        r = r.select(rid.alias("range_id"), "global_tid", F.lit(domain).cast("long").alias("domain_id"), F.lit(name).alias("name"), F.lit(kind).alias("event_type"), "start_ns", end.alias("end_ns"))
        out = r if out is None else out.unionByName(r)
    return out


def point_samples(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "purchase", " [requests]").when(F.col("event_type") == "view", " Requests [ms]").otherwise(" [Throughput %]")
    metric = F.concat("event_type", unit)
    return _events(spark, d).select((F.col("user_id") % 4).alias("type_id"), metric.alias("metric"), (F.col("us") * 1000).alias("ts_ns"), "value", F.col("event_id").alias("row_id"))


def interval_samples(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("us") * 1000
    return _events(spark, d).select((F.col("user_id") % 4).alias("global_id"), (F.col("user_id") % 2).alias("port_id"), F.col("event_type").alias("metric"), start.alias("start_ns"), (start + 60000000000).alias("end_ns"), "value", F.col("event_id").alias("row_id"))


def cpu_samples(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("start_ns"), (F.col("o_custkey") % 8).alias("cpu"), (F.col("o_custkey") % 16).alias("global_tid"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    return x.select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("stack_depth"), F.concat(F.lit("fn"), (F.col("p") % 50).cast("string")).alias("symbol"),
        F.concat(F.lit("/lib/m"), (F.col("q") % 5).cast("string"), F.lit(".so")).alias("module"), (F.col("p") % 7 == 0).alias("unresolved"), (F.col("q") % 2).alias("kernel_mode"),
    )


def sched(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    cpu = (F.col("user_id") + F.floor(n / 3)) % 8  # threads move
    return _events(spark, d).select(cpu.alias("cpu"), F.col("user_id").alias("global_tid"), (F.col("us") * 1000).alias("start_ns"), (n % 2).alias("is_in"), F.col("event_type").alias("state"), F.col("event_id").alias("row_id"))


#: The same tables as DuckDB common table expressions.
SQL = {
    "ev": "SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "spans": """SELECT event_id AS row_id, CASE event_type WHEN 'purchase' THEN 'memcpy' WHEN 'signup' THEN 'memset' WHEN 'error' THEN 'graph' ELSE 'kernel' END AS kind,
        event_type || ':' || CAST(k % 10 AS VARCHAR) AS name, user_id % 2 AS process_id, user_id % 4 - user_id % 2 AS device_id, CAST(1 AS BIGINT) AS context_id, user_id % 16 AS stream_id,
        event_id AS correlation_id, us * 1000 AS start_ns, us * 1000 + CAST(round(value * 100) AS BIGINT) * 600000000 AS end_ns,
        CASE WHEN event_type IN ('purchase', 'signup') THEN k * 1024 END AS bytes, k % 7 AS graph_node_id, user_id % 8 AS graph_id, k % 5 + 1 AS grid_x, k % 3 + 1 AS block_x FROM ev""",
    "contexts": "SELECT DISTINCT device_id, context_id, process_id FROM spans",
    "launches": """SELECT event_id AS row_id, 'api_' || event_type || '_v' || CAST(k % 3 AS VARCHAR) AS name, (user_id % 2) * 16777216 + user_id % 4 AS global_tid, user_id % 2 AS process_id,
        event_id AS correlation_id, us * 1000 - 2000 AS start_ns, us * 1000 - 1000 AS end_ns FROM ev""",
    "ranges": """SELECT start_ns // 1000000000 * 100 + (global_tid % 16777216 + 4 * (global_tid // 16777216)) * 5 + w AS range_id, global_tid, CAST(domain AS BIGINT) AS domain_id, name, event_type, start_ns, start_ns + length * CAST(1000000000 AS BIGINT) AS end_ns
        FROM (SELECT DISTINCT (user_id % 2) * 16777216 + user_id % 4 AS global_tid, (us - us % (step * CAST(1000000 AS BIGINT))) * 1000 + shift * CAST(1000000000 AS BIGINT) AS start_ns, name, length, domain, x.event_type, w
              FROM ev, (VALUES ('day', 86400, 0, 86400, 0, 59, 0), ('shift', 21600, 0, 21600, 0, 59, 1), ('job', 21600, 10800, 36000, 0, 60, 2), ('phase', 43200, 0, 43200, 1, 71, 3), ('train', 86400, 0, NULL, 1, 75, 4))
                AS x(name, step, shift, length, domain, event_type, w))""",
    "point_samples": """SELECT user_id % 4 AS type_id, event_type || CASE event_type WHEN 'purchase' THEN ' [requests]' WHEN 'view' THEN ' Requests [ms]' ELSE ' [Throughput %]' END AS metric, us * 1000 AS ts_ns, value, event_id AS row_id FROM ev""",
    "interval_samples": "SELECT user_id % 4 AS global_id, user_id % 2 AS port_id, event_type AS metric, us * 1000 AS start_ns, us * 1000 + 60000000000 AS end_ns, value, event_id AS row_id FROM ev",
    "cpu_samples": "SELECT o_orderkey AS id, epoch_us(o_orderdate) * 1000 AS start_ns, o_custkey % 8 AS cpu, o_custkey % 16 AS global_tid FROM orders",
    "frames": """SELECT l_orderkey AS id, l_linenumber - 1 AS stack_depth, 'fn' || CAST(p % 50 AS VARCHAR) AS symbol, '/lib/m' || CAST(q % 5 AS VARCHAR) || '.so' AS module, p % 7 = 0 AS unresolved, q % 2 AS kernel_mode
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS q FROM lineitem GROUP BY ALL)""",
    "sched": "SELECT (user_id + nth // 3) % 8 AS cpu, user_id AS global_tid, us * 1000 AS start_ns, nth % 2 AS is_in, event_type AS state, event_id AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM ev)",
}
NEEDS = {"ev": (), "spans": ("ev",), "contexts": ("ev", "spans"), "launches": ("ev",), "ranges": ("ev",), "point_samples": ("ev",), "interval_samples": ("ev",), "cpu_samples": (), "frames": (), "sched": ("ev",)}


def with_tables(names: str, sql: str) -> str:
    """``sql`` after the common table expressions it needs; it may begin with further ones."""
    need = dict.fromkeys(x for n in names.split() for x in (*NEEDS[n], n))
    tables = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    head, sql = f"WITH {tables}", sql.strip()
    if "{TABLES}" in sql:
        return sql.replace("{TABLES}", tables)
    return f"{head}, {sql[5:]}" if sql.startswith("WITH ") else f"{head} {sql}"
