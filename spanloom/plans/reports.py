"""Kernel-report queries over tables adapted from lineitem and part; inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.operators import kernel_reports as R
from spanloom.plans.registry import query
from spanloom.sources import adapters as A
from spanloom.sources import traces
from spanloom.sources.kernel_reports import read_kernel_report
from spanloom.staging import scratch

_T = """WITH i AS (SELECT l_suppkey % 10 AS launch, l_partkey * 16 AS pc, l_returnflag || '_ops.sum' AS counter, CASE WHEN l_linenumber <> 5 THEN l_quantity END AS value FROM lineitem),
  s AS (SELECT p_partkey * 16 AS pc, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS file, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS line FROM part)"""


def _instances(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select((F.col("l_suppkey") % 10).alias("launch"), (F.col("l_partkey") * 16).alias("pc"), F.concat("l_returnflag", F.lit("_ops.sum")).alias("counter"), F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("value"))


def _sass(spark, d):
    p, has = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey") % 10 != 0
    return p.select((F.col("p_partkey") * 16).alias("pc"), F.when(has, F.col("p_brand")).alias("file"), F.when(has, F.col("p_size")).alias("line"))


@query(sql=f"{_T} SELECT file, line, counter, round(sum(value), 2) AS value, count(DISTINCT pc) AS pcs FROM i JOIN (SELECT DISTINCT * FROM s) s USING (pc) WHERE file IS NOT NULL AND value IS NOT NULL GROUP BY ALL")
def a20_source_metrics(spark, d):
    return R.source_metrics(_instances(spark, d), _sass(spark, d)).withColumn("value", F.round("value", 2))


@query(sql=f"{_T} SELECT file, counter, round(sum(value), 2) AS value, count(DISTINCT pc) AS pcs FROM i JOIN (SELECT DISTINCT * FROM s) s USING (pc) WHERE file LIKE 'Brand#1%' AND value IS NOT NULL GROUP BY ALL")
def a20_source_metrics_by_file(spark, d):
    return R.source_metrics(_instances(spark, d), _sass(spark, d), "file", file_glob="Brand#1*").withColumn("value", F.round("value", 2))


#: Counters by line status and return flag, some of which only look like rates; half of all
#: launches have instances outside the listing alone.
_COUNTERS = ("sm__memory_operations.sum", "idc__iterations.sum", "smsp__inst_op_generate.sum", "hit_rate.ratio", "dram__bytes.sum.per_second", "l1tex__hits_pct", "smsp__warps_active.avg", "launch__registers_per_thread",
             "gpc__cycles_elapsed.avg.per_second", "sm__cycles_active.sum.per_second", "foo__elapsed.sum.per_second", "sm__issue_active.sum.per_cycle_active", "sm__sass_branch_targets.sum.per_second")
_SKIP = f"""m AS (SELECT DISTINCT l_suppkey % 10 AS launch, v.counter FROM lineitem, (VALUES {', '.join(f"('{c}')" for c in _COUNTERS)}) v(counter))"""


def _named(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 10).alias("launch")).distinct()
    return m.select("launch", F.explode(F.array(*[F.lit(c) for c in _COUNTERS])).alias("counter"))


@query(sql=f"""WITH {_SKIP} SELECT launch, counter, CASE WHEN launch % 2 = 1 THEN 'not-a-source-counter' ELSE 'non-additive-rollup' END AS reason FROM m
  WHERE launch % 2 = 1 OR counter NOT IN ('sm__memory_operations.sum', 'idc__iterations.sum', 'smsp__inst_op_generate.sum')""")
def a21_skipped_counters(spark, d):
    m = _named(spark, d)
    i = m.withColumn("placement", F.when(F.col("launch") % 2 == 1, "out_of_cubin").otherwise("attributed"))
    return R.skipped_counters(m, i)


@query(sql="""SELECT l_returnflag || '|' || l_linestatus AS id, count(*) AS n, 'percent' AS pct, 'hertz' AS cycles, 'inst_per_cycle' AS inst, 'byte' AS bytes, 'nsecond' AS time FROM lineitem GROUP BY ALL""")
def a21_metric_units(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("id")).agg(F.count("*").alias("n"))
    of = lambda pattern, name: N.metric_unit(F.concat(F.substring("id", 1, 1), F.lit(pattern))).alias(name)
    return li.select("id", "n", of("x__hits.pct", "pct"), of(".gpc__cycles_elapsed.avg.per_second", "cycles"), of(".Triage.sm__inst_executed.avg.per_cycle_active", "inst"), of("x__t_bytes.sum", "bytes"), of("pu__time_duration.sum", "time"))


@query(sql=f"""{_T} SELECT counter, round(sum(value), 2) AS total, round(sum(CASE WHEN file IS NOT NULL THEN value ELSE 0 END), 2) AS attributed,
  round(sum(CASE WHEN s.pc IS NOT NULL AND file IS NULL THEN value ELSE 0 END), 2) AS unattributed, round(sum(CASE WHEN s.pc IS NULL THEN value ELSE 0 END), 2) AS outside FROM i LEFT JOIN s ON i.pc = s.pc GROUP BY counter""")
def a22_reconcile(spark, d):
    out = R.reconcile(_instances(spark, d), _sass(spark, d))
    return out.select("counter", *[F.round(c, 2).alias(c) for c in ("total", "attributed", "unattributed", "outside")])


@query(sql=f"{_T} SELECT launch, counter, round(sum(value), 2) AS value FROM i WHERE counter LIKE 'A%' OR counter LIKE '%R\\_ops%' ESCAPE '\\' GROUP BY ALL")
def a18_kernel_metrics(spark, d):
    m = _instances(spark, d).groupBy("launch", "counter").agg(F.sum("value").alias("value"))
    return R.kernel_metrics(m, "A*, *R_ops*").withColumn("value", F.round("value", 2))


@query(sql=f"{_T}, m AS (SELECT launch, counter, round(sum(value), 2) AS value FROM i GROUP BY ALL) SELECT launch, max(value) FILTER (counter = 'A_ops.sum') AS a, max(value) FILTER (counter = 'N_ops.sum') AS n FROM m GROUP BY launch")
def a19_kernel_metrics_wide(spark, d):
    m = _instances(spark, d).groupBy("launch", "counter").agg(F.round(F.sum("value"), 2).alias("value"))
    return R.kernel_metrics_wide(m, "*").select("launch", F.col("values")["A_ops.sum"].alias("a"), F.col("values")["N_ops.sum"].alias("n"))


@query(sql="SELECT l_shipdate IS NULL AS x, l_linestatus AS reason, count(*) AS samples FROM lineitem GROUP BY ALL")
def a23_warp_stalls(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    s = li.select(F.col("l_shipdate").isNull().alias("x"), F.col("l_linestatus").alias("reason"), F.lit(1).alias("samples"))
    return R.warp_stalls(s, "reason").select(F.lit(False).alias("x"), "reason", "samples")


@query(sql=f"{_T} SELECT file, line, string_agg(CAST(pc AS VARCHAR), ',' ORDER BY pc) AS pcs FROM (SELECT DISTINCT * FROM s) WHERE file IS NOT NULL GROUP BY ALL")
def q15_sass_listing(spark, d):
    return R.sass_listing(_sass(spark, d)).withColumn("pcs", F.array_join(F.transform("pcs", lambda x: x.cast("string")), ","))


@query("spans contexts", "SELECT device_id, string_agg(CAST(process_id AS VARCHAR), ',' ORDER BY process_id) AS processes, count(*) AS scopes FROM contexts GROUP BY device_id")
def a28_inventory(spark, d):
    return traces.inventory(A.contexts(spark, d))


@query("spans contexts ev", """WITH m AS (SELECT DISTINCT v.key, CAST(user_id % v.n AS VARCHAR) AS value FROM ev, (VALUES ('LOCAL_RANK', 4), ('RANK', 8), ('HOME', 3), ('OMPI_COMM_WORLD_RANK', 2)) v(key, n)),
  l AS (SELECT string_agg(key || '=' || value, ',' ORDER BY key || '=' || value) AS labels FROM m WHERE key <> 'HOME')
  SELECT device_id, string_agg(CAST(process_id AS VARCHAR), ',' ORDER BY process_id) AS processes, count(*) AS scopes, any_value(labels) AS labels FROM contexts, l GROUP BY device_id""")
def a28_inventory_labels(spark, d):
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("n")) for k, n in (("LOCAL_RANK", 4), ("RANK", 8), ("HOME", 3), ("OMPI_COMM_WORLD_RANK", 2))])
    m = A._events(spark, d).select("user_id", F.explode(keys).alias("v")).select("v.key", (F.col("user_id") % F.col("v.n")).cast("string").alias("value")).distinct()
    return traces.inventory(A.contexts(spark, d), m)


@query(sql="SELECT c_name AS entity, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer")
def a29_hardware(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    kv = c.select(F.col("c_name").alias("entity"), F.explode(F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))).alias("key", "value"))
    return traces.hardware(kv, ["nation", "segment"])


@query("spans", "SELECT s.row_id, coalesce(p.p_name, s.name, '<anonymous kernel>') AS name FROM spans s LEFT JOIN part p ON s.row_id = p.p_partkey")
def j1_resolve_names(spark, d):
    s = A.spans(spark, d).select("row_id", F.col("row_id").alias("demangled_id"), F.col("name").alias("own"))
    strings = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return traces.resolve_names(s, strings, ("demangled_id",), "?").select("row_id", F.when(F.col("name") == "?", F.col("own")).otherwise(F.col("name")).alias("name"))


@query("spans", "SELECT kind, row_id, coalesce(bytes, -1) AS bytes FROM spans")
def s3_u1_gpu_spans(spark, d):
    s = A.spans(spark, d)
    tables = {k: s.filter(F.col("kind") == k).drop("kind") for k in ("kernel", "memcpy", "memset", "graph")}
    tables["kernel"] = tables["kernel"].drop("bytes")
    return traces.gpu_spans(tables).select("kind", "row_id", F.coalesce("bytes", F.lit(-1)).alias("bytes"))


#: A kernel report per return flag as it is written and read: launches, instances, instructions.
_R = """li AS (SELECT l_suppkey AS supp, l_returnflag AS flag, l_orderkey % 10 AS launch, l_partkey AS part, l_quantity AS q, l_linestatus AS reason, 'k' || l_returnflag || ':' || CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_orderkey % 10 AS VARCHAR) AS name FROM lineitem),
  la AS (SELECT supp, flag, launch, name, CAST(sum(q) AS BIGINT) AS ops, count(*) AS samples, count(*) FILTER (part % 13 = 0) AS outside FROM li GROUP BY ALL),
  sa AS (SELECT DISTINCT launch, name, part * 16 AS pc, 'OP' || CAST(part % 5 AS VARCHAR) AS opcode, CASE WHEN part % 10 <> 0 THEN 'f' || CAST(part % 3 AS VARCHAR) || '.cu' END AS file, CASE WHEN part % 10 <> 0 THEN part % 50 END AS line FROM li WHERE launch <> 9)"""


def report(spark, d):
    """Writes one JSON report a supplier, several a file, and reads them: with more data there are more
    reports, not larger ones."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    li = li.select(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 10).alias("launch"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("reason"))
    li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "supp")  # the only shuffle; a file each, however small
    part, launch = F.col("part"), F.col("launch")
    text = lambda c: c.cast("string")
    source = F.when(part % 10 != 0, F.struct(F.concat(F.lit("f"), text(part % 3), F.lit(".cu")).alias("file"), (part % 50).alias("line")))
    instance = lambda q: F.struct((part * 16).alias("rel_address"), q["q"].cast("double").alias("value"), F.when(part % 13 == 0, "out_of_cubin").otherwise("attributed").alias("placement"))
    sass = F.struct((part * 16).alias("address"), F.concat(F.lit("OP"), text(part % 5)).alias("opcode"), F.lit("").alias("operands"), source.alias("source"))
    by_part = li.groupBy("supp", "flag", "launch", "part", "reason").agg(F.count("*").alias("n"), F.sum("q").alias("ops"), F.collect_list(F.struct("q")).alias("q"))
    by_part = by_part.groupBy("supp", "flag", "launch", "part").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reasons"), F.sum("n").alias("n"), F.sum("ops").alias("ops"), F.flatten(F.collect_list("q")).alias("q"))
    pcs = F.collect_list(F.when(part % 13 != 0, F.struct((part * 16).alias("rel_address"), source.alias("source"), "reasons")))
    g = by_part.groupBy("supp", "flag", "launch").agg(
        F.sum("ops").cast("double").alias("ops"), F.array_sort(F.flatten(F.collect_list(F.transform("q", instance)))).alias("instances"), F.collect_set(F.when(launch != 9, sass)).alias("disasm"),
        F.sum("n").alias("samples"), F.sum(F.when(part % 13 == 0, F.col("n")).otherwise(0)).alias("outside"), pcs.alias("pcs"),
    )
    metric = lambda name, unit, value, kind, rollup, instances: F.struct(F.lit(name).alias("name"), F.lit(unit).alias("unit"), value.alias("value"), F.lit(kind).alias("metric_type"), F.lit(rollup).alias("rollup"), instances.alias("instances"))
    none = F.slice("instances", 1, 0)
    metrics = F.array(metric("smsp__ops.sum", "inst", F.col("ops"), "counter", "sum", F.col("instances")), metric("hits.pct", "%", F.col("samples").cast("double"), "other", None, F.col("instances")), metric("device__attribute_compute_capability_minor", "", F.lit(0.0), "other", None, none))
    metrics = F.when(launch % 4 == 3, metrics).otherwise(F.concat(metrics, F.array(metric("device__attribute_compute_capability_major", "", F.lit(9.0), "other", None, none))))
    rules = F.transform(F.sequence(F.lit(0), launch % 3), lambda i: F.struct(F.concat(F.lit("rule"), text(i)).alias("name"), F.lit("m").alias("message")))
    stalls = F.struct((F.col("samples") + F.when(launch % 5 == 4, 1).otherwise(0)).alias("total_samples"), F.col("outside").alias("out_of_cubin_samples"), "pcs")
    one = F.struct(
        F.concat(F.lit("k"), "flag", F.lit(":"), text(F.col("supp")), F.lit(":"), text(launch)).alias("kernel_demangled"), F.array(launch + 1, F.lit(1), F.lit(1)).alias("grid_size"), F.array(F.lit(32), F.lit(1), F.lit(1)).alias("block_size"), launch.alias("stream_id"),
        metrics.alias("metrics"), rules.alias("rules"), "disasm", stalls.alias("warp_stalls"),
    )
    docs = g.groupBy("supp").agg(F.collect_list(one).alias("launches")).select("launches", F.array(F.struct(F.concat(F.lit("range "), text(F.col("supp"))).alias("name"))).alias("ranges"), F.array().cast("array<struct<name:string>>").alias("graphs"))
    path = scratch(spark, "report")
    docs.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    return read_kernel_report(spark, path, multi_line=False)


def _named_launches(t):
    return t["launches"].select("report", "launch", "name")


@query(sql=f"WITH {_R} SELECT count(*) AS launches, CAST(sum(CASE WHEN launch % 4 = 3 THEN 3 ELSE 4 END) AS BIGINT) AS metrics, CAST(sum(launch % 3 + 1) AS BIGINT) AS rules, count(*) FILTER (launch <> 9) AS listed_launches, count(DISTINCT supp) AS ranges, 0 AS graphs FROM la")
def a24_s8_report_summary(spark, d):
    return R.report_summary(report(spark, d))


@query(sql=f"WITH {_R} SELECT name, launch + 1 AS grid_x, 32 AS block_x, launch AS stream_id, CASE WHEN launch % 4 = 3 THEN 3 ELSE 4 END AS n_metrics, launch % 3 + 1 AS n_rules FROM la WHERE launch + 1 >= 4")
def q11_launches_listing(spark, d):
    return R.launches_listing(report(spark, d)["launches"], N.match_dims("block", "32x1x1") & (F.col("grid_x") >= 4)).select("name", "grid_x", "block_x", "stream_id", "n_metrics", "n_rules")


@query(sql=f"WITH {_R} SELECT DISTINCT 'range ' || CAST(supp AS VARCHAR) AS name, 'range' AS kind FROM la")
def q12_workloads(spark, d):
    return report(spark, d)["workloads"].select("w.name", "kind")


@query(sql=f"WITH {_R} SELECT name, CASE WHEN launch % 4 <> 3 THEN 'sm_90' ELSE '' END AS sm, launch <> 9 AS has_listing FROM la")
def q13_cubins(spark, d):
    t = report(spark, d)
    c = R.cubins(t["launches"], t["metrics"]).join(_named_launches(t), ["report", "launch"])
    return c.select("name", F.coalesce("sm", F.lit("")).alias("sm"), "has_listing")


@query(sql=f"""WITH {_R} SELECT name, CASE WHEN launch % 4 = 3 THEN '' ELSE 'device__attribute_compute_capability_major=9,' END || 'device__attribute_compute_capability_minor=0,hits.pct=' || CAST(samples AS VARCHAR) || ',smsp__ops.sum=' || CAST(ops AS VARCHAR) AS metrics,
  CASE launch % 3 WHEN 0 THEN 'rule0' WHEN 1 THEN 'rule0,rule1' ELSE 'rule0,rule1,rule2' END AS rules, true AS found FROM la UNION ALL SELECT '', '', '', false""")
def q14_inspect_launches(spark, d):
    t = report(spark, d)
    ids = t["launches"].select("report", "launch").unionByName(spark.createDataFrame([("no such report", 0)], "report string, launch int"))
    out = R.inspect_launches(ids, t["launches"], t["metrics"])
    said = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return out.select(F.coalesce("name", F.lit("")).alias("name"), said("metrics", lambda m: F.concat_ws("=", m["counter"], m["value"].cast("long"))).alias("metrics"), said("rules", lambda r: r["name"]).alias("rules"), "found")


@query(sql=f"WITH {_R} SELECT name, count(*) AS instructions, string_agg(CAST(pc AS VARCHAR) || ':' || opcode || coalesce(':' || file || ':' || CAST(line AS VARCHAR), ''), ',' ORDER BY pc) AS listing FROM sa GROUP BY name")
def q15_launch_sass(spark, d):
    t = report(spark, d)
    s = R.launch_sass(t["sass"]).join(_named_launches(t), ["report", "launch"])
    return s.select("name", "instructions", F.array_join(F.transform("listing", lambda x: F.concat_ws(":", x["pc"], x["opcode"], x["file"], x["line"])), ",").alias("listing"))


@query(sql=f"WITH {_R} SELECT name, samples + CASE WHEN launch % 5 = 4 THEN 1 ELSE 0 END AS total_samples, samples - outside AS listed, outside AS out_of_cubin_samples, launch % 5 <> 4 AS agrees FROM la")
def a23_stall_identity(spark, d):
    t = report(spark, d)
    return R.stall_identity(t["launches"], t["stalls"]).join(_named_launches(t), ["report", "launch"]).drop("report", "launch")


@query(sql=f"WITH {_R} SELECT CASE WHEN part % 10 <> 0 THEN 'f' || CAST(part % 3 AS VARCHAR) || '.cu' ELSE '' END AS file, CASE WHEN part % 10 <> 0 THEN part % 50 ELSE -1 END AS line, reason, count(*) AS samples FROM li WHERE part % 13 <> 0 GROUP BY ALL")
def a23_stalls_by_line(spark, d):
    return R.warp_stalls(report(spark, d)["stalls"], "line").fillna("", ["file"]).fillna(-1, ["line"])


@query(sql=f"WITH {_R} SELECT part * 16 AS pc, reason, count(*) AS samples FROM li WHERE part % 13 <> 0 GROUP BY ALL")
def a23_stalls_by_address(spark, d):
    return R.warp_stalls(report(spark, d)["stalls"], "sass")


@query(sql=f"WITH {_R} SELECT s.name, s.file, s.line, 'smsp__ops.sum' AS counter, round(sum(q), 2) AS value, count(DISTINCT pc) AS pcs FROM li JOIN sa s ON li.name = s.name AND li.part * 16 = s.pc WHERE s.file IS NOT NULL AND part % 13 <> 0 GROUP BY ALL")
def a20_source_metrics_by_launch(spark, d):
    t = report(spark, d)
    m = R.source_metrics(t["instances"], t["sass"], "line", on=("report", "launch", "pc")).join(_named_launches(t), ["report", "launch"])
    return m.select("name", "file", "line", "counter", F.round("value", 2).alias("value"), "pcs")


@query(sql=f"WITH {_R} SELECT name, part * 16 AS pc, counter, round(min(q), 2) AS value FROM li, (VALUES ('smsp__ops.sum'), ('hits.pct')) v(counter) WHERE part % 13 <> 0 GROUP BY ALL")
def a20_source_metrics_by_address(spark, d):
    t = report(spark, d)
    m = R.source_metrics(t["instances"], t["sass"], "sass", on=("report", "launch", "pc")).join(_named_launches(t), ["report", "launch"])
    return m.select("name", "pc", "counter", F.round("value", 2).alias("value"))


# -- trace folders -----------------------------------------------------------------------------


@query("spans", "SELECT kind, row_id, start_ns, CASE WHEN kind = 'memcpy' THEN bytes ELSE -1 END AS bytes FROM spans WHERE kind IN ('kernel', 'memcpy')")
def s1_load_trace(spark, d):
    s, path = A.spans(spark, d), scratch(spark, "trace")
    s.filter("kind = 'kernel'").drop("kind", "bytes").write.parquet(f"{path}/kernel.parquet")
    s.filter("kind = 'memcpy'").drop("kind").write.parquet(f"{path}/memcpy.parquet")
    t = traces.load_trace(spark, path, {k: "row_id long, start_ns long, bytes long" for k in ("kernel", "memcpy", "memset")})
    return traces.gpu_spans(t).select("kind", "row_id", "start_ns", "bytes").fillna(-1, ["bytes"])


@query("spans", "SELECT kind, count(*) AS n, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM spans GROUP BY kind")
def s9_materialize(spark, d):
    t = traces.materialize(A.spans(spark, d), scratch(spark, "derived"), ("kind",))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))


@query("spans", """SELECT row_id, process_id AS "at.process", device_id AS "at.device", kind AS "tags.kind", '[' || CAST(start_ns AS VARCHAR) || ',' || CAST(end_ns AS VARCHAR) || ']' AS times FROM spans""")
def s10_flatten(spark, d):
    s = A.spans(spark, d).select("row_id", F.struct(F.col("process_id").alias("process"), F.col("device_id").alias("device")).alias("at"), F.create_map(F.lit("kind"), F.col("kind")).alias("tags"), F.array("start_ns", "end_ns").alias("times"))
    return traces.flatten_for_csv(s, {"tags": ["kind"]})
