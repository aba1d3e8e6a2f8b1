"""Chrome-format traces: JSON with ``traceEvents`` into typed events, arguments and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.json_splits import read_listed_objects
from spanloom.sources.kernel_reports import document_id
from spanloom.staging import stage

EVENT = "name string, cat string, ph string, ts double, dur double, pid string, tid string, id string, args map<string,string>"
HEADER = "distributedInfo struct<rank:long>"
SCHEMA = f"traceEvents array<struct<{', '.join(c.replace(' ', ':', 1) for c in EVENT.split(', '))}>>, {HEADER}, odd string"


def coalesce_args(args: str | Column, *aliases: str, kind: str = "string") -> Column:
    """First argument present under any of the aliases; null where it has another type."""
    c = F.col(args) if isinstance(args, str) else args
    got = F.coalesce(*[F.try_element_at(c, F.lit(a)) for a in aliases])
    return got if kind == "string" else got.try_cast(kind)


#: Kinds of work by what their category contains, first match first (fixed values).
CATEGORIES = (("kernel", "kernel"), ("memcpy", "memcpy"), ("memset", "memset"), ("cuda_runtime", "runtime"), ("cuda_driver", "driver"), ("user_annotation", "annotation"), ("python", "python"), ("memory", "memory"))
#: Kinds of collectives by what a name contains, first match first (fixed values).
COLLECTIVES = (
    ("all_reduce", ("all_reduce", "allreduce")), ("all_gather", ("all_gather", "allgather")), ("reduce_scatter", ("reduce_scatter", "reducescatter")), ("broadcast", ("broadcast",)),
    ("barrier", ("barrier",)), ("send", ("send",)), ("recv", ("recv", "receive")),
)


def _low(name: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))


def _keys(args: Column) -> Column:
    return F.coalesce(F.map_keys(args), F.array().cast("array<string>"))


def is_comm(name: str, cat: str, args: str | Column | None = None) -> Column:
    """Whether an event communicates: by name, category, an argument called something with
    ``comm``, or one whose value speaks of the library."""
    told = _low(name).rlike("c10d::|record_param_comms|nccl") | _low(cat).contains("communication")
    if args is None:
        return told
    a = F.col(args) if isinstance(args, str) else args
    values = F.coalesce(F.map_values(a), F.array().cast("array<string>"))
    return told | F.exists(_keys(a), lambda k: _low(k).contains("comm")) | F.exists(values, lambda v: _low(v).contains("nccl"))


def event_type(name: str, cat: str, args: str | Column | None = None, comm: Column | None = None) -> Column:
    """Kind of work: a step by name, a device kernel by name or category, else by category, by
    the arguments of memory events and host operators, or ``comm``; all else is a host operator."""
    c, n = _low(cat), _low(name)
    a = None if args is None else F.col(args) if isinstance(args, str) else args
    has = lambda *keys: F.lit(False) if a is None else F.arrays_overlap(_keys(a), F.array(*[F.lit(k) for k in keys]))
    kind = F.when(n.startswith("profilerstep#"), "step").when(n.startswith("nccldevkernel"), "kernel")
    for part, what in CATEGORIES:
        kind = kind.when(c.contains(part), what)
    kind = kind.when(has("Device Type", "Total Allocated"), "memory").when(c.contains("cpu_op") | has("External id"), "cpu_op")
    return kind.when(is_comm(name, cat, args) if comm is None else comm, "comm").otherwise("cpu_op")


def collective_kind(name: str) -> Column:
    """Which collective a name speaks of, else ``unknown``."""
    n = _low(name)
    kind = None
    for what, parts in COLLECTIVES:
        test = n.rlike("|".join(parts))
        kind = F.when(test, what) if kind is None else kind.when(test, what)
    return kind.otherwise("unknown")


def _pieces(spark: SparkSession, paths: list[str], between: str) -> DataFrame:
    """Files whose events are written with the same text between any two, cut there: trace, rank
    of the header, e. Many tasks read one file."""
    raw = spark.read.option("lineSep", between).text(paths).withColumn("trace", F.input_file_name())
    head = F.regexp_extract("value", r'"distributedInfo"\s*:\s*\{[^{}]*"rank"\s*:\s*([0-9]+)', 1)
    ranks = raw.filter(head != "").groupBy("trace").agg(F.max(head.cast("long")).alias("rank"))
    body = F.regexp_replace("value", r'(?s)^.*"traceEvents"\s*:\s*\[\s*\{', "")
    e = raw.select("trace", F.from_json(F.concat(F.lit("{"), body, F.lit("}")), EVENT).alias("e"))
    return e.join(ranks, "trace", "left").select("trace", "rank", "e")


def read_chrome_trace(spark: SparkSession, *paths: str, multi_line: bool = True, between: str | None = None, split: bool = False) -> DataFrame:
    """Typed events of all files (.json, .json.gz). Entries that aren't objects or have no
    ``ts`` are skipped; times become nanoseconds; rank comes from the event's arguments, the
    file's header or the file's name, in that order. ``row_id`` is written once and stays.

    A JSON document is parsed by one task that holds it, so files should stay below a few
    hundred MB each in the usual form. Larger ones are read by many tasks with ``split``, whatever
    their layout (``sources.json_splits``, two passes over the text), or in one pass if their
    events are written alike: ``between`` is the text that ends one event and begins the next,
    ``"\\n  },\\n  {"`` as the profiler writes them."""
    if split:
        raw = read_listed_objects(spark, *paths).select("trace", "rank", F.from_json("text", EVENT).alias("e"))
    elif between is None:
        raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "odd").json(list(paths))
        raw = raw.withColumn("trace", document_id(raw, multi_line))
        # an entry that is no object voids the others of its document, whose entries are then taken one by one
        again = F.from_json("odd", f"traceEvents array<string>, {HEADER}")
        events = F.coalesce("traceEvents", F.transform(again["traceEvents"], lambda x: F.from_json(x, EVENT)))
        raw = raw.select("trace", F.coalesce("distributedInfo.rank", again["distributedInfo"]["rank"]).alias("rank"), F.explode(events).alias("e"))
    else:
        raw = _pieces(spark, list(paths), between)
    e = raw.filter("e.ts is not null")
    in_name = F.regexp_extract("trace", r"rank[_-]?(\d+)", 1)
    ns = lambda c: F.floor(c) * 1000 + F.round((c - F.floor(c)) * 1000).cast("long")  # noqa: E731  exact for whole microseconds
    start = ns(F.col("e.ts"))
    text = lambda *a: coalesce_args("e.args", *a)
    arg = lambda *a: coalesce_args("e.args", *a, kind="long")
    e = e.select(
        "trace", F.coalesce("e.name", F.lit("unknown")).alias("name"), F.col("e.cat").alias("cat"), F.col("e.ph").alias("ph"), start.alias("start_ns"), (start + ns(F.coalesce("e.dur", F.lit(0.0)))).alias("end_ns"),
        F.col("e.pid").alias("pid"), F.col("e.tid").alias("tid"), F.col("e.id").alias("flow_id"), F.coalesce(arg("rank", "Rank", "global rank"), "rank", F.when(in_name != "", in_name.cast("long"))).alias("rank"),
        arg("device", "device_id", "Device Id", "device id", "Device", "cuda device").alias("device"), arg("stream", "stream_id", "Stream Id", "stream id").alias("stream"),
        arg("External id", "external id", "external_id", "externalId", "External ID", "External Id").alias("external_id"), arg("correlation", "Correlation", "correlation id", "Correlation ID", "correlationId", "correlation_id").alias("correlation"),
        arg("Python id", "Python ID", "python_id").alias("python_id"), arg("Python parent id", "Python Parent ID", "python_parent_id").alias("python_parent"), arg("step", "Profiler Step", "profiler_step").alias("own_step"),
        arg("bytes", "Bytes", "Num Bytes", "num_bytes").alias("bytes"), text("Input Dims", "Input dims", "Input Shapes", "Input shapes", "input_shapes", "shape").alias("shape"), F.col("e.args").alias("args"),
    )
    e = e.withColumn("comm", is_comm("name", "cat", "args"))
    e = e.withColumns({"type": event_type("name", "cat", "args", F.col("comm")), "collective": F.when(F.col("comm"), collective_kind("name"))})
    number = F.regexp_extract("name", r"^ProfilerStep#\s*(-?[0-9]+)\s*$", 1).try_cast("long")
    e = e.withColumn("step_no", F.when(F.col("type") == "step", number).otherwise(F.col("own_step"))).drop("own_step")
    return stage(e.withColumn("row_id", F.monotonically_increasing_id()), "chrome_events")


def explode_args(events: DataFrame) -> DataFrame:
    """Arguments as rows: row_id, arg_key, arg_json."""
    return events.select("row_id", F.explode("args").alias("arg_key", "arg_json"))


#: Columns that arguments fill, for the survey of how many events have them.
TYPED = ("rank", "device", "stream", "external_id", "correlation", "step_no", "bytes", "shape")


def schema_survey(events: DataFrame) -> DataFrame:
    """(what, value, n): counts by phase, category, type and argument (markers of flows count as
    type ``flow``), and how many events have each of the typed columns."""
    marker = F.col("ph").isin("s", "t", "f") & F.col("flow_id").isNotNull() if "flow_id" in events.columns else F.lit(False)
    e = events.withColumn("type", F.when(marker, "flow").otherwise(F.col("type")))
    parts = [e.groupBy(F.lit(w).alias("what"), F.coalesce(F.col(c), F.lit("(missing)")).alias("value")).agg(F.count("*").alias("n")) for w, c in (("phase", "ph"), ("category", "cat"), ("type", "type"))]
    parts.append(explode_args(events).groupBy(F.lit("argument").alias("what"), F.col("arg_key").alias("value")).agg(F.count("*").alias("n")))
    there = [F.struct(F.lit(c).alias("value"), F.count(F.col(c)).alias("n")) for c in TYPED if c in events.columns]
    parts.append(e.filter("type <> 'flow'").agg(F.array(*there).alias("t")).select(F.lit("typed").alias("what"), F.explode("t").alias("t")).select("what", "t.value", "t.n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capabilities(events: DataFrame) -> DataFrame:
    """One row of what a trace holds: runtime and driver calls, device work, memory, Python frames
    and their stacks, communication, steps, flows, and how many ranks and devices."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    of = lambda t: some(F.col("type") == t)
    gpu = F.col("type").isin("kernel", "memcpy", "memset")
    return events.agg(
        F.count("*").alias("events"), of("runtime").alias("has_runtime"), of("driver").alias("has_driver"), some(gpu).alias("has_gpu"), of("memory").alias("has_memory"), of("python").alias("has_python"),
        some((F.col("type") == "python") & F.col("python_id").isNotNull()).alias("has_python_stack"), some(F.col("comm")).alias("has_comm"), of("step").alias("has_steps"),
        some(F.col("ph").isin("s", "t", "f") & F.col("flow_id").isNotNull()).alias("has_flows"), F.countDistinct("rank").alias("ranks"), F.array_sort(F.collect_set(F.when(gpu, F.col("device")))).alias("devices"),
    )
