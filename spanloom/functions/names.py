"""Column expressions on names, ids and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_glob(col: str | Column, pattern: str) -> Column:
    """``*`` any run, ``?`` one character; everything else stands for itself."""
    c = F.col(col) if isinstance(col, str) else col
    for ch in "\\%_":
        pattern = pattern.replace(ch, "\\" + ch)
    return c.like(pattern.replace("*", "%").replace("?", "_"))


def name_regex(col: str | Column, pattern: str) -> Column:
    """Unanchored; expressions are the JVM's."""
    return (F.col(col) if isinstance(col, str) else col).rlike(pattern)


def any_glob(col: str | Column, patterns: str) -> Column:
    """Any of the comma-separated globs; all rows if there is none."""
    globs = [p.strip() for p in patterns.split(",") if p.strip()]
    return reduce(lambda a, b: a | b, [name_glob(col, p) for p in globs]) if globs else F.lit(True)


def fold_version(col: str | Column) -> Column:
    """Versioned API names as one: a trailing ``_v`` and digits go."""
    return F.regexp_replace(col, r"_v[0-9]+$", "")


def pid_of(global_tid: str) -> Column:
    return F.shiftright(global_tid, 24).bitwiseAND(F.lit(0xFFFFFF))


def tid_of(global_tid: str) -> Column:
    return F.col(global_tid).bitwiseAND(F.lit(0xFFFF))


def host_of(global_id: str) -> Column:
    return F.shiftrightunsigned(global_id, 48)


def path_part(col: str | Column) -> Column:
    """A name as one part of a ``/``-joined path."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))


def basename(col: str | Column) -> Column:
    return F.regexp_extract(col, r"[^/\\]*$", 0)


def unit_of(metric: str | Column) -> Column:
    """The bracketed unit at the end of a metric's name; null without one."""
    found = F.regexp_extract(metric, r"\[([^\]]*)\]\s*$", 1)
    return F.when(found != "", found)


def range_style(event_type: str | Column) -> Column:
    t = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.when(t.isin(59, 70), "push_pop").when(t.isin(60, 71), "start_end").otherwise("unknown")


def at(process: int | None = None, device: int | None = None, stream: int | None = None) -> Column:
    """Location test; host rows have null locations and never match a named one."""
    tests = [F.col(c) == v for c, v in (("process_id", process), ("device_id", device), ("stream_id", stream)) if v is not None]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def match_dims(column: str, want: str) -> Column:
    """``WxHxD`` against a struct x, y, z or three columns ``<column>_x`` ...; 0 matches all."""
    dims = [int(v) for v in want.lower().split("x")]
    tests = [F.col(f"{column}_{a}") == v for a, v in zip("xyz", dims, strict=False) if v]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


#: What a counter's name says of the unit it counts, first match first (fixed values).
COUNTED = (
    (r"^launch__block_dim_[xyz]$|^launch__occupancy_limit_(blocks|registers|shared_mem|warps)$", "block"), (r"^launch__registers_per_thread(_allocated)?$", "register_per_thread"),
    (r"^launch__shared_mem_config_size$", "byte"), (r"^launch__shared_mem_per_block(_allocated|_driver|_dynamic|_static)?$", "byte_per_block"), (r"^launch__thread_count$", "thread"),
    (r"pmsampler_(dropped|merged)_samples", "sample"), (r"replayer_passes|pcsamp_aggregated_passes", "pass"), (r"branch_targets|pcsamp_warps_issue_stalled_branch_resolving", "branches"),
    (r"bytes|_byte$", "byte"), (r"sectors|_sector", "sector"), (r"requests|_request", "request"), (r"cycles|_cycle", "cycle"), (r"warps|_warp", "warp"), (r"__inst|^inst_|_inst_|_inst$", "inst"), (r"threads|_thread", "thread"),
)
#: Units of a rate by what it counts; a count that isn't listed has no unit as a rate (fixed values).
A_SECOND = {"cycle": "hertz", "byte": "byte_per_second", "sector": "sector_per_second", "request": "request_per_second", "inst": "inst_per_second", "warp": "warp_per_second", "thread": "thread_per_second"}
A_CYCLE = {"warp": "warp", "byte": "byte_per_cycle", "sector": "sector_per_cycle", "inst": "inst_per_cycle", "thread": "thread_per_cycle"}
PERCENT, RATE, EXTREME = r"\.pct$|\.pct_|_pct$|_pct_", r"\.(per_second|per_cycle_active|per_cycle_elapsed|peak_sustained)$", r"\.(ratio|avg|max|min)$"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unit_map(units: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in units.items() for x in kv])


def metric_unit(metric: str | Column) -> Column:
    """The unit that a hardware counter's name implies; null where it implies none. Labels of
    units before the counter proper (up to the first part that looks like one) don't count."""
    sustained = {k: v for k, v in A_CYCLE.items() if k != "thread"}

    def rated(name: Column, counted: Column) -> Column:
        rate = F.regexp_extract(name, RATE, 1)
        of = lambda units: F.try_element_at(_unit_map(units), counted)
        by_rate = F.when(rate == "per_second", of(A_SECOND)).when(rate.startswith("per_cycle"), of(A_CYCLE)).when(rate == "peak_sustained", F.coalesce(of(sustained), counted)).otherwise(counted)
        return F.when(name.rlike(PERCENT), "percent").when(name.rlike(r"__time_duration\.sum$|_interval_time$"), "nsecond").otherwise(by_rate)

    def proper(name: Column) -> Column:
        counted = lambda stem: F.coalesce(*[F.when(stem.rlike(p) & ~stem.startswith("device__attribute_"), u) for p, u in COUNTED])
        return _let(_let(F.regexp_replace(name, RATE, ""), counted), lambda c: rated(name, c))

    whole = F.col(metric) if isinstance(metric, str) else metric
    part = r"(?:^|\.)((?:[^.]*__[^.]*|inst_[^.]*|thread_inst[^.]*|memory_[^.]*)(?:\..*)?)$"
    return _let(F.coalesce(F.nullif(F.regexp_extract(whole, part, 1), F.lit("")), whole), proper)


def is_additive(metric: str | Column, metric_type: str | Column | None = None, subtype: str | Column | None = None, rollup: str | Column | None = None) -> Column:
    """Whether a counter may be summed over instances. What the report says of it comes first:
    percentages, ratios and rates by type or subtype may not, a counter may if it rolls up as a
    sum. Else its name decides: percentages, rates (by the name's end, or a unit per something or
    in hertz), ratios, means and extremes may not."""
    c = F.col(metric) if isinstance(metric, str) else metric
    unit = metric_unit(c)
    per = c.rlike(r"\.(per_second|per_cycle_active|per_cycle_elapsed)$") | F.coalesce(unit.contains("per_") | (unit == "hertz"), F.lit(False))
    by_name = ~(c.rlike(PERCENT) | per | c.rlike(EXTREME))
    if metric_type is None:
        return by_name
    kind, sub, how = (F.lower(F.col(x) if isinstance(x, str) else F.lit(None).cast("string") if x is None else x) for x in (metric_type, subtype, rollup))
    told = F.when(sub.isin("pct", "ratio", "per_second"), False).when(kind.isin("ratio", "throughput"), False).when((kind == "counter") & how.isNotNull(), how == "sum")
    return F.coalesce(told, by_name)


#: Labels of coded columns (fixed values).
COPY_KINDS = {1: "cudaMemcpyHostToDevice", 2: "cudaMemcpyDeviceToHost", 3: "cudaMemcpyHostToArray", 4: "cudaMemcpyArrayToHost", 8: "cudaMemcpyDeviceToDevice", None: "cudaMemcpy"}
SYNC_TYPES = {1: "cudaEventSynchronize", 2: "cudaStreamWaitEvent", 3: "cudaStreamSynchronize", 4: "cudaDeviceSynchronize", None: "cudaSync"}
GRAPH_EVENTS = {94: "graph_exec_creation", 95: "graph_creation", None: "graph_event_other"}
OVERHEADS = {
    0: "undefined", 1: "unknown", 2: "driver_compiler", 3: "cupti_buffer_flush", 4: "cupti_instrumentation", 5: "cupti_resource",
    6: "runtime_module_loading", 7: "lazy_function_loading", 8: "command_buffer_full", None: "overhead_other",
}


def label(code: str | Column, names: dict) -> Column:
    """The name of a code; the one under None for all others, null included."""
    c = F.col(code) if isinstance(code, str) else code
    return reduce(lambda a, kv: a.when(c == kv[0], kv[1]), [kv for kv in names.items() if kv[0] is not None], F.when(F.lit(False), "")).otherwise(names[None])


def name_axis(axis: str, columns: list[str]) -> Column:
    """The name by which kernels are grouped: ``short``, ``demangled``, ``mangled`` or ``none``.
    Captures without mangled names are grouped by the demangled ones."""
    if axis == "none":
        return F.lit(None).cast("string")
    if axis not in ("short", "demangled", "mangled"):
        raise ValueError(f"unknown name axis {axis!r}")
    return F.col("demangled_name" if axis == "mangled" and "mangled_name" not in columns else f"{axis}_name")


def composite_key(*parts: str | Column) -> Column:
    """Parts joined by ``|``; a null part is ``none``."""
    return F.concat_ws("|", *[F.coalesce(_text(p), F.lit("none")) for p in parts])


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def gap_key(start: str | Column, process: str | Column | None = None, device: str | Column | None = None, stream: str | Column | None = None) -> Column:
    """Stable key of a gap: of a stream if all are given, of a device without ``stream``, else of the
    whole trace. A gap whose process or device is null has the trace's key."""
    of_trace = F.concat(F.lit("gap|@"), _text(start))
    if process is None or device is None:
        return of_trace
    lane = [] if stream is None else [F.lit("|stream:"), _text(stream)]
    return F.coalesce(F.concat(F.lit("gap|pid:"), _text(process), F.lit("|dev:"), _text(device), *lane, F.lit("|@"), _text(start)), of_trace)


def bucket_key(start: str | Column, end: str | Column) -> Column:
    """Stable key of a time bucket."""
    return F.concat(F.lit("bucket|"), _text(start), F.lit(".."), _text(end))


def correlation_key(process: str | Column, device: str | Column, context: str | Column, correlation: str | Column) -> Column:
    """Stable key of an identity, in hexadecimal."""
    part = lambda p, c: F.concat(F.lit(p), F.lower(F.hex((F.col(c) if isinstance(c, str) else c).cast("long"))))
    return F.concat_ws("-", part("p", process), part("d", device), part("c", context), part("r", correlation))
