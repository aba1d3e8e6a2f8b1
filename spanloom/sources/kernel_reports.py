"""Kernel reports: nested JSON into launch, metric, instance, listing and stall tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.staging import stage

INSTANCE = "correlation_id:long,rel_address:long,value:double,placement:string"
METRIC = f"struct<name:string,unit:string,value:double,value_type:string,metric_type:string,metric_subtype:string,rollup:string,instances:array<struct<{INSTANCE}>>>"
SOURCE = "struct<file:string,line:long>"
STALL = f"struct<rel_address:long,source:{SOURCE},reasons:map<string,long>>"
LAUNCH = (
    f"kernel_demangled:string,kernel_mangled:string,grid_size:array<long>,block_size:array<long>,stream_id:long,cubin_load_base:long,metrics:array<{METRIC}>,rules:array<struct<name:string,message:string>>,"
    f"disasm:array<struct<address:long,opcode:string,operands:string,source:{SOURCE}>>,warp_stalls:struct<total_samples:long,not_issued_samples:long,out_of_cubin_samples:long,pcs:array<{STALL}>>"
)
SCHEMA = f"launches array<struct<{LAUNCH}>>, ranges array<struct<name:string>>, graphs array<struct<name:string>>"


def document_id(raw: DataFrame, whole_files: bool) -> Column:
    """What tells documents apart: the file, and for documents of one line each also where they lie in
    it (the start of the block, and the number of the line among those its task has read). It is
    the same for one way of cutting files only, so it has to be written with the document."""
    if whole_files:
        return F.input_file_name()
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.concat(F.input_file_name(), F.lit("#"), raw["_metadata.file_block_start"].cast("string"), F.lit("."), line.cast("string"))


#: The parts of a report, one row each: what a part has lies in the column of its kind, the others are null.
_CLASS = "metric_type:string,metric_subtype:string,rollup:string"
PARTS = {
    "launched": "name:string,mangled:string,grid:array<long>,block:array<long>,stream_id:long,n_metrics:int,n_rules:int,rules:array<struct<name:string,message:string>>,has_listing:boolean,total_samples:long,out_of_cubin_samples:long",
    "metric": f"counter:string,value:double,unit:string,{_CLASS}",
    "instance": f"counter:string,{_CLASS},place:int,pc:long,value:double,placement:string",
    "sass": "pc:long,opcode:string,operands:string,file:string,line:long",
    "stall": "pc:long,file:string,line:long,reason:string,samples:long",
    "work": "w:struct<name:string>,kind:string",
}


def _part(part: str, **cols: Column) -> Column:
    named = [x.partition(":")[0] for x in re.split(r",(?![^<]*>)", PARTS[part])]
    own = F.struct(*[cols[c].alias(c) for c in named])
    return F.struct(F.lit(part).alias("part"), *[(own if k == part else F.lit(None).cast(f"struct<{t}>")).alias(k) for k, t in PARTS.items()])


def _parts(each: Column, make: Callable[..., Column]) -> Column:
    """One part or more for each element; none for null."""
    return F.coalesce(F.transform(each, make), F.array())


def _launch_parts(one: Column) -> Column:
    """All parts of a launch as one array."""
    size = lambda c: F.greatest(F.coalesce(F.size(one[c]), F.lit(0)), F.lit(0))
    stalls = one["warp_stalls"]
    own = _part(
        "launched", name=one["kernel_demangled"], mangled=one["kernel_mangled"], grid=one["grid_size"], block=one["block_size"], stream_id=one["stream_id"], n_metrics=size("metrics"), n_rules=size("rules"), rules=one["rules"],
        has_listing=F.size(one["disasm"]) > 0, total_samples=stalls["total_samples"], out_of_cubin_samples=stalls["out_of_cubin_samples"],
    )
    told = lambda m: {"counter": m["name"], **{c: m[c] for c in ("metric_type", "metric_subtype", "rollup")}}
    source = lambda x: {"file": x["source"]["file"], "line": x["source"]["line"]}
    metrics = _parts(one["metrics"], lambda m: _part("metric", value=m["value"], unit=m["unit"], **told(m)))
    instances = _parts(one["metrics"], lambda m: _parts(m["instances"], lambda i, at: _part("instance", place=at, pc=i["rel_address"], value=i["value"], placement=i["placement"], **told(m))))
    sass = _parts(one["disasm"], lambda d: _part("sass", pc=d["address"], opcode=d["opcode"], operands=d["operands"], **source(d)))
    samples = _parts(stalls["pcs"], lambda p: _parts(F.map_entries(p["reasons"]), lambda r: _part("stall", pc=p["rel_address"], reason=r["key"], samples=r["value"], **source(p))))
    return F.concat(F.array(own), metrics, F.flatten(instances), sass, F.flatten(samples))


def read_kernel_report(spark: SparkSession, *paths: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """launches, metrics, instances, sass, stalls, workloads; the launch's place in its report is
    its id. The files are parsed once: every part of a report is written to the shared folder as a row of
    its own and all tables read those, as Spark reads some thousand rows at a time, however much a row
    nests. A report is one JSON document, so with ``multi_line`` (the usual
    form) one task parses one file and the report's id is the file's name; reports of one document a
    line are read in splits, and each has an id of its own however many lie in a file."""
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(list(paths))
    raw = raw.withColumn("report", document_id(raw, multi_line)).select("report", "launches", "ranges", "graphs")
    none = lambda t: F.lit(None).cast(t)
    launched = _parts(F.col("launches"), lambda x, at: F.struct(at.alias("launch"), x.alias("l"), none("struct<name:string>").alias("w"), F.lit("launch").alias("kind")))
    work = lambda c, kind: _parts(F.col(c), lambda w: F.struct(none("int").alias("launch"), none(f"struct<{LAUNCH}>").alias("l"), w.alias("w"), F.lit(kind).alias("kind")))
    items = raw.select("report", F.explode(F.concat(launched, work("ranges", "range"), work("graphs", "graph"))).alias("x"))
    x = F.col("x")
    parts = items.select("report", x["launch"].alias("launch"), F.explode(F.when(x["kind"] == "launch", _launch_parts(x["l"])).otherwise(F.array(_part("work", w=x["w"], kind=x["kind"])))).alias("p"))
    parts = stage(parts.select("report", "launch", "p.*"), "reports")
    of = lambda part: parts.filter(F.col("part") == part).select("report", "launch", f"{part}.*")
    axes = lambda c: [F.get(F.col(c), i).alias(f"{c}_{a}") for i, a in enumerate("xyz")]
    shaped = lambda d: d.select("report", "launch", "name", "mangled", *axes("grid"), *axes("block"), *d.columns[6:])
    return {"launches": shaped(of("launched")), "metrics": of("metric"), "instances": of("instance"), "sass": of("sass"), "stalls": of("stall"), "workloads": of("work").drop("launch")}
