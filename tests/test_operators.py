"""Nesting, names, chrome traces, reports, streaming on small hand-made inputs."""

import json
import random

from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.operators import chrome as C
from spanloom.operators import correlate as L
from spanloom.operators import counters, intervals
from spanloom.operators import kernel_reports as K
from spanloom.operators import nesting as R
from spanloom.operators import sampling as P
from spanloom.sources import chrome as S
from spanloom.sources import kernel_reports, traces
from spanloom.streaming import live


def test_tree_paths_escape_and_touching_ranges_are_siblings(spark):
    rows = [(1, 0, 0, "a/b", 0, 100), (2, 0, 0, "c\\d", 0, 50), (3, 0, 0, "e", 50, 100), (4, 0, 0, "i", 60, None), (5, 0, 1, "other", 10, 20), (6, 0, 0, "deep", 10, 20)]
    t = spark.createDataFrame(rows, "range_id long, global_tid long, domain_id long, name string, start_ns long, end_ns long")
    got = {r["range_id"]: (r["depth"], r["parent_id"], r["path"]) for r in R.nesting(t).collect()}
    # of those that close together the earliest opened is the parent, and the path follows parents
    assert got == {1: (0, None, "a\\/b"), 2: (1, 1, "a\\/b/c\\\\d"), 3: (1, 1, "a\\/b/e"), 4: (2, 1, "a\\/b/i"), 5: (0, None, "other"), 6: (2, 2, "a\\/b/c\\\\d/deep")}


def test_contains_join_matches_brute_force(spark):
    r = random.Random(2)
    outer = [(i, r.randrange(2), s := r.randrange(0, 10**9), s + r.choice([1, 10**3, 10**6, 3 * 10**8])) for i in range(150)]
    inner = [(i, r.randrange(2), s := r.randrange(0, 10**9), s + r.choice([0, 10, 10**5])) for i in range(150)]
    o = spark.createDataFrame(outer, "o long, k long, o_start long, o_end long")
    i = spark.createDataFrame(inner, "i long, k long, i_start long, i_end long")
    want = sorted((a[0], b[0]) for a in outer for b in inner if a[1] == b[1] and a[2] <= b[2] and b[3] <= a[3])
    assert sorted((x["o"], x["i"]) for x in R.contains_join(o, i, ["k"]).collect()) == want


def test_names(spark):
    t = spark.createDataFrame([("a%b_1",), ("axb_1",), ("a%b21",), ("cudaMalloc_v3020",)], "name string")
    assert [r[0] for r in t.filter(N.name_glob("name", "a%b_?")).collect()] == ["a%b_1"]
    assert t.select(N.fold_version("name")).collect()[3][0] == "cudaMalloc"
    ids = spark.createDataFrame([((7 << 24) | (3 << 16) | 9,)], "g long").select(N.pid_of("g"), N.tid_of("g")).first()
    assert tuple(ids) == (7, 9)
    m = spark.createDataFrame([("a.sum",), ("b.pct",), ("hit.ratio",), ("dram [GB/s]",)], "m string")
    assert [r[0] for r in m.select(N.is_additive("m")).collect()] == [True, False, False, True]
    assert m.select(N.unit_of("m")).collect()[3][0] == "GB/s"


def chrome(spark, tmp_path, events):
    p = tmp_path / "rank3.json"
    p.write_text(json.dumps({"traceEvents": events}))
    return S.read_chrome_trace(spark, str(p))


def ev(name, cat, ts, dur, tid="1", ph="X", **args):
    return {"name": name, "cat": cat, "ph": ph, "ts": ts, "dur": dur, "pid": 1, "tid": tid, "args": args} | ({"id": args.pop("flow")} if "flow" in args else {})


def test_chrome_ingest_and_links(spark, tmp_path):
    e = chrome(spark, tmp_path, [
        ev("ProfilerStep#7", "user_annotation", 0, 100), ev("aten::mm", "cpu_op", 10, 20, **{"External id": 5}), ev("cudaLaunchKernel", "cuda_runtime", 12, 2, correlation=9), ev("gemm", "kernel", 40.5, 7, tid="s", correlation=9, **{"External id": 5}),
        ev("ncclAllReduce", "cpu_op", 60, 5, **{"External id": 8}), ev("ncclKernel_AllReduce", "kernel", 70, 5, tid="s", **{"External id": 8}), ev("ncclKernel_AllReduce", "kernel", 80, 5, tid="s"),
        ev("f", "flow", 11, 0, ph="s", flow="1"), ev("f", "flow", 41, 0, ph="f", tid="s", flow="1"), {"name": "meta", "ph": "M"},
    ])
    rows = {(r["name"], r["start_ns"]): r for r in e.collect()}
    assert len(rows) == 9
    gemm, mm = rows[("gemm", 40500)], rows[("aten::mm", 10000)]
    assert (gemm["end_ns"], gemm["type"], gemm["rank"], gemm["correlation"], mm["external_id"]) == (47500, "kernel", 3, 9, 5)
    links = {(r["from_row_id"], r["to_row_id"], r["kind"]) for r in C.event_links(e).collect()}
    run, step = rows[("cudaLaunchKernel", 12000)], rows[("ProfilerStep#7", 0)]
    assert {(mm["row_id"], run["row_id"], "nesting"), (step["row_id"], gemm["row_id"], "step"), (mm["row_id"], gemm["row_id"], "external"), (run["row_id"], gemm["row_id"], "correlation"), (mm["row_id"], gemm["row_id"], "flow")} <= links
    down = {r["row_id"] for r in C.causal_chain(e.filter("name = 'aten::mm'"), e, C.event_links(e)).collect() if r["direction"] == "down"}
    assert down == {gemm["row_id"]}
    got = sorted((r["confidence"], r["step"], r["ordinal"]) for r in C.collectives(e, C.event_links(e)).collect())
    assert got == [("kernel-only", 7, 1), ("link", 7, 0)]
    found = {r["row_id"]: r["found"] for r in C.inspect_events(e.select("row_id").limit(1).union(spark.createDataFrame([(-1,)], "row_id long")), e, C.event_links(e)).collect()}
    assert found.pop(-1) is False and list(found.values()) == [True]


def test_python_paths_end_on_cycles(spark, tmp_path):
    py = lambda n, i, up: ev(n, "python_function", i, 1, **{"Python id": i, "Python parent id": up})
    e = chrome(spark, tmp_path, [py("a", 1, None), py("b", 2, 1), py("c", 3, 2), py("x", 8, 9), py("y", 9, 8)])
    got = sorted(r["python_path"] for r in C.python_context(e, depth=4).collect())
    assert got[:3] == ["a", "a > b", "a > b > c"] and len(got) == 5


def test_walks_follow_chains_to_their_ends(spark):
    n = 90
    links = spark.createDataFrame([(i, i + 1, "flow") for i in range(40)] + [(40, 38, "flow")], "from_row_id long, to_row_id long, kind string")
    calls = spark.range(41).select(F.col("id").alias("row_id"), F.lit("runtime").alias("type"), F.col("id").alias("start_ns"))
    got = C.causal_chain(spark.createDataFrame([(0,)], "row_id long"), calls, links).filter("direction = 'down'").collect()
    assert sorted((r["row_id"], r["hops"]) for r in got) == [(i, i) for i in range(1, 41)]
    frames = [("t", "python", i, i, i - 1 if i else None, f"f{i}") for i in range(n)]
    p = spark.createDataFrame(frames, "trace string, type string, row_id long, python_id long, python_parent long, name string")
    paths = {r["row_id"]: r["python_path"] for r in C.python_context(p).collect()}
    assert paths == {i: " > ".join(f"f{j}" for j in range(i + 1)) for i in range(n)}


def test_python_context_of_frames_without_ids_and_of_other_events(spark, tmp_path):
    py = lambda n, t, d, **a: ev(n, "python_function", t, d, **a)
    e = chrome(spark, tmp_path, [py("a", 0, 100), py("b", 10, 50, **{"Python id": 7}), py("c", 20, 5, **{"Python id": 8, "Python parent id": 7}), ev("aten::mm", "cpu_op", 30, 5), ev("late", "cpu_op", 70, 5), ev("out", "cpu_op", 200, 5)])
    names = {r["row_id"]: r["name"] for r in e.collect()}
    assert {names[r["row_id"]]: r["python_path"] for r in C.python_context(e).collect()} == {"a": "a", "b": "a > b", "c": "a > b > c", "aten::mm": "a > b", "late": "a"}


def test_kernel_report(spark, tmp_path):
    src = {"file": "f.cu", "line": 3}
    launch = {
        "kernel_demangled": "k()", "kernel_mangled": "_Z1k", "grid_size": [2, 1, 1], "block_size": [32, 1, 1], "stream_id": 7,
        "metrics": [{"name": "inst.sum", "unit": "", "value": 30.0, "instances": [{"rel_address": 0, "value": 10.0}, {"rel_address": 16, "value": 20.0}]}, {"name": "hit.pct", "unit": "%", "value": 5.0, "instances": []}],
        "rules": [{"name": "r", "message": "m"}], "disasm": [{"address": 0, "opcode": "MOV", "operands": "", "source": src}, {"address": 16, "opcode": "EXIT", "operands": ""}],
        "warp_stalls": {"total_samples": 5, "pcs": [{"rel_address": 0, "source": src, "reasons": {"wait": 4, "barrier": 1}}]},
    }
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"launches": [launch], "ranges": [{"name": "w"}], "graphs": []}))
    t = kernel_reports.read_kernel_report(spark, str(p))
    assert tuple(K.report_summary(t).first()) == (1, 2, 1, 1, 1, 0)
    assert [tuple(r) for r in K.source_metrics(t["instances"], t["sass"]).collect()] == [("f.cu", 3, "inst.sum", 10.0, 1)]
    assert tuple(K.reconcile(t["instances"], t["sass"]).first())[1:] == (30.0, 10.0, 20.0, 0.0)
    assert sorted(map(tuple, K.warp_stalls(t["stalls"], "reason").collect())) == [("barrier", 1), ("wait", 4)]
    assert t["workloads"].count() == 1
    flat = traces.flatten_for_csv(t["launches"].select("name", F.struct(F.col("grid_x").alias("x")).alias("grid"), "rules"))
    assert flat.columns == ["name", "grid.x", "rules"]


def test_ranges_that_overlap_nest_by_what_is_open(spark):
    rows = [(1, 0, 0, "a", 0, 10), (2, 0, 0, "b", 5, 20), (3, 0, 0, "c", 6, 7), (4, 0, 0, "d", 12, 15), (5, 0, 0, "e", 30, 40), (6, 0, 0, "f", 31, 41), (7, 0, 0, "g", 32, 60), (8, 0, 0, "h", 50, 55)]
    t = spark.createDataFrame(rows, "range_id long, global_tid long, domain_id long, name string, start_ns long, end_ns long")
    got = {r["range_id"]: (r["depth"], r["parent_id"], r["path"]) for r in R.nesting(t).collect()}
    assert got[1] == (0, None, "a") and got[2] == (1, 1, "a/b") and got[3] == (2, 1, "a/c")
    assert got[4] == (1, 2, "a/b/d")  # a has closed, but b began in it
    assert got[7] == (2, 5, "e/g") and got[8] == (1, 7, "h")  # g lies deeper than h: the path begins anew
    marks = t.withColumn("event_type", F.when(F.col("range_id") == 1, 75).otherwise(59))
    assert {r["range_id"]: r["depth"] for r in R.range_tree(marks).collect()}[2] == 0


def test_threads_that_move_between_cpus(spark):
    rows = [(1, 7, 0, 0, 1, "a"), (2, 7, 1, 10, 0, "b"), (3, 7, 0, 15, 0, "c"), (4, 7, 1, 20, 1, "a"), (5, 7, 1, 26, 0, "b"), (6, 8, 0, 30, 0, "c")]
    t = spark.createDataFrame(rows, "row_id long, global_tid long, cpu long, start_ns long, is_in int, state string")
    assert sorted((r["cpu"], r["start_ns"], r["end_ns"], r["state"]) for r in P.quanta(t).collect()) == [(0, 0, 15, "c"), (1, 20, 26, "b")]
    assert {r["state"]: (r["off_ns"], r["switches"], r["on_ns"], r["mean_ns"]) for r in P.state_time(t).collect()} == {"b": (0, 2, 6, 6), "c": (5, 2, 15, 15)}
    assert {r["global_tid"]: (r["on_ns"], r["off_ns"], r["mean_ns"]) for r in P.thread_time(t).collect()} == {7: (21, 5, 10), 8: (0, 0, None)}
    assert {r["cpu"]: (r["on_ns"], r["off_ns"], r["threads"]) for r in P.cpu_time(t).collect()} == {0: (15, 15, 1), 1: (6, 10, 1)}


def test_units_and_additivity_of_counters(spark):
    units = {
        "gpu__time_duration.sum": "nsecond", "SM_A.TriageAC.sm__cycles_active.avg": "cycle", "dram__bytes.sum.per_second": "byte_per_second", "gpc__cycles_elapsed.avg.per_second": "hertz",
        "sm__inst_executed.avg.per_cycle_active": "inst_per_cycle", "lts__t_sectors.avg.per_cycle_elapsed": "sector_per_cycle", "launch__shared_mem_per_block_static": "byte_per_block",
        "launch__registers_per_thread": "register_per_thread", "smsp__pcsamp_aggregated_passes": "pass", "profiler__pmsampler_dropped_samples": "sample", "smsp__branch_targets_threads_divergent": "branches",
        "device__attribute_clock_rate": None, "l1tex__hits_pct": "percent", "smsp__warps_active.avg.per_cycle_active": "warp", "dram__bytes.sum.peak_sustained": "byte_per_cycle", "x__thing.per_second": None,
    }
    t = spark.createDataFrame([(k,) for k in units], "m string")
    assert {r["m"]: r["u"] for r in t.select("m", N.metric_unit("m").alias("u")).collect()} == units
    sums = {"sm__memory_operations.sum": True, "idc__iterations.sum": True, "smsp__inst_op_generate.sum": True, "x.ratio": False, "x__y.max": False, "dram__bytes.sum.per_second": False, "a.pct_of_peak": False, "launch__registers_per_thread": False}
    t = spark.createDataFrame([(k, None, None, None) for k in sums] + [("n1.avg", "counter", None, "sum"), ("n2.sum", "counter", None, "avg"), ("n3.sum", "throughput", None, "sum"), ("n4.sum", "counter", "pct", "sum"), ("n5.sum", "other", None, "avg")], "m string, k string, s string, r string")
    got = {r["m"]: r["a"] for r in t.select("m", N.is_additive("m", "k", "s", "r").alias("a")).collect()}
    assert got == {**sums, "n1.avg": True, "n2.sum": False, "n3.sum": False, "n4.sum": False, "n5.sum": True}
    one = spark.range(1)
    assert tuple(one.select(N.label(F.lit(8), N.COPY_KINDS), N.label(F.lit(77), N.SYNC_TYPES), N.label(F.lit(None).cast("int"), N.OVERHEADS), N.composite_key(F.lit("gap"), F.lit(None), F.lit(3))).first()) == ("cudaMemcpyDeviceToDevice", "cudaSync", "overhead_other", "gap|none|3")


def test_series_sum_by_unit_not_by_name(spark):
    rows = [(0, "a [requests]", 1, 2.0), (0, "a [requests]", 2, 4.0), (0, "Requests b [ms]", 1, 2.0), (0, "Requests b [ms]", 2, 4.0), (0, "Cycles Active", 1, 5.0), (0, "Cycles Active", 3, 7.0)]
    t = spark.createDataFrame(rows, "type_id int, metric string, ts_ns long, value double")
    assert {r["metric"]: r["value"] for r in counters.point_series(t, 10).collect()} == {"a [requests]": 6.0, "Requests b [ms]": 3.0, "Cycles Active": 6.0}


def test_chrome_kinds_of_events(spark):
    rows = [
        ("ProfilerStep#1", "user_annotation", {}, "step", False, None), ("ncclDevKernel_AllReduce", "x", {}, "kernel", True, "all_reduce"), ("c", "gpu_memcpy", {}, "memcpy", False, None), ("s", "gpu_memset", {}, "memset", False, None),
        ("l", "cuda_driver", {}, "driver", False, None), ("p", "python_function", {}, "python", False, None), ("[memory]", "cpu_instant_event", {"Total Allocated": "3"}, "memory", False, None), ("op", None, {"External id": "1"}, "cpu_op", False, None),
        ("record_param_comms", "other", {}, "comm", True, "unknown"), ("x", "other", {"Process Group comm": "1"}, "comm", True, "unknown"), ("c10d::allgather_", "cpu_op", {}, "cpu_op", True, "all_gather"), ("y", "operator", {}, "cpu_op", False, None), ("z", "thing", {"k": "a NCCL b"}, "comm", True, "unknown"),
    ]
    t = spark.createDataFrame([r[:3] for r in rows], "name string, cat string, args map<string,string>")
    comm = S.is_comm("name", "cat", "args")
    got = t.select("name", S.event_type("name", "cat", "args").alias("t"), comm.alias("c"), F.when(comm, S.collective_kind("name")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(r[0], *r[3:]) for r in rows]


def test_external_ids_link_events_without_rank(spark):
    ddl = "trace string, row_id long, external_id long, rank long, start_ns long, ph string, flow_id string"
    rows = [("t", 1, 5, None, 1), ("t", 2, 5, 0, 2), ("t", 3, 5, None, 3), ("t", 4, 5, 0, 4), ("t", 11, 6, 0, 1), ("t", 12, 6, None, 2), ("t", 13, 6, 1, 3), ("t", 14, 6, 0, 4)]
    t = spark.createDataFrame([(*r, "X", None) for r in rows], ddl)
    assert sorted(map(tuple, C.external_chain(t).collect())) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (11, 14)]


def test_an_event_past_a_frame_ends_it(spark, tmp_path):
    e = chrome(spark, tmp_path, [ev("f", "python_function", 0, 100), ev("past", "cpu_op", 50, 100), ev("in", "cpu_op", 60, 5), ev("early", "cpu_op", 20, 5)])
    names = {r["row_id"]: r["name"] for r in e.collect()}
    assert {names[r["row_id"]]: r["python_path"] for r in C.python_context(e).collect()} == {"f": "f", "early": "f"}


def test_causes_stop_at_other_roots_and_at_device_work(spark):
    e = spark.createDataFrame([(1, "cpu_op", 0), (2, "runtime", 1), (3, "kernel", 5), (4, "cpu_op", 6), (5, "kernel", 7), (6, "driver", 2)], "row_id long, type string, start_ns long")
    links = spark.createDataFrame([(1, 2, "external"), (2, 3, "correlation"), (6, 3, "correlation"), (3, 4, "external"), (4, 5, "external"), (3, 5, "external")], "from_row_id long, to_row_id long, kind string")
    got = {(r["seed"], r["row_id"], r["direction"]) for r in C.causal_chain(e, e, links).collect()}
    assert {x[1:] for x in got if x[0] == 1} == {(2, "down"), (3, "down"), (6, "down")}  # the driver call launched the kernel too
    assert {x[1:] for x in got if x[0] == 3} == {(2, "up"), (1, "up"), (6, "up")}
    assert {x[1:] for x in got if x[0] == 5} == {(4, "up"), (3, "up"), (2, "up"), (6, "up"), (1, "up")}
    assert {x[1:] for x in got if x[0] == 4} == {(5, "down")}


def test_collectives_take_all_linked_kernels(spark, tmp_path):
    nccl = lambda t, **a: ev("ncclDevKernel_AllReduce", "kernel", t, 2, tid="s", **a)
    e = chrome(spark, tmp_path, [
        ev("c10d::allreduce_", "cpu_op", 0, 1, **{"External id": 1}), ev("launch", "cuda_runtime", 1, 1, correlation=7, **{"External id": 1}), nccl(10, correlation=7), ev("launch2", "cuda_runtime", 2, 1, correlation=8, **{"External id": 1}), nccl(20, correlation=8),
        ev("c10d::allreduce_", "cpu_op", 30, 1, **{"External id": 2}), ev("c10d::allreduce_", "cpu_op", 40, 1, **{"External id": 3}), nccl(50), nccl(60),
    ])
    at = {r["row_id"]: r["start_ns"] // 1000 for r in e.collect()}
    got = sorted((r["ordinal"], r["confidence"], [at[k] for k in r["kernel_ids"]], r["start_ns"] // 1000, r["end_ns"] // 1000) for r in C.collectives(e, C.event_links(e)).collect())
    assert got == [(0, "link", [10, 20], 0, 22), (1, "ordinal", [20], 20, 31), (2, "ordinal", [50], 40, 52), (3, "kernel-only", [60], 60, 62)]


def test_slices_in_a_scope(spark, tmp_path):
    e = chrome(spark, tmp_path, [ev("fwd", "user_annotation", 0, 100, rank=0), ev("bwd", "user_annotation", 200, 100, rank=0), ev("k", "kernel", 10, 20, tid="s", rank=0, stream=7), ev("k", "kernel", 210, 20, tid="s", rank=0, stream=8), ev("op", "cpu_op", 20, 50, rank=0)])
    all_ = {r["slice"]: (r["children"], r["gpu_ns"]) for r in C.event_slices(e).collect()}
    assert all_ == {"fwd": (1, 20000), "bwd": (0, 20000)}
    assert {r["slice"]: r["gpu_ns"] for r in C.event_slices(e, stream=7).collect()} == {"fwd": 20000}
    assert {r["slice"]: r["gpu_ns"] for r in C.event_slices(e, window=(0, 15000)).collect()} == {"fwd": 5000}


def test_large_traces_are_read_in_splits(spark, tmp_path):
    one = lambda i: f'    "ph": "X", "cat": "cpu_op", "name": "op{i}", "pid": 1, "tid": 2,\n    "ts": {i}, "dur": 1,\n    "args": {{\n      "External id": {i}, "note": "a b"\n    }}'
    n = 3000
    body = "\n  },\n  {\n".join(one(i) for i in range(n))
    p = tmp_path / "trace.json"
    p.write_text('{\n  "schemaVersion": 1,\n  "distributedInfo": {"backend": "x", "rank": 4},\n  "traceEvents": [\n  {\n' + body + '\n  }\n  ],\n  "traceName": "x"\n}\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split = S.read_chrome_trace(spark, str(p), between="\n  },\n  {")
        assert S._pieces(spark, [str(p)], "\n  },\n  {").rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = S.read_chrome_trace(spark, str(p))
    cols = ["name", "type", "start_ns", "end_ns", "rank", "external_id", "args"]
    of = lambda d: sorted(map(str, d.select(*cols).collect()))
    assert split.count() == n and of(split) == of(whole) and {r["rank"] for r in split.collect()} == {4}


def test_listing_orders_counts_and_breaks_ties(spark):
    t = spark.createDataFrame([("a", 3, 1), ("b", 3, 2), ("c", 5, 3), ("d", None, 4)], "name string, total int, n int")
    got = L.listing(t, "total:desc", {"total": "desc", "name": "asc"}, ("name",), 3, ("n",)).orderBy("place").collect()
    assert [(r["name"], r["matched"], r["all_n"]) for r in got] == [("c", 4, 10), ("b", 4, 10), ("a", 4, 10)]
    for wrong in ("nope", "total:up"):
        try:
            L.order_by(wrong, {"total": "desc"}, ())
        except ValueError:
            continue
        raise AssertionError(wrong)


def test_captures_without_graph_columns(spark):
    nodes = spark.createDataFrame([(1, 5, None, 9)], "row_id long, start_ns long, end_ns long, graph_node_id long")
    got = L.inspect_graph_nodes(nodes.select("row_id"), nodes, spark.createDataFrame([(9,)], "graph_node_id long")).first()
    assert (got["found"], got["ns"], got["graph_id"], got["graph_exec_id"]) == (True, 0, None, None)
    assert str(N.name_axis("mangled", ["demangled_name"])) == str(F.col("demangled_name"))


def test_load_trace_fills_missing_columns(spark, tmp_path):
    spark.range(3).withColumn("start_ns", F.col("id")).write.parquet(str(tmp_path / "kernel.parquet"))
    t = traces.load_trace(spark, str(tmp_path), {"kernel": "id long, start_ns long, name string", "memcpy": "id long"})
    assert list(t) == ["kernel"] and t["kernel"].filter("name is null").count() == 3
    assert traces.materialize(t["kernel"], str(tmp_path / "out")).count() == 3


def test_live_activity(spark, tmp_path):
    ddl = "row_id long, process_id long, device_id long, start_ns long, end_ns long"
    s = 10**9
    spark.createDataFrame([(1, 0, 0, 0, 5 * s), (2, 0, 0, 3 * s, 8 * s)], ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(3, 0, 0, 20 * s, 21 * s), (4, 0, 0, 2 * s, 4 * s)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(f, name, mode):
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    act = run(lambda d: live.live_activity(d, "10 seconds", "1 hour"), "act", "complete")
    assert sorted((r["bucket_ns"], r["n"]) for r in act) == [(0, 3), (20 * s, 1)]


def test_live_gaps_in_any_order_within_the_delay(spark, tmp_path):
    r = random.Random(4)
    ddl = "row_id long, process_id long, device_id long, start_ns long, end_ns long"
    rows = [(i, 0, i % 2, s := i * 10 + r.randrange(60), s + r.choice([0, 3, 9, 30])) for i in range(120)]
    for n in range(4):  # out of order, also between files
        spark.createDataFrame(r.sample(rows[n * 30 : n * 30 + 30], 30), ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.start_gaps(stream, str(tmp_path / "out"), late_ns=100)
    q.awaitTermination()
    told, rest = live.told_gaps(spark, str(tmp_path / "out")), live.last_gaps(spark, str(tmp_path / "out"))
    whole = intervals.idle_gaps(spark.createDataFrame(rows, ddl))
    of = lambda d: sorted((x["device_id"], x["start_ns"], x["end_ns"], x["gap_ns"]) for x in d.collect())
    assert told.count() and of(told.unionByName(rest)) == of(whole)


def test_live_gaps_count_late_spans_and_go_on_after_a_restart(spark, tmp_path):
    ddl = "row_id long, process_id long, device_id long, start_ns long, end_ns long"
    batches = [[(0, 0, 0, 0, 10), (1, 0, 0, 500, 510)], [(2, 0, 0, 100, 120), (3, 0, 1, 7, 9), (4, 0, 0, 420, 430)], [(5, 0, 0, 399, 401), (6, 0, 0, 900, 901), (7, 0, 1, 8, 30)], [(8, 0, 0, 700, 700)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        live.start_gaps(stream, str(tmp_path / "out"), late_ns=100).awaitTermination()  # each run starts anew from the checkpoint
    told, rest = live.told_gaps(spark, str(tmp_path / "out")), live.last_gaps(spark, str(tmp_path / "out"))
    of = lambda d: sorted((x["device_id"], x["start_ns"], x["end_ns"]) for x in d.collect())
    # up to 400 is told after the first run: the spans at 100 and 399 are late, that at 420 is not; up to 800 after the third
    assert of(told) == [(0, 10, 420), (0, 430, 500)] and of(rest) == [(0, 510, 900)]
    assert [tuple(r) for r in live.late_spans(spark, str(tmp_path / "out")).collect()] == [(0, 0, 3)]


def test_rank_skew_finds_planted_clocks_and_slow_ranks(spark):
    r = random.Random(8)
    base, slow, rows = 1_700_000_000_000_000_000, {}, []
    clocks = {0: 0, 1: 5_000_000, 2: -70_000_123, 3: 10**15 + 7, 10: 0, 11: 900, 20: 0}  # 10 and 11 meet no other, 20 none at all
    for n in range(60):
        # rank 0 meets 1, which meets 2 and 3 (among others): clocks of 2 and 3 are told over 1
        for step, members in ((0, (0, 1)), (1, (1, 2, 3)), (2, (10, 11)), (3, (20,))):
            late = r.choice(members)
            starts = {m: base + n * 10**6 + r.randrange(1000) + (5000 if m == late else 0) for m in members}
            end = max(starts.values()) + 300
            first = min(starts.values())
            slow[step, n] = (None, None) if len(members) == 1 else (starts[late] - first, late)
            for m in members:
                stuck = 10**5 if n % 7 == 3 and m == members[-1] else 0  # some ends are late
                rows.append((m, step, "all_reduce", n, starts[m] + clocks[m], end + stuck + clocks[m]))
    rows.append((-1, 0, "all_reduce", 0, base, base + 1))
    found = spark.createDataFrame(rows, "rank long, step long, collective string, ordinal long, start_ns long, end_ns long")
    got = C.rank_skew(found).collect()
    assert len(got) == len(rows)
    for x in got:
        want = slow[x["step"], x["ordinal"]] if x["rank"] >= 0 else (None, None)
        assert (x["skew_ns"], x["slow_rank"]) == want
        assert x["offset_ns"] == (clocks[x["rank"]] if x["rank"] in (0, 1, 2, 3, 10, 11) else None)
    assert C.rank_skew(found.limit(0)).count() == 0 and C.rank_skew(found.filter("rank = 20")).filter("skew_ns is not null").count() == 0


def test_stored_attribution_joins_without_a_shuffle(spark, tmp_path):
    r = random.Random(9)
    spans = spark.createDataFrame([(i, i % 2, i % 3, 1, None if i % 5 == 0 else i % 40, 10 * i, 10 * i + r.randrange(9), "kernel", 7) for i in range(200)], "row_id long, process_id long, device_id long, context_id long, correlation_id long, start_ns long, end_ns long, kind string, stream_id long")
    contexts = spark.createDataFrame([(p, d, 1) for p in range(2) for d in range(2)], "process_id long, device_id long, context_id long")
    launches = spark.createDataFrame([(1000 + i, i % 2, 1, i if i % 7 else None, i * 10, i * 10 + 2) for i in range(40)], "row_id long, process_id long, global_tid long, correlation_id long, start_ns long, end_ns long")
    ranges = spark.createDataFrame([(1, 1, 0, "all", 0, 300), (2, 1, 0, "part", 100, 200)], "range_id long, global_tid long, domain_id long, name string, start_ns long, end_ns long")
    chains = R.enclosing_ranges(ranges, launches)
    stored = R.store_attribution(spans, chains, contexts, str(tmp_path / "kept"), "kept_attribution", buckets=3)
    plain = {x["row_id"]: (x["range_id"], x["range_name"], x["range_depth"], x["range_path"]) for x in R.innermost_range(spans, chains, contexts).collect()}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ways = [R.innermost_stored(stored), R.under_range(stored.spans, stored.hosts, None, lambda c: c == "part")]
        for way in ways:
            assert "Exchange" not in way._jdf.queryExecution().executedPlan().toString()
        assert {x["row_id"]: (x["range_id"], x["range_name"], x["range_depth"], x["range_path"]) for x in ways[0].collect()} == plain and len(plain) == 200
        assert {x["row_id"] for x in ways[1].collect()} == {x["row_id"] for x in R.under_range(spans, chains, contexts, lambda c: c == "part").collect()} != set()
        said = lambda d: sorted(map(str, d.collect()))
        assert said(R.range_slices(ranges, stored.spans, stored.hosts)) == said(R.range_slices(ranges, spans, chains, contexts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_collectives_take_arguments_apart_once(spark, monkeypatch):
    from spanloom.plans import chrome as queries

    plans, stage = {}, C.stage
    monkeypatch.setattr(C, "stage", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or stage(df, label))
    queries.n16_n17_collectives(spark, "/root/testdata/sf0.001")
    assert {"narrow_events", "comm_events", "reach_steps"} <= set(plans)
    assert [label for label, plan in plans.items() if "args#" in plan] == ["narrow_events"]
