"""Documents read in splits: traces of one document, reports of many."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.operators import correlate, kernel_reports, nesting
from spanloom.sources import chrome, json_splits
from spanloom.sources.kernel_reports import read_kernel_report


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def trace_document():
    r = random.Random(3)
    odd = ['plain', 'a } b', '{"x": [', 'quote " and \\ back\\', '"}', "é 😀 ]", "", '\\"}{', "x" * 400]
    events = [{"name": r.choice(odd), "ph": "X", "cat": r.choice(odd), "ts": i * 10, "dur": 3, "pid": 1, "tid": "t", "args": {r.choice(odd) + str(j): r.choice([1, "v } {", odd[3]]) for j in range(r.randrange(3))}} for i in range(25)]
    events[7:7] = [5, "text } in {", {"name": "no time"}, {"ts": 1e6, "name": "nested", "args": {"deep": {"er": [{"a": "}"}, []]}}}]
    return {"schemaVersion": 1, "deviceProperties": [{"id": 0, "ts": 5, "name": "no event"}], "distributedInfo": {"backend": "n } x", "rank": 3, "world": 4}, "traceEvents": events, "after": [{"ts": 9, "name": "none either"}], "end": {"ts": 1}}


@pytest.mark.parametrize("indent", [None, 2])
def test_a_trace_of_one_document_in_many_splits(spark, tmp_path, tiny_splits, indent):
    (tmp_path / "t.json").write_text(json.dumps(trace_document(), indent=indent, ensure_ascii=False), encoding="utf-8")
    assert spark.read.text(str(tmp_path / "t.json")).rdd.getNumPartitions() > 20
    cols = ["name", "cat", "ph", "start_ns", "end_ns", "pid", "tid", "rank", "type"]
    rows = lambda d: sorted(str([*[x[c] for c in cols], sorted((x["args"] or {}).items())]) for x in d.collect())
    want = rows(chrome.read_chrome_trace(spark, str(tmp_path / "t.json")))
    got = rows(chrome.read_chrome_trace(spark, str(tmp_path / "t.json"), split=True))
    assert len(want) == 26 and got == want
    texts = json_splits.read_listed_objects(spark, str(tmp_path / "t.json")).collect()
    assert {x["rank"] for x in texts} == {3} and sorted(json.dumps(json.loads(x["text"])) for x in texts) == sorted(json.dumps(e) for e in trace_document()["traceEvents"] if isinstance(e, dict))


def test_traces_without_events(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"traceEvents": []}\n')
    (tmp_path / "b.json").write_text('{"other": [{"ts": 1}]}')
    assert chrome.read_chrome_trace(spark, str(tmp_path), split=True).count() == 0


@pytest.mark.parametrize("files", [1, 3, 8])
def test_reports_that_share_a_file_keep_apart(spark, tmp_path, files):
    launch = lambda n, k: {"kernel_demangled": f"r{n}k{k}", "metrics": [{"name": "smsp__ops.sum", "value": float(n), "instances": [{"rel_address": 16, "value": v, "placement": "attributed"} for v in (3.0, 1.0)]}], "disasm": [{"address": 16, "opcode": "X", "source": {"file": "f", "line": 1}}]}
    docs = [json.dumps({"launches": [launch(n, k) for k in range(n + 1)], "ranges": [{"name": f"r{n}"}]}) for n in range(9)]
    spark.createDataFrame([(d,) for d in docs], "value string").repartition(files).write.text(str(tmp_path / "r"))
    t = read_kernel_report(spark, str(tmp_path / "r"), multi_line=False)
    keys = t["launches"].select("report", "launch", "name").collect()
    assert len(keys) == len({k[:2] for k in keys}) == 45 and len({k["report"] for k in keys}) == 9
    assert all(len({k["name"].split("k")[0] for k in keys if k["report"] == r}) == 1 for r in {k["report"] for k in keys})
    on = ("report", "launch", "pc")
    lines = kernel_reports.source_metrics(t["instances"], t["sass"], "line", on=on).collect()
    first = kernel_reports.source_metrics(t["instances"], t["sass"], "sass", on=on).collect()
    assert [r["value"] for r in lines] == [4.0] * 45 and [r["value"] for r in first] == [3.0] * 45  # an address is no sum


def test_rates_are_no_sums(spark):
    names = ["gpc__cycles_elapsed.avg.per_second", "sm__cycles_active.sum.per_second", "foo__elapsed.sum.per_second", "sm__issue_active.sum.per_cycle_active", "sm__sass_branch_targets.sum.per_second"]
    d = spark.createDataFrame([(n,) for n in [*names, "smsp__ops.sum"]], "counter string")
    assert [r[0] for r in d.select(N.is_additive("counter")).collect()] == [False] * 5 + [True]


WORK = "kind string, row_id long, process_id long, device_id long, context_id long, correlation_id long, start_ns long, end_ns long"


def test_one_correlation_id_in_two_contexts_has_two_answers(spark):
    work = spark.createDataFrame([("kernel", 1, 7, 0, 1, 5, 10, 20), ("kernel", 2, 7, 0, 2, 5, 30, 40), ("sync", 3, 7, 0, 2, 5, 41, 42), ("graph", 4, 8, 0, 1, 5, 1, 2), ("kernel", 5, 7, 0, 1, None, 1, 2)], WORK)
    host = spark.createDataFrame([("runtime", 1, 7, 5, 8, 9), ("runtime", 2, 7, 6, 50, 51), ("runtime", 3, 9, 5, 1, 2)], "kind string, row_id long, process_id long, correlation_id long, start_ns long, end_ns long")
    contexts = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 1, 8)], "device_id long, context_id long, process_id long")
    ids = spark.createDataFrame([("kernel", 1), ("kernel", 2), ("runtime", 1), ("runtime", 2), ("runtime", 3), ("kernel", 5), ("range", 1)], "kind string, row_id long")
    got = {}
    for r in correlate.correlate(ids, work, host, contexts).collect():
        got.setdefault((r["kind"], r["row_id"]), set()).add((r["key"], r["to_kind"], r["to_row_id"]) if r["found"] else None)
    a, b = "p7-d0-c1-r5", "p7-d0-c2-r5"
    assert got == {
        ("kernel", 1): {(a, "kernel", 1), (a, "runtime", 1)}, ("kernel", 2): {(b, "kernel", 2), (b, "sync", 3), (b, "runtime", 1)},
        ("runtime", 1): {(a, "kernel", 1), (a, "kernel", 2), (a, "sync", 3), (a, "runtime", 1)}, ("runtime", 2): {("p7-d0-c1-r6", "runtime", 2)},
        ("runtime", 3): {None}, ("kernel", 5): {None}, ("range", 1): {None},
    }


def test_replays_under_a_path_of_ranges(spark):
    ranges = spark.createDataFrame([(1, 4, "outer", 0, 100), (2, 4, "inner step", 10, 50), (3, 4, None, 30, None), (4, 4, "a/b", 60, 90)], "range_id long, global_tid long, name string, start_ns long, end_ns long").withColumn("domain_id", F.lit(0).cast("long"))
    calls = spark.createDataFrame([(1, 4, 0, 1, "cudaGraphLaunch_v1", 20, 25), (2, 4, 0, 2, "cudaGraphLaunch_v1", 70, 75), (3, 4, 0, 3, "cudaLaunchKernel", 21, 22), (4, 4, 0, 4, "cudaGraphLaunch_v1", 30, 30)], "row_id long, global_tid long, process_id long, correlation_id long, name string, start_ns long, end_ns long")
    contexts = spark.createDataFrame([(0, 1, 0)], "device_id long, context_id long, process_id long")
    spans = spark.createDataFrame([("graph", i, 0, 0, 1, i, 200, 210) for i in range(1, 5)], WORK)
    under = lambda glob: sorted(r["row_id"] for r in nesting.launched_under(spans, ranges, calls, contexts, lambda c: N.name_glob(c, glob)).collect())
    assert under("outer/inner*") == [1, 4] and under("inner*") == [1, 4] and under("outer/a/b") == [2] and under("*<unnamed>") == [4] and under("none") == []


def test_reports_are_written_with_one_shuffle(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameWriter

    from spanloom.plans import reports

    plans, write = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda w, *a, **k: (plans.append(w._df._jdf.queryExecution().optimizedPlan().toString()), plans.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, *a, **k))[-1])
    path = str(tmp_path / "t")
    spark.sql("select 1L + id % 3 as l_suppkey, 'A' as l_returnflag, id as l_orderkey, id % 30 as l_partkey, 2.0D as l_quantity, 'O' as l_linestatus from range(200)").write.parquet(f"{path}/lineitem.parquet")
    assert reports.report(spark, path)["launches"].count() == 30
    assert plans[1].count("Exchange") == 1 and "Join" not in plans[0]


def test_parts_of_reports_are_staged_as_rows(spark, tmp_path, monkeypatch):
    from spanloom.sources import kernel_reports as K

    pcs = [{"rel_address": i, "reasons": {"wait": 1, "lg": 2}} for i in range(500)]
    metrics = [{"name": "m", "value": 1.0, "instances": [{"rel_address": i, "value": float(i)} for i in range(1000)]}, {"name": "none"}, {"name": "null", "instances": None}]
    one = {"kernel_demangled": "k", "grid_size": [1, 2, 3], "metrics": metrics, "disasm": [{"address": i} for i in range(300)], "warp_stalls": {"total_samples": 9, "pcs": [*pcs, {"rel_address": 7}]}}
    (tmp_path / "r.json").write_text(json.dumps({"launches": [one, {"kernel_demangled": "bare"}], "ranges": [{"name": "a"}]}) + "\n" + json.dumps({"graphs": [{"name": "b"}]}) + "\n")
    staged, stage = [], K.stage
    monkeypatch.setattr(K, "stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    t = K.read_kernel_report(spark, str(tmp_path / "r.json"), multi_line=False)
    assert {k: d.count() for k, d in t.items()} == {"launches": 2, "metrics": 3, "instances": 1000, "sass": 300, "stalls": 1000, "workloads": 2}
    assert [d.count() for d in staged] == [2 + 3 + 1000 + 300 + 1000 + 2]  # Spark reads rows by the thousand: no row holds a report
    got = {r["name"]: r for r in t["launches"].collect()}
    assert (got["k"]["n_metrics"], got["k"]["grid_z"], got["k"]["has_listing"], got["k"]["total_samples"]) == (3, 3, True, 9)
    assert (got["bare"]["launch"], got["bare"]["n_metrics"], got["bare"]["grid_x"]) == (1, 0, None)
    assert t["instances"].filter("place = 999").first()["pc"] == 999 and {r["kind"] for r in t["workloads"].collect()} == {"range", "graph"}
