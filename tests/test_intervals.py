"""Interval operators against hand-computed answers and brute force."""

import random

import pytest

from spanloom.functions import windows as T
from spanloom.operators import buckets, intervals, ordered

DDL = "row_id long, kind string, process_id long, device_id long, stream_id long, start_ns long, end_ns long"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DDL)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(5)
    rows = []
    for _ in range(400):
        s = r.randrange(0, 3000)
        rows.append((r.choice(["kernel", "memcpy", "memset", "graph"]), r.randrange(2), r.randrange(2), r.randrange(3), s, s + r.choice([0, 1, 2, 5, 9])))
    return rows, table(spark, rows).cache()


def islands(spans):
    out = []
    for s, e in sorted(spans):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def by_device(rows):
    out = {}
    for k, p, d, _, s, e in rows:
        out.setdefault((p, d), []).append((s, e, k))
    return out


def test_touching_spans_are_one_island_and_leave_no_gap(spark):
    t = table(spark, [("kernel", 0, 0, 1, 0, 10), ("kernel", 0, 0, 2, 10, 20), ("kernel", 0, 0, 1, 25, 30), ("kernel", 0, 0, 1, 26, 27), ("kernel", 0, 0, 1, 31, 32)])
    assert got(intervals.merge_islands(t), "start_ns", "end_ns") == [(0, 20), (25, 30), (31, 32)]
    assert got(intervals.idle_gaps(t), "start_ns", "end_ns", "prev_row_id", "next_row_id") == [(20, 25, 1, 2), (30, 31, 2, 4)]
    assert got(intervals.idle_gaps(t, min_ns=5), "gap_ns") == [(5,)]
    assert got(intervals.idle_gaps(t, window=(0, 25)), "start_ns") == [(20,)]


def test_an_end_frees_before_a_start(spark):
    t = table(spark, [("kernel", 0, 0, 1, 0, 10), ("kernel", 0, 0, 2, 10, 20), ("kernel", 0, 0, 3, 12, 14), ("kernel", 0, 0, 3, 13, 13)])
    assert got(intervals.concurrency(t), "n", "sum_ns", "union_ns", "overlap_ns", "peak") == [(3, 22, 20, 2, 2)]


@pytest.mark.parametrize("rows_in_chunk", [1, 7, 10**6])
def test_islands_and_peaks_match_brute_force(some, rows_in_chunk):
    rows, df = some
    want = sorted((*k, *i) for k, v in by_device(rows).items() for i in islands([(s, e) for s, e, _ in v]))
    assert got(intervals.merge_islands(df, chunk_rows=rows_in_chunk), "process_id", "device_id", "start_ns", "end_ns") == want
    peaks = sorted((*k, max(sum(s <= t < e for s, e, _ in v) for t in range(3020))) for k, v in by_device(rows).items())
    assert got(intervals.peak(df, chunk_rows=rows_in_chunk), "process_id", "device_id", "peak") == peaks


def test_gaps_and_islands_tile_the_span(some):
    rows, df = some
    for (p, d), v in by_device(rows).items():
        i = islands([(s, e) for s, e, _ in v])
        one = df.filter(f"process_id = {p} and device_id = {d} and end_ns > start_ns")
        gaps = got(intervals.idle_gaps(one), "gap_ns")
        assert sum(g for g, in gaps) + sum(e - s for s, e in i) == i[-1][1] - i[0][0]


def test_class_overlap_is_inclusion_exclusion(some):
    rows, df = some
    for r in intervals.class_overlap(df).collect():
        v = by_device(rows)[(r["process_id"], r["device_id"])]
        on = lambda kinds, t, v=v: any(s <= t < e for s, e, k in v if k in kinds)
        assert r["both_ns"] == sum(on(intervals.COMPUTE, t) and on(intervals.COPY, t) for t in range(3020))


def test_trace_gaps_need_all_devices_idle(spark):
    t = table(spark, [("kernel", 0, 0, 1, 0, 10), ("kernel", 1, 0, 1, 5, 30), ("kernel", 0, 0, 1, 40, 50)])
    assert got(intervals.trace_gaps(t), "start_ns", "end_ns", "gap_ns") == [(30, 40, 10)]


def test_bucket_parts_add_up_and_negative_times_floor(some, spark):
    rows, df = some
    b = buckets.activity(df, 10).collect()
    assert sum(r["total_ns"] for r in b) == sum(e - s for *_, s, e in rows)
    one = table(spark, [("kernel", 0, 0, 0, -15, 5)])
    assert got(buckets.activity(one, 10), "bucket_ns", "total_ns") == [(-20, 5), (-10, 10), (0, 5)]


def test_windows(spark):
    t = table(spark, [("kernel", 0, 0, 0, 0, 10), ("kernel", 0, 0, 0, 10, 20), ("kernel", 0, 0, 0, -5, 3), ("kernel", 0, 0, 0, 8, 8)])
    assert got(T.overlaps(t, 0, 10), "row_id") == [(0,), (2,), (3,)]
    assert got(T.positive_intervals(t, 5, 15), "row_id", "start_ns", "end_ns") == [(0, 5, 10), (1, 10, 15)]
    assert got(t.filter(T.duration_filter("range", 8, 10)), "row_id") == [(0,), (1,), (2,)]
    with pytest.raises(ValueError):
        T.duration_filter("=", 1)


def test_no_rows(spark):
    t = table(spark, [])
    for f in (intervals.idle_gaps, intervals.merge_islands, intervals.concurrency, intervals.trace_gaps, intervals.class_overlap, intervals.stream_gaps, intervals.lane_activity):
        assert f(t).count() == 0


def test_one_minute_of_one_device_is_dealt_to_many_chunks(spark):
    t = table(spark, [("kernel", 0, 0, 0, i * 60_000, i * 60_000 + 100) for i in range(1000)])
    chunks = ordered.chunked(t, "start_ns", 50).groupBy("__chunk").count().collect()
    assert len(chunks) == 20 and max(r["count"] for r in chunks) <= 51
    assert intervals.counted(t, chunk_rows=50).select("__chunk").distinct().count() == 40  # starts and ends


def test_one_wrong_time_moves_no_edge(spark):
    rows = [(i, 10**15 + i * 1000) for i in range(4000)]
    for wrong in (0, -(10**18), 9 * 10**18):
        t = spark.createDataFrame([*rows, (-1, wrong)], "row_id long, ts long")
        assert max(r["count"] for r in ordered.chunked(t, "ts", 400).groupBy("__chunk").count().collect()) <= 402
    burst = spark.createDataFrame([(i, 10**15 + (i if i < 3000 else i * 10**9)) for i in range(4000)], "row_id long, ts long")
    assert max(r["count"] for r in ordered.chunked(burst, "ts", 400).groupBy("__chunk").count().collect()) <= 402


@pytest.mark.parametrize("rows_in_chunk", [3, 10**6])
def test_gaps_with_evidence_match_a_plain_sweep(some, rows_in_chunk):
    rows, df = some
    want = []
    for key in by_device(rows):
        busy = None
        for s, i, e in sorted((s, i, e) for i, (_, p, d, _, s, e) in enumerate(rows) if (p, d) == key):
            if busy and s > busy[0]:
                want.append((*key, busy[0], s, -busy[1], i))
            busy = max(busy or (e, -i), (e, -i))
    cols = ("process_id", "device_id", "start_ns", "end_ns", "prev_row_id", "next_row_id")
    assert got(intervals.idle_gaps(df, chunk_rows=rows_in_chunk), *cols) == sorted(want)


def test_gaps_of_a_window_are_those_of_the_whole_and_reach_the_scan(some, spark, tmp_path):
    rows, df = some
    thin = df.filter("row_id % 9 = 0")
    thin.write.parquet(str(tmp_path / "spans"))
    thin = spark.read.parquet(str(tmp_path / "spans"))
    cols = ("start_ns", "end_ns", "prev_row_id", "next_row_id")
    for make, by in ((intervals.idle_gaps, intervals.DEVICE), (intervals.stream_gaps, intervals.LANE)):
        whole = got(make(thin, by), *by, *cols)
        for lo, hi in ((0, 2000), (450, 451), (900, 990), (1350, 3350)):
            mine = [g for g in whole if g[len(by)] < hi and g[len(by) + 1] > lo]
            assert got(make(thin, by, window=(lo, hi)), *by, *cols) == mine
    how = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = intervals.near_window(thin, intervals.DEVICE, (100, 200))._jdf.queryExecution().explainString(how)
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x]
    assert any("LessThanOrEqual(start_ns,200)" in x and "GreaterThanOrEqual(end_ns,100)" in x for x in pushed) and "Window" not in plan


@pytest.mark.parametrize("rows_in_chunk", [1, 3, 10**6])
def test_neighbours_and_ordinals_match_plain_order(spark, rows_in_chunk):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", None]), r.randrange(30)) for i in range(120)] + [(900, "c", 5)]
    t = spark.createDataFrame(rows, "row_id long, k string, ts long")
    order, key = ("ts", "row_id"), lambda x: (x[2], x[0])
    after, before, nth = {}, {}, {}
    for k in ("a", "b", "c", None):
        mine = sorted((x for x in rows if x[1] == k), key=key)
        for n, x in enumerate(mine):
            nth[x[0]], before[x[0]], after[x[0]] = n, mine[n - 1][0] if n else None, mine[n + 1][0] if n + 1 < len(mine) else None
    got_next = ordered.with_next(t, ("k",), order, ("row_id",), rows=rows_in_chunk).select("row_id", "next.row_id").collect()
    got_prev = ordered.with_previous(t, ("k",), order, ("row_id",), rows=rows_in_chunk).select("row_id", "previous.row_id").collect()
    got_nth = ordered.with_ordinal(t, ("k",), order, "nth", rows=rows_in_chunk).collect()
    assert {a: b for a, b in got_next} == after and {a: b for a, b in got_prev} == before and {x["row_id"]: x["nth"] for x in got_nth} == nth
