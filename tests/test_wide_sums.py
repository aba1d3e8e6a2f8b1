"""Times that add up to more than 64 bits hold."""

from pyspark.sql import functions as F

from spanloom.functions.sums import fitted, wide_sum
from spanloom.operators import chrome as C
from spanloom.operators import correlate as L
from spanloom.operators import nesting as R
from spanloom.operators import sampling as P
from spanloom.operators import stats

BIG = 2**62


def _spans(spark):
    rows = [(i, f"n{i}", 0, BIG, 8) for i in range(4)]
    return spark.createDataFrame(rows, "row_id long, name string, start_ns long, end_ns long, bytes long")


def test_share_of_a_whole_beyond_64_bits(spark):
    got = {r["name"]: (r["total"], r["share"]) for r in stats.span_stats(_spans(spark), ("name",)).collect()}
    assert got == {f"n{i}": (BIG, 0.25) for i in range(4)}


def test_listing_totals_beyond_64_bits(spark):
    t = stats.span_stats(_spans(spark), ("name",)).select("name", "n", "total")
    got = L.listing(t, "name", {"name": "asc"}, (), 2, ("n", "total"))
    assert {(r["all_n"], r["all_total"]) for r in got.collect()} == {(4, 4 * BIG)}
    assert dict(fitted(got, "all_n", "all_total").dtypes)["all_n"] == "bigint"


def test_slice_times_beyond_64_bits(spark):
    s = spark.createDataFrame([("a", i, BIG, 0, 0) for i in range(4)], "name string, range_id long, kernel_ns long, memcpy_ns long, memset_ns long")
    assert [(r["instances"], r["total"]) for r in R.slice_stats(s).collect()] == [(4, 4 * BIG)]
    e = spark.createDataFrame([("a", BIG, 1, BIG, BIG)] * 4, "slice string, ns long, children long, gpu_ns long, comm_ns long")
    assert [tuple(r) for r in C.event_slice_stats(e).collect()] == [("a", 4, 4 * BIG, 4, 4 * BIG, 4 * BIG)]


def test_scheduler_times_beyond_64_bits(spark):
    rows = [(10 * t + i, t, 0, at, i % 2 ^ 1, "s") for t in range(4) for i, at in enumerate((0, BIG, BIG + BIG // 2))]
    t = spark.createDataFrame(rows, "row_id long, global_tid long, cpu long, start_ns long, is_in int, state string")
    assert [(r["on_ns"], r["off_ns"], r["quanta"], r["mean_ns"]) for r in P.cpu_time(t).collect()] == [(4 * BIG, 0, 4, BIG)]
    assert [(r["off_ns"], r["on_ns"], r["mean_ns"]) for r in P.state_time(t).collect()] == [(2 * BIG, 4 * BIG, BIG)]


def test_sums_that_fit_are_longs(spark):
    t = spark.createDataFrame([("a", 1), ("a", BIG), ("b", None)], "k string, v long").groupBy("k").agg(wide_sum("v").alias("v"), wide_sum(F.col("v") - 1).alias("w"))
    got = fitted(t, "v", "w")
    assert dict(got.dtypes) == {"k": "string", "v": "bigint", "w": "bigint"} and {tuple(r) for r in got.collect()} == {("a", BIG + 1, BIG - 1), ("b", None, None)}
    more = fitted(t.unionByName(t.withColumn("v", F.col("v") * 8)), "v", "w")
    assert dict(more.dtypes)["v"].startswith("decimal") and max(r["v"] for r in more.collect() if r["v"]) == 8 * (BIG + 1)
