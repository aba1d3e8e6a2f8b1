"""Idle gaps, islands, concurrency: interval algebra on spans.

All of it comes from one table (``counted``), made by one pass over the spans after one for the chunk
edges of ``operators.ordered``. A span is a rise at its start and a fall at its end. Per key and
chunk of time the changes are summed in order; a chunk's total is its state for the chunks after it,
totals add up in any grouping, and the number of spans open at any time is a chunk's own running
sum and the totals before it (one row per key and chunk). Where it leaves 0 an island begins, where it
returns to 0 one ends and a gap begins; its largest value is the peak; sums of times at rises, falls,
beginnings and ends give total and union time. No key has a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.windows import clipped, overlaps
from spanloom.operators.ordered import _same, chunk_edges, chunk_of, with_next
from spanloom.staging import stage

DEVICE = ("process_id", "device_id")
LANE = ("process_id", "device_id", "stream_id")
COMPUTE, COPY = ("kernel", "graph"), ("memcpy", "memset")


def counted(spans: DataFrame, by: tuple[str, ...] = DEVICE, chunk_rows: int | None = None, classes: dict[str, Column] | None = None) -> DataFrame:
    """Per key and time ``t`` at which a span starts or ends: how many spans of each class are open
    before and after (``before_<class>``, ``after_<class>``; one class ``all`` unless given), n (spans
    that start), opener and closer (least row id of those that start and end), since (``t`` less
    the first time of all) and, if there are several, __chunk."""
    classes = classes or {"all": F.lit(True)}
    row = F.col("row_id") if "row_id" in spans.columns else F.lit(None).cast("long")
    none = F.lit(None).cast(spans.schema["row_id"].dataType if "row_id" in spans.columns else "long")
    change = lambda t, d, opener, closer: F.struct(t.alias("t"), F.lit(d).alias("d"), opener.alias("opener"), closer.alias("closer"))
    both = F.array(change(F.col("start_ns"), 1, row, none), change(F.greatest("start_ns", "end_ns"), -1, none, row))
    e = spans.select(*by, *[c.alias(f"is_{k}") for k, c in classes.items()], F.explode(both).alias("e")).select(*by, *[f"is_{k}" for k in classes], "e.*")
    edges, first = chunk_edges(e.select("t"), "t", chunk_rows)
    e = e.withColumn("__chunk", chunk_of("t", edges)).repartition(*by, "__chunk")
    net = [F.sum(F.when(F.col(f"is_{k}"), F.col("d")).otherwise(0)).alias(f"net_{k}") for k in classes]
    p = e.groupBy(*by, "__chunk", "t").agg(*net, F.count("opener" if "row_id" in spans.columns else F.when(F.col("d") > 0, 1)).alias("n"), F.min("opener").alias("opener"), F.min("closer").alias("closer"))
    upto = W.partitionBy(*by, "__chunk").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumns({f"local_{k}": F.sum(f"net_{k}").over(upto) for k in classes})
    p = stage(p, "interval_changes") if edges else p  # read twice, for totals and for states
    totals = p.groupBy(*by, "__chunk").agg(*[F.sum(f"net_{k}").alias(f"net_{k}") for k in classes])
    earlier = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum(f"net_{k}").over(earlier), F.lit(0)).alias(f"carry_{k}") for k in classes]
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__chunk").alias("__at"), *carry)
    q = p.join(totals, _same(by)) if edges else p.withColumns({f"carry_{k}": F.lit(0) for k in classes})
    after = {k: F.col(f"local_{k}") + F.col(f"carry_{k}") for k in classes}
    states = [x for k in classes for x in ((after[k] - F.col(f"net_{k}")).alias(f"before_{k}"), after[k].alias(f"after_{k}"))]
    at = ["__chunk"] if edges else []  # a table of one chunk needs none
    return q.select(*by, *at, "t", "n", "opener", "closer", (F.col("t") - F.lit(first)).cast("decimal(20,0)").alias("since"), *[F.col(f"net_{k}") for k in classes], *states)


def _turns(spans: DataFrame, by: tuple[str, ...], chunk_rows: int | None) -> DataFrame:
    """Times at which a key falls idle (``closes``), stops being idle (``opens``) or both, each with
    the ``next`` one's t and opener."""
    q = counted(spans, by, chunk_rows)
    at = [c for c in q.columns if c == "__chunk"]
    q = q.select(*by, *at, "t", "opener", "closer", ((F.col("before_all") == 0) & (F.col("n") > 0)).alias("opens"), (F.col("after_all") == 0).alias("closes")).filter("opens or closes")
    if not at:
        return q.withColumn("next", F.lead(F.struct("t", "opener")).over(W.partitionBy(*by).orderBy("t")))  # one chunk
    return with_next(q, by, ("t",), ("t", "opener"))


def near_window(spans: DataFrame, by: tuple[str, ...], window: tuple[int | None, int | None], in_order: bool = False) -> DataFrame:
    """The spans that say all about gaps that overlap a window: those that touch it, and per key the
    last before it and the first after it. What lies outside is aggregated, not sorted, and plain
    comparisons with the window reach the scan. Before the window the last is the one that ends last
    (that starts last, for gaps between neighbours ``in_order`` of start)."""
    lo, hi = window
    at = "start_ns" if in_order else "end_ns"
    inside = spans if hi is None else spans.filter(F.col("start_ns") <= hi)
    inside = inside if lo is None else inside.filter(F.col(at) >= lo)
    row = F.struct(*[c for c in spans.columns if c not in by])
    edge = lambda d, best: d.groupBy(*by).agg(best.alias("r")).select(*by, "r.*").select(*spans.columns)
    last = F.struct("start_ns", "row_id") if in_order else F.struct("end_ns", -F.col("row_id"))
    out = inside if lo is None else inside.unionByName(edge(spans.filter(F.col(at) < lo), F.max_by(row, last)))
    return out if hi is None else out.unionByName(edge(spans.filter(F.col("start_ns") > hi), F.min_by(row, F.struct("start_ns", "row_id"))))


def _seen(spans: DataFrame, by: tuple[str, ...], window: tuple[int, int] | None, in_order: bool = False) -> DataFrame:
    """What gaps are made from: the columns that matter, near the window."""
    d = spans.select(*by, "row_id", "start_ns", "end_ns")
    return d if window is None else near_window(d, by, window, in_order)


def idle_gaps(spans: DataFrame, by: tuple[str, ...] = DEVICE, min_ns: int = 1, window: tuple[int, int] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Times when nothing ran: keys, start_ns, end_ns, gap_ns, prev_row_id (the first that ended
    last), next_row_id. With a window, gaps that overlap it, in full."""
    gap = F.col("next.t") - F.col("t")
    b = _turns(_seen(spans, by, window), by, chunk_rows).filter(F.col("closes") & (gap >= max(1, min_ns)))
    g = b.select(*by, F.col("t").alias("start_ns"), F.col("next.t").alias("end_ns"), gap.alias("gap_ns"), F.col("closer").alias("prev_row_id"), F.col("next.opener").alias("next_row_id"))
    return g if window is None else overlaps(g, *window)


def stream_gaps(spans: DataFrame, by: tuple[str, ...] = LANE, min_ns: int = 1, window: tuple[int, int] | None = None) -> DataFrame:
    """Between a span and the next on its stream; overlapping neighbours leave none. With a
    window, gaps that overlap it, in full."""
    n = with_next(_seen(spans, by, window, True), by, ("start_ns", "row_id"), ("start_ns", "row_id"))
    gap = F.col("next.start_ns") - F.col("end_ns")
    n = n.filter(gap >= max(1, min_ns))
    g = n.select(*by, F.col("end_ns").alias("start_ns"), F.col("next.start_ns").alias("end_ns"), gap.alias("gap_ns"), F.col("row_id").alias("prev_row_id"), F.col("next.row_id").alias("next_row_id"))
    return g if window is None else overlaps(g, *window)


def merge_islands(spans: DataFrame, by: tuple[str, ...] = DEVICE, chunk_rows: int | None = None) -> DataFrame:
    """Busy times: keys, start_ns, end_ns. Spans that touch are one island."""
    b = _turns(spans.filter(F.col("end_ns") > F.col("start_ns")), by, chunk_rows).filter("opens")
    return b.select(*by, F.col("t").alias("start_ns"), F.col("next.t").alias("end_ns"))


def trace_gaps(spans: DataFrame, min_ns: int = 1, window: tuple[int, int] | None = None) -> DataFrame:
    """Times when no device worked: the idle gaps of all spans together. With a window, gaps that
    overlap it, in full."""
    d = spans.filter(F.col("end_ns") > F.col("start_ns")).select(F.lit(0).alias("trace"), "row_id", "start_ns", "end_ns")
    return idle_gaps(d, ("trace",), min_ns, window).select("start_ns", "end_ns", "gap_ns")


def lane_activity(spans: DataFrame, window: tuple[int, int] | None = None, by: tuple[str, ...] = LANE) -> DataFrame:
    """Per lane: n, busy_ns (clipped sum), span_ns, busy_ratio (NaN for an empty span)."""
    lo, hi = window or (None, None)
    d = overlaps(spans, lo, hi).withColumn("c", clipped(lo, hi)).filter("c > 0")
    s = F.min("start_ns") if lo is None else F.greatest(F.min("start_ns"), F.lit(lo))
    e = F.max("end_ns") if hi is None else F.least(F.max("end_ns"), F.lit(hi))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum("c").alias("busy_ns"), (e - s).alias("span_ns"))
    return g.withColumn("busy_ratio", F.when(F.col("span_ns") > 0, F.col("busy_ns") / F.col("span_ns")).otherwise(F.lit(float("nan"))))


def peak(spans: DataFrame, by: tuple[str, ...] = DEVICE, chunk_rows: int | None = None) -> DataFrame:
    """Largest number of spans at one time; an end frees before a start at the same time."""
    d = spans.filter(F.col("end_ns") > F.col("start_ns"))
    return counted(d, by, chunk_rows).groupBy(*by).agg(F.max("after_all").alias("peak"))


def _union(of: str) -> Column:
    """Time in which a class has a span open: ends of its islands less their beginnings."""
    b, a = F.col(f"before_{of}"), F.col(f"after_{of}")
    return F.coalesce(F.sum(F.when((b > 0) & (a == 0), F.col("since")).when((b == 0) & (a > 0), -F.col("since"))), F.lit(0)).cast("long")


def concurrency(spans: DataFrame, by: tuple[str, ...] = DEVICE, chunk_rows: int | None = None) -> DataFrame:
    """Per key: n, sum_ns, union_ns, overlap_ns, peak."""
    q = counted(spans.filter(F.col("end_ns") > F.col("start_ns")), by, chunk_rows)
    g = q.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(-F.col("net_all") * F.col("since")).cast("long").alias("sum_ns"), _union("all").alias("union_ns"), F.max("after_all").alias("peak"))
    return g.withColumn("overlap_ns", F.col("sum_ns") - F.col("union_ns"))


def class_overlap(spans: DataFrame, by: tuple[str, ...] = DEVICE) -> DataFrame:
    """Time when compute and copies ran together, by inclusion and exclusion."""
    kinds = {"compute": COMPUTE, "copy": COPY, "all": COMPUTE + COPY}
    d = spans.filter((F.col("end_ns") > F.col("start_ns")) & F.col("kind").isin(*kinds["all"]))
    q = counted(d, by, classes={k: F.col("kind").isin(*v) for k, v in kinds.items()})
    out = q.groupBy(*by).agg(*[_union(k).alias(f"{k}_ns") for k in kinds])
    return out.withColumn("both_ns", F.col("compute_ns") + F.col("copy_ns") - F.col("all_ns"))


def gap_overlay(spans: DataFrame, window: tuple[int, int], by: tuple[str, ...] = DEVICE) -> DataFrame:
    """Idle parts of a window between the spans in it."""
    lo, hi = window
    inside = overlaps(spans, lo, hi).withColumns({"start_ns": F.greatest("start_ns", F.lit(lo)), "end_ns": F.least("end_ns", F.lit(hi))})
    return idle_gaps(inside, by).select(*by, "start_ns", "end_ns", "gap_ns")
