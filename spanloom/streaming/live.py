"""Spans that arrive over time: activity buckets with a watermark, idle gaps by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.buckets import in_buckets
from spanloom.operators.intervals import DEVICE


def live_activity(spans: DataFrame, bucket: str, late: str) -> DataFrame:
    """Per tumbling bucket: n and total time. ``spans`` is a stream with row_id, start_ns, end_ns;
    a span counts where it starts, with its whole time; a bucket leaves when the watermark has
    passed it, and spans later than that are dropped."""
    s = spans.withColumn("at", F.timestamp_micros(F.expr("start_ns div 1000"))).withWatermark("at", late)
    g = s.groupBy(F.window("at", bucket)).agg(F.count("*").alias("n"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("total_ns"))
    return g.select((F.unix_micros("window.start") * 1000).alias("bucket_ns"), "n", "total_ns")


def live_busy(spans: DataFrame, width_ns: int, late: str) -> DataFrame:
    """Per bucket that a span touches: n and the time inside it. A bucket leaves when the watermark
    has passed it."""
    s = in_buckets(spans, width_ns).withColumn("at", F.timestamp_micros(F.expr("bucket_ns div 1000"))).withWatermark("at", late)
    g = s.groupBy(F.window("at", f"{width_ns // 1000} microseconds")).agg(F.count("*").alias("n"), F.sum("part_ns").alias("total_ns"))
    return g.select((F.unix_micros("window.start") * 1000).alias("bucket_ns"), "n", "total_ns")


#: Per device: the busy times that can still change, the time up to which gaps are told, the latest
#: start seen, and how many spans came too late.
_STATE = "starts array<long>, ends array<long>, upto long, top long, late long"
_GAP = "process_id long, device_id long, start_ns long, end_ns long, gap_ns long, late long"


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Islands of spans, in order; what touches is one."""
    order = np.argsort(starts, kind="stable")
    starts, busy = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > busy[:-1]])
    return starts[first], busy[np.r_[first[1:] - 1, len(busy) - 1]]


def _gaps_of(late_ns: int, min_ns: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else ([], [], None, None, 0)
        starts, ends, upto, top, before = np.array(known[0], dtype=np.int64), np.array(known[1], dtype=np.int64), *known[2:]
        late = 0
        for p in parts:
            s, e = p["start_ns"].to_numpy(dtype=np.int64), p["end_ns"].to_numpy(dtype=np.int64)
            if upto is not None:
                good = s >= upto
                late += int((~good).sum())
                s, e = s[good], e[good]
            if len(s):
                top = int(s.max()) if top is None else max(top, int(s.max()))
                starts, ends = _merged(np.r_[starts, s], np.r_[ends, np.maximum(s, e)])
        out = []
        if top is not None:
            upto = top - late_ns if upto is None else max(upto, top - late_ns)
            told = int(np.searchsorted(starts, upto, side="right"))  # islands that begin up to then
            a, b = ends[: max(told - 1, 0)], starts[1:told]
            wide = b - a >= max(1, min_ns)
            out.append(pd.DataFrame({"start_ns": a[wide], "end_ns": b[wide], "gap_ns": (b - a)[wide]}).assign(late=0))
            starts, ends = starts[max(told - 1, 0) :], ends[max(told - 1, 0) :]
            state.update((starts.tolist(), ends.tolist(), upto, top, before + late))
        if late:
            out.append(pd.DataFrame({"start_ns": [None], "end_ns": [None], "gap_ns": [None], "late": [late]}))
        for o in out:
            if len(o):
                yield o.assign(process_id=key[0], device_id=key[1]).astype("Int64")[[c.split()[0] for c in _GAP.split(", ")]]

    return step


def live_gaps(spans: DataFrame, *, late_ns: int, min_ns: int = 1) -> DataFrame:
    """Idle gaps per device of a stream of spans (process_id, device_id, start_ns, end_ns) that come
    in any order within ``late_ns``: process_id, device_id, start_ns, end_ns, gap_ns, late.

    A gap is told once the latest start seen of its device lies ``late_ns`` past its end. A span that
    starts before the time up to which gaps are told is late: it is left out and counted, in a row
    without times whose ``late`` says how many there were in that trigger. State is kept by Spark
    per device: the busy times that can still change, merged. So it grows with the gaps of the last
    ``late_ns``, not with the stream, and a restart goes on from the last trigger. The spans of one
    device and trigger are read by one task, a batch at a time: bound triggers at the source."""
    rows = spans.select(*DEVICE, "start_ns", "end_ns").filter("start_ns is not null and end_ns is not null")
    return rows.groupBy(*DEVICE).applyInPandasWithState(_gaps_of(late_ns, min_ns), _GAP, _STATE, "append", GroupStateTimeout.NoTimeout)


def start_gaps(spans: DataFrame, folder: str, *, late_ns: int, min_ns: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Writes ``live_gaps`` of a stream to ``folder``, with the stream's checkpoint."""
    w = live_gaps(spans, late_ns=late_ns, min_ns=min_ns).writeStream.format("parquet").option("path", f"{folder}/gaps").option("checkpointLocation", f"{folder}/checkpoint")
    return w.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_GAP).parquet(f"{folder}/gaps")


def told_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps that have been told."""
    return _written(spark, folder).filter("start_ns is not null").drop("late")


def late_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Per device how many spans came too late and were left out."""
    return _written(spark, folder).filter("start_ns is null").groupBy(*DEVICE).agg(F.sum("late").alias("late"))


def last_gaps(spark: SparkSession, folder: str, *, min_ns: int = 1) -> DataFrame:
    """Once the stream has ended: the gaps that were still held back after its last trigger, from the
    state that Spark keeps."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint").select("key.*", "value.groupState.*")
    held = state.select(*DEVICE, F.explode(F.arrays_zip("starts", "ends")).alias("i")).select(*DEVICE, "i.*")
    held = held.withColumn("busy", F.lag("ends").over(W.partitionBy(*DEVICE).orderBy("starts")))
    gap = F.col("starts") - F.col("busy")
    return held.filter(gap >= max(1, min_ns)).select(*DEVICE, F.col("busy").alias("start_ns"), F.col("starts").alias("end_ns"), gap.alias("gap_ns"))
