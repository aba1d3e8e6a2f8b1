"""Chrome-trace events: statistics, nesting, steps, flows, links, causes and collectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.sums import wide_sum
from spanloom.functions.windows import overlaps
from spanloom.operators.around import best_around
from spanloom.operators.buckets import in_buckets
from spanloom.operators.nesting import contains_join
from spanloom.operators.ordered import with_ordinal, with_previous
from spanloom.operators.stats import measures
from spanloom.staging import stage

GPU = ("kernel", "memcpy", "memset")
CALLS = ("runtime", "driver")


def _gpu(column: str = "type") -> Column:
    return F.col(column).isin(*GPU)


def timed(events: DataFrame) -> DataFrame:
    """Events proper: all but the markers of flows."""
    return events.filter(~(F.coalesce(F.col("ph").isin("s", "t", "f"), F.lit(False)) & F.col("flow_id").isNotNull())) if "flow_id" in events.columns else events


#: What links, steps and collectives are made of.
NARROW = ("trace", "row_id", "type", "comm", "collective", "start_ns", "end_ns", "rank", "pid", "tid", "external_id", "correlation", "step_no", "ph", "flow_id")


def narrow(events: DataFrame) -> DataFrame:
    """The columns that links, steps and collectives are made of, written once for their many readers:
    where ids come from arguments, each would take all arguments apart again."""
    return stage(events.select(*[c for c in NARROW if c in events.columns]), "narrow_events")


def filter_events(events: DataFrame, types: tuple[str, ...] = (), comm: bool = False, test: Column | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Events of any of the types, or communication if asked; other tests all hold."""
    kind = F.col("type").isin(*types) if types else F.lit(not comm)
    d = events.filter(kind | (F.lit(comm) & F.col("comm")))
    d = d if test is None else d.filter(test)
    return d if window is None else overlaps(d, *window)


def event_stats(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Measures of durations per group; a null in an axis is ``none``. Axes are columns of the
    events; ``with_axes`` adds those that other operators find."""
    d = timed(events).withColumn("ns", F.col("end_ns") - F.col("start_ns"))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in by]
    return d.groupBy(*keys).agg(*measures()).filter("n > 0")


def with_axes(events: DataFrame) -> DataFrame:
    """Events with the axes step (of the step around them, else their own), comm_kind,
    python_context and python_path."""
    steps = assign_steps(events).select("row_id", F.col("step_no").alias("__step"))
    paths = python_context(events).select("row_id", F.col("python_path"), F.element_at(F.split("python_path", " > "), -1).alias("python_context"))
    d = events.join(steps, "row_id", "left").join(paths, "row_id", "left")
    return d.withColumns({"step": F.coalesce("__step", "step_no"), "comm_kind": F.col("collective")}).drop("__step")


def event_buckets(events: DataFrame, width: int, anchor: int = 0) -> DataFrame:
    """Per bucket: n, time on CPU, on GPU, in communication, and a map of time by type."""
    d = in_buckets(timed(events), width, anchor)
    of = lambda test, name: F.sum(F.when(test, F.col("part_ns")).otherwise(0)).alias(name)
    g = d.groupBy("bucket_ns", "type").agg(F.count("*").alias("n"), of(~_gpu(), "cpu_ns"), of(F.col("type").isin(*GPU), "gpu_ns"), of(F.col("comm"), "comm_ns"), F.sum("part_ns").alias("ns"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "ns"))))  # a few
    return g.groupBy("bucket_ns").agg(*[F.sum(c).alias(c) for c in ("n", "cpu_ns", "gpu_ns", "comm_ns")], types.alias("by_type_ns"))


def smallest_enclosing(events: DataFrame, outer: DataFrame, on: tuple[str, ...], same_rank: bool = True) -> DataFrame:
    """(row_id, outer_id): the shortest of ``outer`` around each event, then the earliest, then
    by id; an event is not around itself, and known ranks have to agree."""
    o = outer.select(*on, F.col("row_id").alias("outer_id"), "rank", F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"))
    i = events.select(*on, "row_id", "rank", F.col("start_ns").alias("i_start"), F.col("end_ns").alias("i_end"))
    if same_rank:  # a known rank asks for itself and for none, an unknown one for any
        rank, none, any_ = F.col("rank").cast("string"), F.lit("none"), F.lit("any")
        o = o.withColumn("rank", F.explode(F.array(F.coalesce(rank, none), any_)))
        i = i.withColumn("rank", F.explode(F.when(rank.isNull(), F.array(any_)).otherwise(F.array(rank, none))))
    return best_around(o, i, [*on, *["rank"][:same_rank]], (F.col("o_end") - F.col("o_start"), F.col("o_start")))


def event_parents(events: DataFrame, of: Column | None = None) -> DataFrame:
    """(row_id, parent_id) of events with time that aren't device work (and pass ``of``), on one thread: the
    innermost event around each that comes before it by start, then length, then id."""
    d = timed(events).filter(~_gpu() & (F.col("end_ns") > F.col("start_ns")))
    on = ["trace", "r", "t"]
    d = d.withColumns({"r": F.coalesce("rank", F.lit(-1)), "t": F.coalesce(F.col("tid").cast("string"), F.lit(""))})
    o = d.select(*on, F.col("row_id").alias("outer_id"), F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"))
    i = (d if of is None else d.filter(of)).select(*on, "row_id", F.col("start_ns").alias("i_start"), F.col("end_ns").alias("i_end"))
    return best_around(o, i, on, (-F.col("o_start"), F.col("o_end")), last_id=True, before=True).withColumnRenamed("outer_id", "parent_id")


def assign_steps(events: DataFrame, of: Column | None = None) -> DataFrame:
    """(row_id, step_id, step_no): the smallest numbered step around each other event (that passes
    ``of``) of a compatible rank."""
    steps = events.filter("type = 'step' and step_no is not null")
    asked = timed(events).filter("type <> 'step'")
    found = smallest_enclosing(asked if of is None else asked.filter(of), steps, ("trace",))
    return found.withColumnRenamed("outer_id", "step_id").join(steps.select(F.col("row_id").alias("step_id"), "step_no"), "step_id")


def _in_scope(scope: dict[str, int]) -> Column:
    test = F.lit(True)
    for c, v in scope.items():
        test = test & (F.col(c) == v)
    return test


def event_slices(events: DataFrame, *, window: tuple[int, int] | None = None, step: int | None = None, **scope: int) -> DataFrame:
    """Steps and annotations with the number of their direct children, and the time of the device
    work and communication inside them, cut to the window if there is one; ranks have to agree
    where both are known. With a scope (``rank``, ``device``, ``stream``) a slice stays if it, or
    an event inside it, lies in the scope and it isn't known to lie outside; only events in the
    scope (and ``step``) add time."""
    e = timed(events)
    s = e.filter("type in ('step', 'annotation')")
    s = s if window is None else overlaps(s, *window)
    s = s if step is None else s.filter(F.col("step_no") == step)
    for c, v in scope.items():
        s = s.filter(F.col(c).isNull() | (F.col(c) == v))
    o = s.select("trace", F.col("row_id").alias("slice_id"), F.col("name").alias("slice"), F.col("step_no").alias("slice_step"), F.col("rank").alias("o_rank"), F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"), _in_scope(scope).alias("direct"))
    i = e.select("trace", "row_id", "type", "comm", "step_no", *{"rank", *scope}, F.col("start_ns").alias("i_start"), F.col("end_ns").alias("i_end"))
    met = contains_join(o, i, ["trace"]).filter("slice_id <> row_id")
    lo, hi = window or (None, None)
    here = F.lit(True) if window is None else (F.col("i_start") < hi) & (F.col("i_end") > lo)
    ns = (F.col("i_end") if hi is None else F.least("i_end", F.lit(hi))) - (F.col("i_start") if lo is None else F.greatest("i_start", F.lit(lo)))
    agree = F.lit(True) if "rank" in scope else F.expr("rank is null or o_rank is null or rank = o_rank")
    counts = agree & here & _in_scope(scope) & (F.lit(True) if step is None else F.col("step_no") == step) & (F.col("i_end") > F.col("i_start"))
    of = lambda test, name: F.sum(F.when(F.coalesce(counts & test, F.lit(False)), ns).otherwise(0)).alias(name)
    g = met.groupBy("slice_id").agg(of(_gpu(), "gpu_ns"), of(F.col("comm"), "comm_ns"), F.coalesce(F.bool_or(here & _in_scope(scope)), F.lit(False)).alias("inside"))
    children = event_parents(events).groupBy(F.col("parent_id").alias("slice_id")).agg(F.count("*").alias("children"))
    own = o.select("slice_id", "slice", "slice_step", (F.col("o_end") - F.col("o_start")).alias("ns"), "direct")
    d = own.join(g, "slice_id", "left").join(children, "slice_id", "left").fillna(0, ["children", "gpu_ns", "comm_ns"])
    d = d.filter(F.coalesce("direct", F.lit(False)) | F.coalesce("inside", F.lit(False))) if scope else d
    return d.drop("direct", "inside")


def event_slice_stats(slices: DataFrame, by: str = "slice") -> DataFrame:
    """Per name, or per step (``slice_step``): instances and sums; those of times are decimals."""
    key = F.coalesce(F.col(by).cast("string"), F.lit("none")).alias(by)
    return slices.groupBy(key).agg(F.count("*").alias("instances"), wide_sum("ns").alias("ns"), F.sum("children").alias("children"), wide_sum("gpu_ns").alias("gpu_ns"), wide_sum("comm_ns").alias("comm_ns"))


def _python_parents(events: DataFrame) -> DataFrame:
    """(row_id, name, up): Python frames with the row of the frame above: by parent id within a
    thread, else the event around it if that is a frame. Of frames that share an id the last counts."""
    on = [c for c in ("pid", "tid") if c in events.columns]
    p = events.filter("type = 'python'").select("trace", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in on], "row_id", "name", "python_id", "python_parent")
    by_id = p.filter("python_id is not null").groupBy("trace", *on, F.col("python_id").alias("python_parent")).agg(F.max("row_id").alias("by_id"))
    p = p.join(by_id, ["trace", *on, "python_parent"], "left").withColumn("by_id", F.when(F.col("by_id") != F.col("row_id"), F.col("by_id")))
    if {"start_ns", "end_ns", "tid", "rank", "ph"} <= set(events.columns):
        around = event_parents(events, F.col("type") == "python").join(events.filter("type = 'python'").select(F.col("row_id").alias("parent_id")), "parent_id", "left_semi")
        p = p.join(around, "row_id", "left")
    else:
        p = p.withColumn("parent_id", F.lit(None).cast("long"))
    return p.select("row_id", "name", F.coalesce("by_id", "parent_id").alias("up"))


def python_context(events: DataFrame, depth: int | None = None) -> DataFrame:
    """(row_id, python_path): names of the frames above a frame and itself, outermost first, and
    the path of the innermost frame around other events that aren't device work (an event that
    starts in a frame and goes on past it ends the frame). Paths double in a round, so rounds are few; a path ends where a frame would come again. ``depth`` cuts paths if it is given.
    Without frames no event is sorted or met."""
    if events.filter("type = 'python'").isEmpty():
        return events.select("row_id", F.lit("").alias("python_path")).limit(0)
    p = _python_parents(events)
    walk = stage(p.select("row_id", F.array(F.struct("row_id", "name")).alias("path"), F.col("up").alias("next")), "python_walk")
    ids = lambda c: F.transform(c, lambda x: x["row_id"])
    while not walk.filter("next is not null").isEmpty():
        above = walk.select(F.col("row_id").alias("next"), F.col("path").alias("more"), F.col("next").alias("then"))
        again = F.coalesce(F.arrays_overlap(ids("path"), ids("more")), F.lit(False))
        known = F.transform("more", lambda x, i: F.when(F.array_contains(ids("path"), x["row_id"]), i))
        more = F.when(again, F.slice("more", F.lit(1), F.array_min(known))).otherwise(F.col("more"))
        longer = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", more))
        walk = stage(walk.join(above, "next", "left").select("row_id", longer.alias("path"), F.when(~again, F.col("then")).alias("next")), "python_walk")
    path = F.col("path") if depth is None else F.slice("path", 1, depth + 1)
    frames = walk.select("row_id", F.array_join(F.reverse(F.transform(path, lambda x: x["name"])), " > ").alias("python_path"))
    if not {"start_ns", "end_ns", "pid", "tid"} <= set(events.columns):
        return frames
    on = ["trace", "pid", "tid"]
    d = timed(events).filter(~_gpu() & (F.col("end_ns") > F.col("start_ns"))).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("pid", "tid")})
    o = d.filter("type = 'python'").select(*on, F.col("row_id").alias("frame_id"), F.col("start_ns").alias("o_start"), F.col("end_ns").alias("o_end"))
    i = d.select(*on, "row_id", "type", F.col("start_ns").alias("i_start"), F.col("start_ns").alias("i_end"), F.col("end_ns").alias("ends"))
    after = "o_start < i_start or o_end > ends or (o_end = ends and frame_id < row_id)"
    met = stage(contains_join(o, i, on).filter(after), "python_met")
    place = F.struct(F.col("i_start").alias("s"), (-F.col("ends")).alias("e"), F.col("row_id").alias("id"))
    cut = met.filter("ends > o_end").groupBy("frame_id").agg(F.min(place).alias("cut"))  # an event that goes on past a frame ends it
    met = met.filter("ends <= o_end and type <> 'python'").join(cut, "frame_id", "left").filter(F.col("cut").isNull() | (place < F.col("cut")))
    near = met.groupBy("row_id").agg(F.max(F.struct("o_start", (-F.col("o_end")).alias("e"), "frame_id"))["frame_id"].alias("frame_id"))
    frames = frames.join(d.select("row_id"), "row_id", "left_semi").unionByName(near.join(frames.withColumnRenamed("row_id", "frame_id"), "frame_id").select("row_id", "python_path"))
    return frames


def flow_edges(events: DataFrame) -> DataFrame:
    """(from_row_id, to_row_id) for consecutive markers of a flow, each bound to the smallest
    event around it on its thread; markers without one are passed over."""
    m = events.filter("ph in ('s', 't', 'f') and flow_id is not null")
    bound = smallest_enclosing(m, timed(events), ("trace", "pid", "tid"), same_rank=False)
    m = m.join(bound, "row_id")
    before = F.lag("outer_id").over(W.partitionBy("trace", "flow_id").orderBy("start_ns", "ph", "row_id"))
    return m.select(before.alias("from_row_id"), F.col("outer_id").alias("to_row_id")).filter("from_row_id is not null and from_row_id <> to_row_id").distinct()


def asof_launcher(events: DataFrame) -> DataFrame:
    """(launcher, row_id): per device event and kind of launcher the latest call of its correlation
    that started at or before it. Ranks have to be equal, unless the correlation knows one at most."""
    d = timed(events).filter(F.col("correlation").isNotNull() & (_gpu() | F.col("type").isin(*CALLS)))
    on = ["trace", "correlation"]
    ranks = d.groupBy(*on).agg(F.countDistinct("rank").alias("ranks"))
    d = d.select(*on, "row_id", "type", "rank", "start_ns").join(ranks, on)
    d = d.withColumn("r", F.when(F.col("ranks") > 1, F.coalesce("rank", F.lit(-1))).otherwise(F.lit(-2)))
    upto = W.partitionBy(*on, "r").orderBy("start_ns", _gpu().cast("int"), "row_id")
    last = [F.last(F.when(F.col("type") == t, F.col("row_id")), ignorenulls=True).over(upto) for t in CALLS]
    return d.select("row_id", "type", F.array(*last).alias("by")).filter(_gpu()).select(F.explode("by").alias("launcher"), "row_id").filter("launcher is not null")


def external_chain(events: DataFrame) -> DataFrame:
    """(before, row_id): events of one external id in order of start, each with the one before it of
    its rank. Where the id knows one rank, events without rank are linked with those before of it,
    and those with the ones before that have none."""
    d = timed(events).filter("external_id is not null").select("trace", "external_id", "rank", "row_id", "start_ns")
    chain = with_previous(d, ("trace", "external_id", "rank"), ("start_ns", "row_id"), ("row_id",))
    own = chain.select(F.col("previous.row_id").alias("before"), "row_id")
    on = ["trace", "external_id"]
    mixed = d.groupBy(*on).agg(F.countDistinct("rank").alias("ranks"), F.bool_or(F.col("rank").isNull()).alias("some_without")).filter("ranks = 1 and some_without")
    order = W.partitionBy(*on).orderBy("start_ns", "row_id").rowsBetween(W.unboundedPreceding, -1)
    last = lambda test: F.last(F.when(test, F.col("row_id")), ignorenulls=True).over(order)
    none = F.col("rank").isNull()
    other = d.join(mixed, on, "left_semi").select(F.when(none, last(~none)).otherwise(last(none)).alias("before"), "row_id")
    return own.unionByName(other).filter("before is not null")


LINKS = ("nesting", "step", "external", "correlation", "flow")


def event_links(events: DataFrame, kinds: tuple[str, ...] = LINKS) -> DataFrame:
    """(from_row_id, to_row_id, kind) of the kinds asked. No kind repeats a link, so nothing has to be made
    distinct over kinds."""
    made = {
        "nesting": (event_parents, "parent_id"), "step": (assign_steps, "step_id"), "external": (external_chain, "before"), "correlation": (asof_launcher, "launcher"), "flow": (flow_edges, "from_row_id"),
    }
    out = None
    for kind in kinds:
        links, above = made[kind]
        part = links(events).select(F.col(above).alias("from_row_id"), F.col("to_row_id" if kind == "flow" else "row_id").alias("to_row_id"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


CAUSAL = ("external", "correlation", "flow")


def causal_chain(seeds: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """(seed, row_id, direction, hops): what led to a seed and what it led to. Device work is
    followed up, calls of the runtime and driver up and down, all else down. Correlations and
    flows are followed along their direction (against it upwards). External ids are followed
    forwards and not from device work, backwards not from it unless it is the seed, in order of
    start, and never from or (downwards) to another host event that isn't a call: such a cause of
    its own is where a walk ends. Device work ends a walk down. Calls that launch a found kernel
    are told with it. Walks go on until nothing new is found, so cycles end and chains are whole."""
    kind = F.when(_gpu(), "gpu").when(F.col("type").isin(*CALLS), "call").otherwise("root")
    e = stage(timed(events).select("row_id", kind.alias("is"), "start_ns"), "causal_events")
    side = lambda x: e.select(F.col("row_id").alias(x), F.col("is").alias(f"{x}_is"), F.col("start_ns").alias(f"{x}_start"))
    l_ = stage(links.filter(F.col("kind").isin(*CAUSAL)), "causal_links")  # read three times
    steps = l_.select(F.lit("down").alias("direction"), F.col("from_row_id").alias("at"), F.col("to_row_id").alias("to"), "kind").unionByName(l_.select(F.lit("up").alias("direction"), F.col("to_row_id").alias("at"), F.col("from_row_id").alias("to"), "kind"))
    steps = steps.join(side("at"), "at").join(side("to"), "to")
    down, up = F.col("direction") == "down", F.col("direction") == "up"
    in_order = (down & (F.col("to_start") >= F.col("at_start")) & (F.col("at_is") != "gpu")) | (up & (F.col("to_start") <= F.col("at_start")) & (F.col("at_is") != "root"))
    steps = stage(steps.filter((F.col("kind") != "external") | in_order).select("direction", "at", "to", "kind", "at_is", "to_is").distinct(), "causal_steps")
    at_seed, to_seed = F.col("at") == F.col("seed"), F.col("to") == F.col("seed")
    follow = (F.col("kind") != "external") | ((down & (at_seed | (F.col("at_is") != "root")) & (to_seed | (F.col("to_is") != "root"))) | (up & (at_seed | (F.col("at_is") != "gpu"))))
    goes_on = to_seed | (F.col("to_is") == "call") | (up & (F.col("to_is") == "gpu"))
    ways = F.when(F.col("is") == "gpu", F.array(F.lit("up"))).when(F.col("is") == "call", F.array(F.lit("up"), F.lit("down"))).otherwise(F.array(F.lit("down")))
    front = seeds.select("row_id").distinct().join(e, "row_id").select(F.col("row_id").alias("seed"), F.col("row_id").alias("at"), F.explode(ways).alias("direction"))
    key = ["seed", "row_id", "direction"]
    seen = stage(front.select("seed", F.col("at").alias("row_id"), "direction", F.lit(0).alias("hops")), "causal_seen")
    calls = l_.filter("kind = 'correlation'").select(F.col("to_row_id").alias("to"), F.col("from_row_id").alias("caller")).join(e.filter("is = 'call'").select(F.col("row_id").alias("caller")), "caller", "left_semi")
    hop, callers = 0, None
    while True:
        hop += 1
        nxt = stage(front.join(steps, ["direction", "at"]).filter(follow).select("seed", "to", "direction", "kind", "to_is", goes_on.alias("on")), "causal_next")
        new = nxt.groupBy("seed", F.col("to").alias("row_id"), "direction").agg(F.bool_or("on").alias("on")).join(seen.select(*key), key, "left_anti")
        new = stage(new.withColumn("hops", F.lit(hop)), "causal_new")
        if new.isEmpty():
            break
        also = nxt.filter("kind = 'correlation' and direction = 'down' and to_is = 'gpu'").join(calls, "to").select("seed", F.col("caller").alias("row_id"), "direction", F.lit(hop).alias("hops"))
        callers = also if callers is None else callers.unionByName(also)
        front = new.filter("on").select("seed", F.col("row_id").alias("at"), "direction")
        seen = seen.unionByName(new.select(*key, "hops"))
        if hop % 16 == 0:  # keeps the plan short
            seen, callers = stage(seen, "causal_seen"), stage(callers, "causal_callers")
    found = seen if callers is None else seen.unionByName(callers)
    return found.filter("row_id <> seed").groupBy(*key).agg(F.min("hops").alias("hops"))


def _reached(primaries: DataFrame, links: DataFrame) -> DataFrame:
    """(primary, row_id): what primaries lead to over causal links without passing others."""
    steps = stage(links.filter(F.col("kind").isin(*CAUSAL)).select(F.col("from_row_id").alias("at"), F.col("to_row_id").alias("to")).distinct(), "reach_steps")
    others = primaries.select(F.col("row_id").alias("to"))
    steps = stage(steps.join(others, "to", "left_anti"), "reach_steps")
    front = primaries.select(F.col("row_id").alias("primary"), F.col("row_id").alias("at"))
    seen, hop = stage(front.select("primary", F.col("at").alias("row_id")), "reached"), 0
    while True:
        hop += 1
        new = front.join(steps, "at").select("primary", F.col("to").alias("row_id")).distinct()
        new = stage(new.join(seen, ["primary", "row_id"], "left_anti"), "reach_new")
        if new.isEmpty():
            return seen
        front, seen = new.withColumnRenamed("row_id", "at"), seen.unionByName(new)
        seen = stage(seen, "reached") if hop % 16 == 0 else seen


def collectives(events: DataFrame, links: DataFrame) -> DataFrame:
    """One row per collective: rank, step, collective, ordinal, cpu_id, kernel_ids, start_ns, end_ns,
    confidence. Communication on the host (operators and events of no other kind) is numbered by
    start within (rank, step, kind). Its kernels are the device events of the same key that it
    leads to over external, correlation and flow links (``link``); without any, the device event of
    the same number (``ordinal``), else none (``cpu-only``). Device events that no row has are rows of
    their own (``kernel-only``), numbered on. Rank and step -1 are unknown ones. Skew over ranks and
    the slowest rank are null, as of one file; ``rank_skew`` tells them of several."""
    steps = assign_steps(events, F.col("comm")).select("row_id", F.col("step_no").alias("__step"))
    e = timed(events).filter("comm").join(steps, "row_id", "left")
    key = ["rank", "step", "collective"]
    e = e.withColumns({"rank": F.coalesce("rank", F.lit(-1)), "step": F.coalesce("__step", "step_no", F.lit(-1)), "collective": F.coalesce("collective", F.lit("unknown"))})
    e = stage(e.select(*key, "row_id", "type", "start_ns", "end_ns"), "comm_events")
    order = ("start_ns", "row_id")
    cpu = stage(with_ordinal(e.filter("type in ('comm', 'cpu_op')"), tuple(key), order, "ordinal"), "comm_primaries")
    gpu = stage(with_ordinal(e.filter(_gpu()), tuple(key), order, "nth"), "comm_kernels")
    kernels = gpu.select(*key, F.col("row_id").alias("kernel_id"), "nth", F.col("start_ns").alias("k_start"), F.col("end_ns").alias("k_end")).hint("merge")  # written, they are a fraction of what a broadcast of them takes
    c = cpu.select(*key, "ordinal", F.col("row_id").alias("cpu_id"), "start_ns", "end_ns")
    reach = _reached(cpu, links).select(F.col("primary").alias("cpu_id"), F.col("row_id").alias("kernel_id"))
    linked = reach.join(c, "cpu_id").join(kernels.drop("nth"), [*key, "kernel_id"]).withColumn("confidence", F.lit("link"))
    linked = stage(linked, "comm_linked")
    rest = c.join(linked.select("cpu_id").distinct(), "cpu_id", "left_anti").join(kernels.withColumnRenamed("nth", "ordinal"), [*key, "ordinal"], "left")
    rest = rest.withColumn("confidence", F.when(F.col("kernel_id").isNull(), "cpu-only").otherwise("ordinal"))
    pairs = stage(linked.unionByName(rest), "comm_pairs")
    out = pairs.groupBy(*key, "ordinal", "cpu_id", "confidence").agg(
        F.array_sort(F.collect_set("kernel_id")).alias("kernel_ids"), F.least(F.min("start_ns"), F.min("k_start")).alias("start_ns"), F.greatest(F.max("end_ns"), F.max("k_end")).alias("end_ns")
    )
    left = gpu.join(pairs.select(F.col("kernel_id").alias("row_id")).filter("row_id is not null").distinct(), "row_id", "left_anti")
    left = with_ordinal(left, tuple(key), order, "more").join(cpu.groupBy(*key).agg(F.count("*").alias("primaries")), key, "left")
    number = F.when(F.col("primaries").isNull(), F.col("nth")).otherwise(F.col("primaries") + F.col("more"))
    only = left.select(*key, number.alias("ordinal"), F.lit(None).cast("long").alias("cpu_id"), F.lit("kernel-only").alias("confidence"), F.array("row_id").alias("kernel_ids"), "start_ns", "end_ns")
    return out.unionByName(only).withColumns({"skew_ns": F.lit(None).cast("long"), "slow_rank": F.lit(None).cast("long")})


def collective_groups(found: DataFrame, rank: int | None = None, step: int | None = None) -> DataFrame:
    """Collectives of which any rank matches, whole: kind, step and number that some matching row
    has are kept with the rows of all ranks."""
    hit = found if rank is None else found.filter(F.col("rank") == rank)
    hit = hit if step is None else hit.filter(F.col("step") == step)
    return found.join(hit.select("collective", "step", "ordinal").distinct(), ["collective", "step", "ordinal"], "left_semi")


def rank_skew(found: DataFrame) -> DataFrame:
    """Collectives of several ranks with skew_ns, slow_rank and offset_ns. Rows of one kind, step
    and number on different ranks are one collective, which ends at once everywhere: so a rank's clock
    is off by the median of the differences between its ends and those of the ranks it meets, and a
    few late ends move nothing. Clocks are told within ranks that meet, if only over others, by
    that of the smallest rank. ``skew_ns`` is the time from the first rank's start to the last one's, by
    corrected clocks, ``slow_rank`` the last to start (of several the smallest). All three are null
    for unknown ranks and collectives of one rank (the offset: ranks that meet no other). The median
    is exact up to 100,000 collectives a rank and off by a hundred-thousandth of the ranks beyond."""
    key = ["collective", "step", "ordinal"]
    one = found.filter("rank >= 0").groupBy(*key, "rank").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    met = one.withColumn("__ranks", F.count("*").over(W.partitionBy(*key))).filter("__ranks > 1").drop("__ranks")
    met = stage(met, "rank_rows")
    clocks = stage(met.select("rank").distinct().withColumns({"clock": F.col("rank"), "offset_ns": F.lit(0).cast("long")}), "rank_clocks")
    while True:
        now = met.join(clocks, "rank")
        own = F.struct("clock", "rank", (F.col("end_ns") - F.col("offset_ns")).alias("at"))
        now = now.withColumn("by", F.min(own).over(W.partitionBy(*key))).filter(F.col("by.clock") < F.col("clock"))
        new = now.groupBy("rank", F.col("by.clock").alias("to")).agg(F.percentile_approx(F.col("end_ns") - F.col("by.at"), 0.5, 100_000).alias("diff"))
        new = stage(new.groupBy("rank").agg(F.min(F.struct("to", "diff")).alias("new")), "rank_moves")
        if new.isEmpty():
            break
        moved = clocks.join(new, "rank", "left")
        clocks = stage(moved.select("rank", F.coalesce("new.to", "clock").alias("clock"), F.coalesce("new.diff", "offset_ns").alias("offset_ns")), "rank_clocks")
    at = F.col("start_ns") - F.col("offset_ns")
    groups = met.join(clocks, "rank").groupBy(*key).agg((F.max(at) - F.min(at)).alias("skew_ns"), (-F.max(F.struct(at.alias("at"), (-F.col("rank")).alias("r")))["r"]).alias("slow_rank"))
    told = found.drop("skew_ns", "slow_rank").join(groups, key, "left").join(clocks.select("rank", "offset_ns"), "rank", "left")
    unknown = F.col("rank") < 0
    return told.withColumns({c: F.when(~unknown, F.col(c)) for c in ("skew_ns", "slow_rank")})


def inspect_events(ids: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Asked events with their arguments, parent, children, step, path of Python frames and all links
    from or to them; others ``found`` false."""
    links = stage(links, "links")  # read five times
    up = links.filter("kind = 'nesting'").select(F.col("to_row_id").alias("row_id"), F.col("from_row_id").alias("parent_id"))
    down = links.filter("kind = 'nesting'").groupBy(F.col("from_row_id").alias("row_id")).agg(F.array_sort(F.collect_list("to_row_id")).alias("children"))
    step = links.filter("kind = 'step'").select(F.col("to_row_id").alias("row_id"), F.col("from_row_id").alias("step_id"))
    one = F.struct("kind", "from_row_id", "to_row_id")
    ends = links.select(F.col("from_row_id").alias("row_id"), one.alias("link")).unionByName(links.select(F.col("to_row_id").alias("row_id"), one.alias("link")))
    n = ends.join(ids.select("row_id"), "row_id", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_set("link")).alias("links"))
    out = ids.join(events.select("row_id", "name", "type", "start_ns", "end_ns", "args"), "row_id", "left")
    for d in (up, down, step, python_context(events), n):
        out = out.join(d, "row_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.withColumns({"found": F.col("start_ns").isNotNull(), "children": none("children", "array<long>"), "links": none("links", "array<struct<kind:string,from_row_id:long,to_row_id:long>>")})
