"""The best range around a row against brute force, and rows of many ranges around each other."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chrome as C
from spanloom.operators.around import best_around


def brute(rows, key, before):
    found = {}
    for t, i, s, e, asks, _ in rows:
        if not asks:
            continue
        near = [(key(os, oe, o), o) for ot, o, os, oe, _, is_outer in rows if is_outer and ot == t and t is not None and os <= s and e <= oe and o != i and (not before or (os, oe) != (s, e) or o < i)]
        if near:
            found[i] = min(near)[1]
    return found


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("chunk", [None, 40])
def test_best_around_is_brute_force(spark, chunk, before):
    r = random.Random(5)
    rows = []
    for i in range(400):
        s = r.randrange(60) if i % 3 else r.randrange(3000)
        rows.append((r.choice(["x", "y", None]) if i % 7 == 0 else "x", i, s, s + r.choice([0, 1, 5, 40, 900, 3000]), i % 4 > 0, i % 3 > 0))
    d = spark.createDataFrame(rows, "t string, row_id long, s long, e long, asks boolean, is_outer boolean")
    o = d.filter("is_outer").select("t", F.col("row_id").alias("outer_id"), F.col("s").alias("o_start"), F.col("e").alias("o_end"))
    i = d.filter("asks").select("t", "row_id", F.col("s").alias("i_start"), F.col("e").alias("i_end"))
    if before:
        got, key = best_around(o, i, ["t"], (-F.col("o_start"), F.col("o_end")), last_id=True, before=True, rows=chunk), lambda s, e, n: (-s, e, -n)
    else:
        got, key = best_around(o, i, ["t"], (F.col("o_end") - F.col("o_start"), F.col("o_start")), rows=chunk), lambda s, e, n: (e - s, s, n)
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(rows, key, before)


def test_many_ranges_around_each_other_make_no_pairs(spark):
    n = 20_000  # each lies in all before it: 200 million pairs
    e = spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("t").alias("trace"), F.lit("1").alias("tid"), F.lit(0).cast("long").alias("rank"), F.when(F.col("id") < n // 2, "step").otherwise("cpu_op").alias("type"),
        F.col("id").alias("step_no"), F.col("id").alias("start_ns"), (3 * n - F.col("id")).alias("end_ns"),
    )
    assert C.event_parents(e).filter("parent_id = row_id - 1").count() == n - 1
    assert C.assign_steps(e).filter(f"step_id = {n // 2 - 1} and step_no = step_id").count() == n - n // 2


def some_events(spark):
    return spark.range(40).select(
        F.col("id").alias("row_id"), F.lit("t").alias("trace"), F.lit("1").alias("pid"), F.lit("1").alias("tid"), F.lit(0).cast("long").alias("rank"), F.lit("x").alias("name"), F.lit("X").alias("ph"), F.lit(None).cast("string").alias("flow_id"),
        F.when(F.col("id") < 4, "step").otherwise("cpu_op").alias("type"), (F.col("id") % 3 == 0).alias("comm"), F.when(F.col("id") % 3 == 0, "send").alias("collective"), F.lit(1).cast("long").alias("step_no"), F.lit(0).cast("long").alias("external_id"),
        F.lit(0).cast("long").alias("correlation"), F.col("id").alias("start_ns"), (100 - F.col("id")).alias("end_ns"), F.lit(None).cast("long").alias("python_id"), F.lit(None).cast("long").alias("python_parent"),
    )


def test_without_askers_or_frames_nothing_is_sorted(spark, monkeypatch):
    e = some_events(spark)
    monkeypatch.setattr("spanloom.operators.around._solve", lambda *a: pytest.fail("sorted"))
    assert C.event_parents(e, F.col("type") == "python").count() == 0
    monkeypatch.setattr(C, "contains_join", lambda *a: pytest.fail("met"))
    assert C.python_context(e).columns == ["row_id", "python_path"] and C.python_context(e).count() == 0


def test_causes_and_collectives_ask_only_for_what_they_follow(spark, monkeypatch):
    e, asked = some_events(spark), []
    whole = C.smallest_enclosing
    monkeypatch.setattr(C, "event_parents", lambda *a: pytest.fail("parents"))
    monkeypatch.setattr(C, "smallest_enclosing", lambda events, *a, **k: asked.append(events) or whole(events, *a, **k))
    links = C.event_links(e, C.CAUSAL)
    assert len(asked) == 1 and {r["kind"] for r in links.select("kind").distinct().collect()} == {"external"}
    found = C.collectives(e, links)
    assert len(asked) == 2 and asked[1].filter("not comm").isEmpty() and {r["step"] for r in found.collect()} == {1}
