"""Objects of a large JSON document, read by as many tasks as the file has splits.

A file is cut at every closing brace by Spark's own text reader, so a split holds whole pieces
whatever the document's layout, compact or not. Whether a piece begins inside a string and how deep
it is nested depends on all before it, but only through two facts: so each split is first read for
both cases (in a string, or not), which gives its end state and its change of depth for either; these
transitions compose, one row per split, in order of a file; and then every split is read again with
its state known and tells its objects. What lies across splits is put together from two rows
per split at most. A compressed file is one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.staging import stage

#: A string, to its end or that of the piece, or a bracket.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.DOTALL)
REST = re.compile(r'(?:[^"\\]|\\.)*(?:"|\Z)', re.DOTALL)
NUMBER = re.compile(r"\s*:\s*([0-9]+)")
STATES = "file string, block long, out_end boolean, out_depth long, in_end boolean, in_depth long"
PARTS = "file string, block long, seq long, kind string, key string, text string"
#: Lists of the document are known by their key, objects by a brace and theirs.
HEADER = "{distributedInfo"
#: Objects of a list of the document lie this deep.
DEPTH = 3
#: Splits at most whose states are broadcast, a few numbers and a name each.
MOST_SPLITS = 500_000


def _ended(token: str) -> bool:
    return len(token) > 1 and token[-1] == '"' and (len(token) - 2 - len(token[:-1].rstrip("\\")) + 1) % 2 == 0


def _tokens(text: str, inside: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of a piece; strings that go on past it end in ``\\0`` instead."""
    at = 0
    if inside:
        m = REST.match(text)
        closed = m.group().endswith('"') and _ended('"' + m.group())
        yield 0, m.end(), "s" if closed else "\0"
        at = m.end()
    for m in TOKEN.finditer(text, at):
        t = m.group()
        yield m.start(), m.end(), t if t[0] != '"' else ("s" if _ended(t) else "\0")


def _walked(text: str, inside: bool) -> tuple[bool, int]:
    depth, end = 0, False
    for _, _, t in _tokens(text, inside):
        depth += (t in "{[") - (t in "}]")
        end = t == "\0"
    return end, depth


def _states(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, state = None, None
    for p in parts:
        done = []
        for file, block, value in zip(p["file"], p["block"], p["value"], strict=True):
            if (file, block) != at:
                if at:
                    done.append((*at, *state))
                at, state = (file, block), (False, 0, True, 0)
            text, out = value + "}", []
            for inside, depth in (state[:2], state[2:]):
                end, more = _walked(text, inside)
                out += [end, depth + more]
            state = tuple(out)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in STATES.split(", ")])
    if at:
        yield pd.DataFrame([(*at, *state)], columns=[c.split()[0] for c in STATES.split(", ")])


def _starts(p: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file with the state at their start."""
    p, inside, depth, out = p.sort_values("block"), False, 0, []
    for r in p.itertuples():
        out.append((r.file, r.block, inside, depth))
        inside, depth = (r.in_end, depth + r.in_depth) if inside else (r.out_end, depth + r.out_depth)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth"])


class _Split:
    """The objects of one split, piece by piece."""

    def __init__(self, file: str, block: int, inside: bool, depth: int):
        self.at, self.inside, self.depth, self.own, self.seq = (file, block), inside, depth, False, 0
        self.key: str | None = None
        self.last: str | None = None
        self.text: list[str] = []

    def _part(self, kind: str, text: str | None = None) -> tuple:
        self.seq += 1
        return (*self.at, self.seq, kind, self.key, text)

    def take(self, text: str) -> Iterator[tuple]:
        begin = 0 if self.depth >= DEPTH else None
        end = False
        for a, b, t in _tokens(text, self.inside):
            end = t == "\0"
            if t == "s" and self.depth == 1:
                self.last = text[a + 1 : b - 1]
            elif t == "s" and self.depth == 2 and self.key in (None, HEADER) and text[a:b] == '"rank"' and (m := NUMBER.match(text, b)):
                yield self._part("rank", m.group(1))
            elif t in "{[":
                self.depth += 1
                if self.depth == DEPTH - 1:
                    self.key = f"{'' if t == '[' else t}{self.last or ''}"
                elif self.depth == DEPTH and begin is None:
                    begin, self.own = a, True
            elif t in "}]":
                self.depth -= 1
                if self.depth == DEPTH - 1 and begin is not None:
                    self.text.append(text[begin:b])
                    yield self._part("whole" if self.own else "more", "".join(self.text))
                    self.text, begin, self.own = [], None, False
        if begin is not None:
            self.text.append(text[begin:])
        self.inside = end

    def close(self) -> Iterator[tuple]:
        if self.text:
            yield self._part("first" if self.own else "more", "".join(self.text))
        yield self._part("key")


def _parts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, split = [c.split()[0] for c in PARTS.split(", ")], None
    for p in parts:
        out: list[tuple] = []
        for file, block, value, inside, depth in zip(*(p[c] for c in ("file", "block", "value", "inside", "depth")), strict=True):
            if split is None or split.at != (file, block):
                if split:
                    out += split.close()
                split = _Split(file, block, bool(inside), int(depth))
            out += split.take(value + "}")
        yield pd.DataFrame(out, columns=names)
    if split:
        yield pd.DataFrame(list(split.close()), columns=names)


def read_listed_objects(spark: SparkSession, *paths: str, key: str = "traceEvents") -> DataFrame:
    """The objects in the list that each document holds under ``key``: trace (the file), rank (that of
    the document's ``distributedInfo``) and text (an object's JSON)."""
    raw = spark.read.option("lineSep", "}").text(list(paths))
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = stage(raw.mapInPandas(_states, STATES), "json_states")
    starts = stage(states.groupBy("file").applyInPandas(_starts, "file string, block long, inside boolean, depth long"), "json_starts")
    if starts.count() > MOST_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    told = stage(raw.join(F.broadcast(starts), ["file", "block"]).mapInPandas(_parts, PARTS), "json_parts")  # rows of a split stay in order

    edge = told.filter("kind in ('first', 'more', 'key')")  # three rows of a split at most
    before = W.partitionBy("file").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("begun", F.last(F.when(F.col("kind") == "first", F.col("block")), ignorenulls=True).over(before))
    across = edge.filter("kind in ('first', 'more')").groupBy("file", "begun").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "").alias("text"), F.min(F.when(F.col("kind") == "first", F.col("key"))).alias("key"), F.min("block").alias("block"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    known = told.filter("kind = 'key'").select("file", "block", F.last("key", ignorenulls=True).over(earlier).alias("carried"))
    whole = told.filter("kind = 'whole'").select("file", "block", "key", "text").unionByName(across.select("file", "block", "key", "text"))
    listed = whole.join(known, ["file", "block"]).filter(F.coalesce("key", "carried") == key)
    ranks = told.filter("kind = 'rank'").select("file", "block", "key", "text").join(known, ["file", "block"]).filter(F.coalesce("key", "carried") == HEADER).groupBy("file").agg(F.max(F.col("text").cast("long")).alias("rank"))
    return listed.join(ranks, "file", "left").select(F.col("file").alias("trace"), "rank", "text")
