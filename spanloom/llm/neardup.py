"""Operator 4 - near-duplicates by a signature-coordinate inverted join, confirmed exactly.

Documents with equal shingle sets form a class; only classes are compared. A class posts itself
under its MinHash coordinates (coordinate, value). Two classes are candidates if at least
``match`` of the ``coords`` coordinates agree. Values that no other class has can't agree, so a
class with fewer than ``match`` shared ones posts nothing, and otherwise it is enough to post
all but its ``match - 1`` most frequent pairs (prefix filter with one order, rarest first).

Posting lists are merged by groups: all lists with the same first member (by a hash) are one
group, so the many lists of one cluster are merged once. In a task the posted lists of a group
are merged into counts of collisions per pair; pairs that share no posted list are never met.
A pair is skipped if it can't reach ``match`` even if all lists collide that the two have not both
posted, or if what has been found already joins the two; for the others these long lists aren't
merged, but probed in the signatures. Candidates are confirmed on full shingle sets in the same
task, and only a spanning forest of the confirmed links leaves it, at most one row per member.

Groups of more than ``block`` classes are dealt to blocks. First every block is merged within
itself, which joins most of a large group at a cost in proportion to its size; then, where
several components are left, members outside the commonest one meet all blocks. Members of
the commonest component never meet each other again. What stays of the cost of pairs is counted
in numpy inside bounded tasks; no pair below the threshold is ever a row.

With 48 coordinates and 28 matches a pair at similarity 0.85 exactly is missed with
probability 2e-6, and less above.

Defined cases: documents without words have no shingles and are alone; with fewer than
``width`` words the whole sequence is the one shingle; very long texts are taken whole (8 bytes
a word in a task); rows without id are alone, with null component, and kept; rows that repeat
an id are members of their own text's class. Empty tables give no rows; extra columns are
ignored by ``components`` and kept by ``deduplicated``, whatever their names. Shingles are
compared as 64-bit hashes, classes as 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.staging import stage

_MIX = np.random.default_rng(11).integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    known: dict[bytes, int] = {}
    for w in set(words):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for i in range(width):  # a polynomial over odd multipliers, one per position
            out = (out ^ (out >> np.uint64(29))) * _MIX[i % 3] + h[i : len(h) - width + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _MIX[0]
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit MinHash values, one per coordinate."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            low = np.minimum(low, (hashes[at : at + 4096, None] * a + b).min(axis=0))
        return ((low ^ (low >> np.uint64(31))) * _MIX[1] >> np.uint64(32)).astype(np.uint32)


#: Rows of a batch that a task holds as Python objects at a time.
ROWS = 512


def _sliced(make, schema: pa.Schema):
    """A function of pandas frames as one of Arrow batches that sees ``ROWS`` rows at a time,
    whatever Spark's batches hold; whole numbers stay whole beside nulls."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (p.slice(at, ROWS).to_pandas(integer_object_nulls=True) for p in parts for at in range(0, p.num_rows, ROWS))
        for out in make(frames):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return run


SETS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("sig", pa.binary())])
HASHES = pa.schema([("c", pa.int64()), ("h", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(width: int, coords: int):
    rng = np.random.default_rng(17)
    a = rng.integers(1, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, coords, dtype=np.uint64)

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t in p["text"]:
                h = shingle_hashes(t, width)
                out.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), signature(h, a, b).tobytes()) if len(h) else (0, None, None))
            yield pd.DataFrame({"id": p["id"], "n": [x[0] for x in out], "cls": [x[1] for x in out], "sig": [x[2] for x in out]})

    return make


def _shingles(width: int):
    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = [shingle_hashes(t, width).tobytes() for t in p["text"]]
            right = [hashlib.blake2b(r, digest_size=16).digest() == c for r, c in zip(raw, p["cls"], strict=True)]
            yield pd.DataFrame({"c": p["c"], "h": raw})[right]

    return make


def _class_of(width: int):
    @F.pandas_udf(T.BinaryType())
    def cls(text: pd.Series) -> pd.Series:
        raw = [shingle_hashes(t, width).tobytes() for t in text]
        return pd.Series([hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw], dtype=object)

    return cls


def _tokens(coords: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def tokens(sig: pd.Series) -> pd.Series:
        m = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(-1, coords).astype(np.int64)
        return pd.Series(list(m + (np.arange(coords, dtype=np.int64) << 32)))

    return tokens


def _whole_groups(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key``, in frames that hold whole groups."""
    kept: list[pd.DataFrame] = []
    for p in parts:
        if not len(p):
            continue
        last = (p[key] == p[key].iloc[-1]).all(axis=1).to_numpy()
        first = int(last.argmax())
        if first:  # the frame's last group may go on
            yield pd.concat([*kept, p.iloc[:first]], ignore_index=True)
            kept = []
        elif kept and (kept[0][key].iloc[-1] != p[key].iloc[0]).any():
            yield pd.concat(kept, ignore_index=True)
            kept = []
        kept.append(p.iloc[first:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _pairs_within(bounds: np.ndarray, at_once: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs inside runs [bounds[k], bounds[k + 1])."""
    sizes = np.diff(bounds)
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = bounds[:-1][sizes == size]
        if size * (size - 1) // 2 <= at_once:
            x, y = np.triu_indices(size, 1)
            step = max(1, at_once // len(x))
            for n in range(0, len(starts), step):
                s = starts[n : n + step, None]
                yield (s + x).ravel(), (s + y).ravel()
        else:
            step = max(1, at_once // size)
            for s in starts.tolist():
                for lo in range(0, size, step):
                    x, y = np.meshgrid(np.arange(lo, min(size, lo + step)), np.arange(size), indexing="ij")
                    yield s + x[x < y], s + y[x < y]


def _posted(group: np.ndarray, sigs: np.ndarray, posted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting lists of groups: rows list by list, in the order of groups, and the lists' bounds."""
    row, k = np.nonzero((posted[:, None] >> np.arange(sigs.shape[1])) & 1)
    value = sigs[row, k]
    order = np.lexsort((row, value, k, group[row]))
    row, k, value = row[order], k[order], value[order]
    new = (np.diff(group[row]) != 0) | (np.diff(k) != 0) | (np.diff(value) != 0)
    return row, np.concatenate([[0], np.flatnonzero(new) + 1, [len(row)]]) if len(row) else np.zeros(1, dtype=np.int64)


def merged(bounds: np.ndarray, sigs: np.ndarray, posted: np.ndarray, left: np.ndarray | None = None, at_once: int = 65_536, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group, i < j, with the number of posted lists that hold both, for
    pairs with one at least; with ``left`` pairs of a row in it and one that is not. Lists of groups of
    up to ``small`` rows are merged by sorting, those of others by adding up in a table."""
    size = np.diff(bounds)
    group = np.repeat(np.arange(len(size)), size)
    row, lists = _posted(group, sigs, posted)
    sorts = (size <= small) & (left is None)
    if sorts.any() and len(row):
        own = sorts[group[row[lists[:-1]]]]
        keep = np.repeat(own, np.diff(lists))
        rows, ends = row[keep], np.concatenate([[0], np.cumsum(np.diff(lists)[own])])
        codes = [rows[x] * len(group) + rows[y] for x, y in _pairs_within(ends, at_once)]
        if codes:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            for at in range(0, len(code), at_once):
                yield code[at : at + at_once] // len(group), code[at : at + at_once] % len(group), n[at : at + at_once]
    of = group[row[lists[:-1]]] if len(row) else np.zeros(0, dtype=np.int64)
    for g in np.flatnonzero(~sorts & (size > 1)).tolist():
        s, e = int(bounds[g]), int(bounds[g + 1])
        count = np.zeros((e - s, e - s), dtype=np.uint8)
        for k in range(*np.searchsorted(of, [g, g + 1]).tolist()):
            mine = row[lists[k] : lists[k + 1]]
            a, b = (mine, mine) if left is None else (mine[left[mine]], mine[~left[mine]])
            if len(mine) > 1 and len(a) and len(b):
                count[np.ix_(a - s, b - s)] += 1
        if left is None:
            count = np.triu(count, 1)
        step = max(1, at_once // (e - s))
        for lo in range(0, e - s, step):
            i, j = np.nonzero(count[lo : lo + step])
            if len(i):
                yield s + lo + i, s + j, count[lo + i, j].astype(np.int64)


def colliding(sigs: np.ndarray, posted: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of which at least ``match`` coordinates collide, ``n`` of those that both posted:
    pairs that can't reach that any more are skipped, for the rest the other coordinates are probed."""
    both = posted[i] & posted[j]
    alive = n + sigs.shape[1] - np.bitwise_count(both) >= match
    i, j = i[alive], j[alive]
    enough = (sigs[i] == sigs[j]).sum(axis=1) >= match
    return i[enough], j[enough]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets. Many pairs of few sets are counted as
    products of incidence matrices, over the values that two sets have at least."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) < 8 * len(used):
        out = np.empty(len(i), dtype=np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            p, q = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            out[k] = (q[at] == p).sum()
        return out
    x, y = place[: len(i)], place[len(i) :]
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    owner, col = owner[shared[col]], number[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(used), len(used)), dtype=np.float32)  # counts below 2**24 are exact
    for lo in range(0, int(shared.sum()), 2048):
        s, e = np.searchsorted(col, [lo, lo + 2048])
        m = np.zeros((len(used), 2048), dtype=np.float32)
        m[owner[s:e], col[s:e] - lo] = 1
        both += m @ m.T
    return both[x, y].astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place in each place's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linker(coords: int, match: int, percent: int, key: list[str]):
    """Rows of groups (``key``, c, posted, n, sig, h and, between blocks, comp and left) to links
    (a, b) that span the components of each group's confirmed pairs."""

    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _whole_groups(parts, key):
            n, c, posted = p["n"].to_numpy(np.int64), p["c"].to_numpy(np.int64), p["posted"].to_numpy(np.int64)
            sigs = np.frombuffer(b"".join(p["sig"]), dtype=np.uint32).reshape(-1, coords)
            sets = [np.frombuffer(h, dtype=np.uint64) for h in p["h"]]
            new = (p[key] != p[key].shift()).any(axis=1).to_numpy()
            bounds = np.append(np.flatnonzero(new), len(p))
            left = p["left"].to_numpy(bool) if "left" in p else None
            _, first, which = np.unique(p["comp"] if left is not None else c, return_index=True, return_inverse=True)
            joined = first[which]  # what is known to be linked
            a, b = [np.arange(len(p))], [joined]
            for i, j, met in merged(bounds, sigs, posted, left):
                apart = (joined[i] != joined[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
                i, j = colliding(sigs, posted, i[apart], j[apart], met[apart], match)
                if len(i):
                    both = overlaps(sets, i, j)
                    good = 100 * both >= percent * (n[i] + n[j] - both)
                    a.append(i[good])
                    b.append(j[good])
                    joined = _forest(len(p), np.concatenate(a), np.concatenate(b))
            label = _forest(len(p), np.concatenate([*a[1:], np.zeros(0, dtype=np.int64)]), np.concatenate([*b[1:], np.zeros(0, dtype=np.int64)]))
            moved = np.flatnonzero(label != np.arange(len(p)))
            yield pd.DataFrame({"a": c[moved], "b": c[label[moved]]})

    return link


def _grow(links: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Components (c, comp) of the links and of ``comps``: the smallest label among
    neighbours, then the label's own label, until nothing changes."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if comps is not None:  # a component that was known is a star around its label
        known = comps.filter(F.col("c") != F.col("comp"))
        both = both.union(known.select("c", "comp")).union(known.select("comp", "c"))
    both = stage(both, "links")
    label = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("comp"))
    label = stage(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("c", "b"), "b").select(F.col("a").alias("c"), "comp", F.lit(None).cast("long").alias("was"))
        low = stage(near.union(label.select("c", "comp", F.col("comp").alias("was"))).groupBy("c").agg(F.min("comp").alias("comp"), F.max("was").alias("was")), "low")
        if low.filter(F.col("was") != F.col("comp")).isEmpty():
            return label
        hop = low.select(F.col("c").alias("comp"), F.col("comp").alias("next"))
        label = stage(low.select("c", "comp").join(hop, "comp").select("c", F.least("comp", "next").alias("comp")), "labels")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, coords: int, match: int, block: int) -> DataFrame:
    """One row per row of ``docs``: id, n, cls, component_id."""
    if coords > 62:
        raise ValueError("62 coordinates at most: a class keeps those it posts as the bits of a long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = stage(texts.mapInArrow(_sliced(_sets(width, coords), SETS), "id long, n int, cls binary, sig binary"), "sets")
    named = sets.filter(F.col("id").isNotNull() & F.col("cls").isNotNull())
    classes = named.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    # posting lists: how many classes have a pair, and the first of them, which names the group
    tokens = classes.select("c", F.explode(_tokens(coords)("sig")).alias("token"))
    draw = F.struct(F.xxhash64("c", F.lit(23)), "c")
    lists = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min(draw)["c"].alias("g")).filter(F.col("df") > 1)
    # Spark takes exploded rows to be as many as those they come from; the hint keeps them from being broadcast
    own = tokens.hint("merge").join(stage(lists, "lists"), "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token", "g"))).alias("own"))  # ``coords`` at most
    prefix = F.slice("own", F.lit(1), F.greatest(F.size("own") - (match - 1), F.lit(0)))
    bit = F.array(*[F.lit(1 << k).cast("long") for k in range(coords)])
    add = lambda total, x: total + F.element_at(bit, (F.shiftright(x["token"], 32) + 1).cast("int"))
    posts = own.select("c", prefix.alias("prefix")).select("c", "prefix", F.explode(F.array_distinct(F.transform("prefix", lambda x: x["g"]))).alias("g"))
    posts = posts.select("c", "g", F.aggregate(F.filter("prefix", lambda x: x["g"] == F.col("g")), F.lit(0).cast("long"), add).alias("posted"))
    posts = stage(posts.join(classes.select("c", "n"), "c"), "posts")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / (4096 * block))).cast("int")
    groups = stage(posts.groupBy("g").agg(F.count("*").alias("members"), blocks.alias("blocks")).filter(F.col("members") > 1), "groups")
    members = posts.select("c", "g", "posted").join(groups, "g").withColumn("blk", F.pmod(F.xxhash64("c", F.lit(31)), F.col("blocks")).cast("int"))
    members = stage(members.select("g", "c", "posted", "blk", "blocks"), "members")

    busy = members.select("c").distinct().join(classes.select("c", "cls", "rep"), "c")
    chosen = texts.join(busy.select(F.col("rep").alias("id"), "c", "cls"), "id").select("c", "cls", "text")
    full = chosen.mapInArrow(_sliced(_shingles(width), HASHES), "c long, h binary").groupBy("c").agg(F.first("h").alias("h"))
    full = stage(full.join(classes.select("c", "n", "sig"), "c"), "shingles")

    def linked(rows: DataFrame, key: list[str]) -> DataFrame:
        dealt = rows.join(full, "c").repartition(*key).sortWithinPartitions(*key)
        return stage(dealt.mapInArrow(_sliced(_linker(coords, match, percent, key), LINKS), "a long, b long"), "linked")

    links = linked(members.select("g", "blk", "c", "posted"), ["g", "blk"])
    comps = None if links.isEmpty() else _grow(links, None)
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        comp = F.col("c").alias("comp") if comps is None else F.coalesce("comp", "c").alias("comp")
        large = stage((large if comps is None else large.join(comps, "c", "left")).select("g", "c", "posted", "blk", "blocks", comp), "large")
        kinds = large.groupBy("g", "comp").agg(F.count("*").alias("k"))
        kinds = kinds.groupBy("g").agg(F.max(F.struct("k", "comp"))["comp"].alias("top"), (F.sum("k") - F.max("k")).alias("rest")).filter("rest > 0")
        open_ = stage(large.join(kinds.withColumn("lefts", F.ceil(F.col("rest") / block).cast("int")), "g"), "open")
        to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = F.pmod(F.xxhash64("c", F.lit(37)), F.col("lefts")).cast("int")
        rest = open_.filter("comp <> top").select("g", mine.alias("x"), to("blocks").alias("y"), "c", "posted", "comp", F.lit(True).alias("left"))
        every = open_.select("g", to("lefts").alias("x"), F.col("blk").alias("y"), "c", "posted", "comp", F.lit(False).alias("left"))
        links = linked(rest.unionByName(every), ["g", "x", "y"])
        if not links.isEmpty():
            comps = _grow(links, comps)

    reps = classes.select("cls", "c", "rep")
    if comps is None:
        final = reps.select("cls", F.col("rep").alias("component_id"))
    else:
        joined = stage(reps.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "final")
        final = joined.join(joined.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("cls", "component_id")
    out = sets.select("id", "n", "cls").join(stage(final, "components"), "cls", "left")
    return out.select("id", "n", "cls", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, coords: int = 48, match: int = 28, block: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    return _classes(docs, id_col, text_col, width, percent, coords, match, block).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, coords: int = 48, match: int = 28, block: int = 1024) -> DataFrame:
    """``docs`` with one row of each group: the smallest id's. Rows without id stay. Of rows
    that share an id and are copies one stays, the first by text and all other columns; if they
    are no copies, each counts for its own group."""
    found = _classes(docs, id_col, text_col, width, percent, coords, match, block).filter(F.col("id").isNotNull())
    found = stage(found, "found")
    same = F.col("id") == F.col("component_id")
    ids = stage(found.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"), F.bool_or(same).alias("__stays")), "found_ids")
    # written apart, so that their own size decides how they are joined before any text is shuffled
    many = stage(ids.filter("__n > 1").select("__id"), "found_again")
    gone = stage(ids.filter("__n > 1 or not __stays").select("__id"), "gone")  # fewer than those that stay
    stay = found.filter(same).select(F.col("id").alias("__id"), F.col("cls").alias("__cls")).distinct()
    of = lambda d: F.col(f"`{id_col}`").cast("long") == d["__id"]
    single = docs.join(gone, of(gone), "left_anti")
    if many.isEmpty():
        return single
    doubt = docs.join(many, of(many), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    doubt = doubt.withColumns({"__id": F.col("__row")[id_col].cast("long"), "__text": F.col("__row")[text_col]}).withColumn("__cls", _class_of(width)("__text"))
    here = [doubt["__id"] == stay["__id"], doubt["__cls"].eqNullSafe(stay["__cls"])]
    order = W.partitionBy("__id", "__cls").orderBy(F.col("__text"), F.xxhash64(F.to_json("__row")))
    doubt = doubt.join(stay, here, "left_semi").withColumn("__nth", F.row_number().over(order)).filter("__nth = 1")
    doubt = doubt.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
    return single.union(doubt)


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
