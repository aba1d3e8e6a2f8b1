"""Operator 12 - prefix trie of conversations, subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; the trie is made by hashing, not by walking. A turn at
depth i gives two 60-bit numbers, cut from a digest of i, role and text; a prefix is known by its depth
and the exact sums of these numbers, so prefixes are running sums. Turns get their places by ranges
(``ranks.ranked``) and their sums by chunks of 1,024 turns, so a conversation that holds a third of all
turns isn't in one task.

Subtree totals (``subtree_totals``) come from tree contraction. A round rakes: leaves give their sums to
their parents and go. Then it compresses: in a chain of nodes with one child each, every node learns by
doubling its sum down to the chain's end, all but the chain's first node go, and the first takes
over. A round at least halves the leaves, a chain of length n takes log n joins, and what is joined
shrinks with the tree. Afterwards the nodes that went in chains are put back, last round first: each
adds its sum down the chain to the total of the node at the chain's end.

Defined cases: a null role or text is empty; turns of one number stand by a digest of role and
text (repeated rows are turns of their own); a null turn comes first; rows without a conv_id belong to
no conversation; very long texts and conversations are whole; an empty table has no node. Other
columns are ignored, whatever their names. The ids of conversations that end at a node are digested in
chunks of 4,096 neighbouring ids and, where a node has several, chunk after chunk in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.ranks import ranked
from spanloom.staging import stage

CHUNK_TURNS, CHUNK_IDS = 1024, 4096


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes``: id, parent (null at a root) and the columns of ``values``. id and, for each value, its
    sum over the node's subtree. Any number of roots; a cycle or a missing parent is no tree."""
    sums = lambda prefix="": [(F.col(v) + F.coalesce(f"{prefix}{v}", F.lit(0))).alias(v) for v in values]
    tree = stage(nodes.select("id", "parent", *values), "trie_tree")
    known, chains = [], []
    while True:
        # rake
        kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
        tree = stage(tree.join(kids, "id", "left").fillna(0, ["kids"]), "trie_kids")
        leaves = tree.filter("kids = 0")
        known.append(leaves.select("id", *values))
        if not tree.filter("kids > 0").head(1):
            break
        gain = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("raked"), *[F.sum(v).alias(f"raked_{v}") for v in values])
        tree = tree.filter("kids > 0").join(gain, "id", "left").select("id", "parent", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"), *sums("raked_"))
        tree = stage(tree, "trie_raked")

        # compress
        single = tree.filter("kids = 1")
        child = tree.select(F.col("parent").alias("id"), F.col("id").alias("to"), (F.col("kids") == 1).alias("on"))
        jump = single.join(child, "id").select("id", "parent", "to", "on", *values)
        below = jump.filter("on").select(F.col("to").alias("id"), F.lit(True).alias("inner"))
        jump = stage(jump.join(below, "id", "left").select("id", "parent", "to", "on", F.coalesce("inner", F.lit(False)).alias("inner"), *values), "trie_chains")
        if not jump.filter("inner").head(1):
            tree = tree.select("id", "parent", *values)
            continue
        while jump.filter("on").head(1):
            step = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("on").alias("still"), *[F.col(v).alias(f"next_{v}") for v in values])
            further = jump.filter("on").join(step, "to").select("id", "parent", F.col("next").alias("to"), F.col("still").alias("on"), "inner", *sums("next_"))
            jump = stage(jump.filter("not on").unionByName(further), "trie_doubled")
        chains.append(jump.filter("inner").select("id", "to", *values))
        first = jump.filter("not inner")
        moved = first.select(F.col("to").alias("id"), F.col("id").alias("above"))
        rest = tree.filter("kids <> 1").join(moved, "id", "left").select("id", F.coalesce("above", "parent").alias("parent"), *values)
        tree = first.select("id", "parent", *values).unionByName(rest)

    # expand
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    for gone in reversed(chains):
        end = out.select(F.col("id").alias("to"), *[F.col(v).alias(f"end_{v}") for v in values])
        out = out.unionByName(stage(gone.join(end, "to").select("id", *sums("end_")), "trie_expanded"))
    return out


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = conversations.filter("conv_id is not null").select("conv_id", "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    t = ranked(t, ["conv_id"], ["turn", "digest"], "place")
    return stage(t.select("conv_id", (F.col("place") + 1).alias("place"), "digest", "bytes"), "trie_turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c takes the first h turns of conversation c - c % 5 (all if it has fewer), then
    its own after its first h; h = crc32(c) % 9. Turns (conv_id, depth from 1, digest, bytes), and all
    conversations (conv_id)."""
    turns = _turns(conversations)
    taken = lambda c: (F.crc32(c.cast("string").cast("binary")) % 9).alias("h")
    convs = stage(turns.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(8)).alias("length")), "trie_convs")
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    lent = turns.filter("place <= 8").select(F.col("conv_id").alias("base"), "place", "digest", "bytes")  # h is at most 8
    first = convs.select("conv_id", base, taken(F.col("conv_id"))).join(lent, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    lengths = convs.select(F.col("conv_id").alias("base"), "length")
    own = turns.select("conv_id", "place", "digest", "bytes", base, taken(F.col("conv_id"))).filter("place > h").join(lengths, "base", "left")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))).alias("depth"), "digest", "bytes")
    return stage(first.unionByName(own), "trie_rebuilt"), convs.select("conv_id")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth, 0 included: conv_id, depth, a and b (the prefix), own_a and
    own_b (its last turn's part), bytes of its last text."""
    mixed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    t = turns.withColumn("mixed", mixed).select("conv_id", "depth", "bytes", _number(F.col("mixed"), 1).alias("own_a"), _number(F.col("mixed"), 16).alias("own_b"), F.expr(f"depth div {CHUNK_TURNS}").alias("chunk"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = t.groupBy("conv_id", "chunk").agg(F.sum("own_a").alias("a"), F.sum("own_b").alias("b"))
    zero = F.lit(0).cast("decimal(38,0)")
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(c).over(before), zero).alias(f"before_{c}") for c in "ab"]).filter("chunk > 0")
    t = t.withColumns({c: F.sum(f"own_{c}").over(inside) for c in "ab"}).join(chunks, ["conv_id", "chunk"], "left")
    t = t.select("conv_id", "depth", *[(F.col(c) + F.coalesce(f"before_{c}", zero)).cast("decimal(38,0)").alias(c) for c in "ab"], *[F.col(f"own_{c}").cast("decimal(38,0)").alias(f"own_{c}") for c in "ab"], "bytes")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[zero.alias(c) for c in ("a", "b", "own_a", "own_b")], F.lit(0).cast("long").alias("bytes"))
    return stage(t.unionByName(root), "trie_prefixes")


def _digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the texts of consecutive rows of one key, joined by commas."""
    key, state = None, None
    done: list[tuple[int, str, str, str]] = []
    for p in parts:
        for d, a, b, ids in zip(*(p.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if key == (d, a, b):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (d, a, b), hashlib.sha256(ids.encode())
        if done:
            yield _batch(done)
            done = []
    if key is not None:
        yield _batch([(*key, state.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "a": pa.string(), "b": pa.string(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def ends(last: DataFrame) -> DataFrame:
    """``last``: conv_id, depth, a, b of every conversation's end. Per prefix the digest of the ids."""
    chunk = F.expr(f"(conv_id - pmod(conv_id, {CHUNK_IDS})) div {CHUNK_IDS}")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")  # ids are distinct: ``CHUNK_IDS`` at most
    chunks = last.groupBy("depth", "a", "b", chunk.alias("chunk")).agg(ids.alias("ids"))
    counted = last.groupBy("depth", "a", "b").agg(F.min(chunk).alias("lo"), F.max(chunk).alias("hi"))
    chunks = stage(chunks.join(counted, ["depth", "a", "b"]), "trie_ends")
    one = chunks.filter("lo = hi").select("depth", "a", "b", F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.filter("lo < hi").select("depth", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "chunk", "ids")
    many = many.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "chunk").mapInArrow(_digested, "depth long, a string, b string, ends_sha256 string")
    return one.unionByName(many.select("depth", *[F.col(c).cast("decimal(38,0)").alias(c) for c in "ab"], "ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    p = prefixes(*rebuilt(conversations))
    key = ["depth", "a", "b"]
    nodes = p.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("own_a").alias("own_a"), F.first("own_b").alias("own_b"), F.first("bytes").alias("bytes"))
    nodes = stage(nodes, "trie_nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("from_a"), F.col("b").alias("from_b"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.withColumns({"from_a": (F.col("a") - F.col("own_a")).cast("decimal(38,0)"), "from_b": (F.col("b") - F.col("own_b")).cast("decimal(38,0)")}).join(above, ["depth", "from_a", "from_b"], "left")
    # a node is also known by its smallest member and depth
    name = lambda c, d: F.concat(d.cast("string"), F.lit(":"), c.cast("string"))
    linked = linked.select(*key, "conv_id", "n_convs", "bytes", "parent_conv_id", name(F.col("conv_id"), F.col("depth")).alias("id"), name(F.col("parent_conv_id"), F.col("depth") - 1).alias("parent"))
    linked = stage(linked, "trie_linked")
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    linked = stage(linked.join(kids, "id", "left").fillna(0, ["n_children"]), "trie_counted")
    weighed = linked.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"])
    last = p.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("k")).select("conv_id", "k.*")
    out = linked.join(totals, "id").join(ends(last), key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
         strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), tab),
r AS (
  SELECT c.conv_id, t.place AS depth, said, bytes FROM c JOIN t ON t.conv_id = c.base AND t.place <= h
  UNION ALL
  SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(b.n, 0)), said, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(sha256(said), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT p.*, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ended FROM p),
n AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ids FROM e GROUP BY depth, k),
m AS (SELECT n.*, coalesce(x.kids, 0) AS kids FROM n LEFT JOIN (SELECT depth - 1 AS depth, up AS k, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL) x USING (depth, k)),
s AS (
  SELECT a.depth, a.k, count(*) FILTER (b.kids = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved
  FROM (SELECT DISTINCT a.depth, a.k, d.depth AS d2, d.k AS k2 FROM e a JOIN e d ON a.conv_id = d.conv_id AND a.depth <= d.depth) a JOIN m b ON b.depth = a.d2 AND b.k = a.k2 GROUP BY a.depth, a.k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, s.n_leaves, s.saved AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN s USING (depth, k) LEFT JOIN m u ON u.depth = m.depth - 1 AND u.k = m.up
"""
