"""Operator 1 - approximate nearest neighbours by an inverted file with product quantisation.

A bounded sample of ``train_rows`` vectors (documented bound, 16,384) fits coarse centroids
and one codebook per slice of the residuals; every valid row is then indexed. A query scores
the codes of its probed lists with asymmetric distance tables (inner product with the list's
centroid plus one table lookup per slice) and reranks a shortlist exactly in double precision.
The number of probed lists is chosen for queries that are really asked (256 of them, by hash)
against the sample, where exact neighbours are known, as the smallest that covers ``target`` of
them; so is the length of the shortlist, which is ``shortlist`` at least. Vectors that the fitted
model describes badly (rare long ones) are found besides by a bound: a list with a far
member is also probed where its centroid's score and that distance say so, and in a shard those whose
error is over twice the median are reranked by score and error.

Index rows are dealt to shards of about ``shard_rows`` vectors (whole lists, large lists over
several shards). Every query goes to the shards that hold a list it probes, and there to one of
as many chunks as ``query_rows`` queries at a time make of those that probe this shard; a shard
is copied once for each of its own chunks and not at all if nobody probes it. A task sees one
shard against one chunk, so no list, hot vector or query set has to fit one task, and what is
shuffled grows with the pairs of shard and query that are probed, over ``query_rows``.

Defined cases: vectors that are null, empty, all zero, of another length than the commonest
one, or that hold null or non-finite components take no part; neither do rows without id. An
id with several different vectors asks with each of them and counts once as a candidate, by its
best score. Codes that tie with the last one of the shortlist are reranked too.
Equal vectors are indexed once with their ``k + 1`` smallest ids, which is exact because a
query can return no others; repeated (id, vector) rows count once. Equal scores go to the
smaller id. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.staging import stage

#: Sub-groups in which a very common vector is thinned to its smallest ids before they meet.
THIN = 12


@dataclass(frozen=True)
class Model:
    """Coarse centroids (lists x d), codebooks (slices x codes x d/slices), lists to probe, codes to rerank."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int
    shortlist: int = 0


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, e) that take part in the search."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e"))
    inf = F.lit(float("inf"))
    finite: Column = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    d = d.filter(F.col("id").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0))
    sizes = d.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.filter(F.size("e") == (sizes[0]["n"] if sizes else 0))


def distinct_vectors(d: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: e, ids (its ``keep`` smallest, ascending)."""
    salted = W.partitionBy("e", F.pmod(F.xxhash64("id"), F.lit(THIN))).orderBy("id")
    whole = W.partitionBy("e").orderBy("id")
    d = d.withColumn("r", F.dense_rank().over(salted)).filter(F.col("r") <= keep).distinct()
    d = d.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= keep)
    return d.groupBy("e").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
    return c


def _reach(need: np.ndarray, share: float) -> int:
    """The smallest count of places that holds ``share`` of those needed (from 0)."""
    need = np.sort(need.ravel())
    return int(need[min(len(need) - 1, math.ceil(share * len(need)))]) + 1


def fit(sample: np.ndarray, lists: int, slices: int, target: float, k: int, seed: int = 7, asked: np.ndarray | None = None) -> Model:
    """Fit on the driver from the bounded sample, for queries like ``asked`` (some of the sample, if None)."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    c = _kmeans(x, min(lists, len(x)), 12, rng)
    home = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
    rest = (x - c[home]).reshape(len(x), slices, -1)
    books = np.stack([_kmeans(np.ascontiguousarray(rest[:, j]), min(256, len(x)), 8, rng) for j in range(slices)])
    q = x[rng.permutation(len(x))[:256]] if asked is None or not len(asked) else asked.astype(np.float32)
    k = min(k, len(x) - 1)
    if k < 1:
        return Model(c, books, len(c))
    own = np.stack([(x == v).all(1) for v in q])
    sims = q @ x.T
    sims[own] = -np.inf
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.empty((len(q), len(c)), dtype=int)
    order = np.argsort(-(q @ c.T), axis=1)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    coded = np.concatenate([b[(rest[:, j] @ b.T - 0.5 * (b * b).sum(1)).argmax(1)] for j, b in enumerate(books)], axis=1)
    rough = q @ (c[home] + coded).T
    rough[own] = -np.inf
    least = np.take_along_axis(rough, best, axis=1)
    ahead = np.stack([len(x) - np.searchsorted(np.sort(r), v, side="right") for r, v in zip(rough, least, strict=True)])
    return Model(c, books, _reach(np.take_along_axis(place, home[best], axis=1), target), _reach(ahead, 0.99))


def _encoder(m: Model):
    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            x = np.stack(p["e"].to_numpy()).astype(np.float32)
            home = (x @ m.centroids.T - 0.5 * (m.centroids**2).sum(1)).argmax(1)
            rest = (x - m.centroids[home]).reshape(len(x), len(m.codebooks), -1)
            codes = np.stack([(rest[:, j] @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for j, b in enumerate(m.codebooks)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"list": home.astype(np.int32), "code": [r.tobytes() for r in codes], "far": np.sqrt((rest**2).sum((1, 2))), "e": p["e"], "ids": p["ids"]})

    return encode


def _router(m: Model, shards_of: dict[int, list[int]], far: np.ndarray):
    """Queries with, for each shard that holds a probed list, the probed lists it holds. ``far``: the
    distance of each list's farthest member from its centroid."""
    rare = far > 2 * np.median(far[far > 0]) if (far > 0).any() else far > 0

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            q = np.stack(p["e"].to_numpy()).astype(np.float32)
            score = q @ m.centroids.T
            near = np.argsort(-score, axis=1, kind="stable")[:, : m.probes]
            if rare.any():
                most = np.argsort(-(score + np.sqrt((q * q).sum(1))[:, None] * far), axis=1, kind="stable")[:, : m.probes]
                near = [np.union1d(a, b[rare[b]]) for a, b in zip(near, most, strict=True)]
            rows = []
            for i, probed in enumerate(near):
                by_shard: dict[int, list[int]] = {}
                for c in probed.tolist():
                    for s in shards_of.get(c, ()):
                        by_shard.setdefault(s, []).append(c)
                rows += [(i, s, lists) for s, lists in by_shard.items()]
            at = [r[0] for r in rows]
            yield pd.DataFrame({"id": p["id"].to_numpy()[at], "e": p["e"].to_numpy()[at], "shard": np.array([r[1] for r in rows], np.int32), "lists": [r[2] for r in rows]})

    return route


def _searcher(m: Model, k: int, shortlist: int):
    def search(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(index) and len(queries):
            first = np.array([ids[0] for ids in index["ids"]])
            index = index.iloc[np.lexsort((first, index["list"].to_numpy()))]
            homes, ids = index["list"].to_numpy(), index["ids"].tolist()
            first = np.array([i[0] for i in ids])
            exact = np.stack(index["e"].to_numpy()).astype(np.float64)
            codes = np.frombuffer(b"".join(index["code"]), dtype=np.uint8).reshape(len(index), -1)
            error = m.centroids[homes].astype(np.float64)
            error += np.concatenate([b[codes[:, j]] for j, b in enumerate(m.codebooks)], axis=1)
            error = np.sqrt(((exact - error) ** 2).sum(1))
            rare = np.flatnonzero(error > 2 * np.median(error))
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q = np.stack(part["e"].to_numpy()).astype(np.float64)
                qf = q.astype(np.float32)
                tables = np.einsum("qsd,scd->sqc", qf.reshape(len(q), len(m.codebooks), -1), m.codebooks)
                score = np.full((len(q), len(index)), -np.inf, dtype=np.float32)
                probing: dict[int, list[int]] = {}
                for i, lists in enumerate(part["lists"]):
                    for c in lists:
                        probing.setdefault(int(c), []).append(i)
                for c, who in probing.items():
                    lo, hi = np.searchsorted(homes, [c, c + 1])
                    if lo == hi:
                        continue
                    s = np.repeat((qf[who] @ m.centroids[c])[:, None], hi - lo, axis=1)
                    for j in range(len(m.codebooks)):
                        s += np.take(tables[j][who], codes[lo:hi, j], axis=1)
                    score[who, lo:hi] = s
                r = min(shortlist, len(index))
                least = np.partition(score, len(index) - r, axis=1)[:, len(index) - r]  # ties with the last stay
                for i, qid in enumerate(part["id"].tolist()):
                    mine = np.flatnonzero((score[i] >= least[i]) & np.isfinite(score[i]))
                    if len(rare):
                        more = score[i][rare] + math.sqrt(q[i] @ q[i]) * error[rare]
                        more = rare[np.argpartition(-more, r - 1)[:r]] if len(rare) > r else rare
                        mine = np.union1d(mine, more[np.isfinite(score[i][more])])
                    true = np.einsum("nd,d->n", exact[mine], q[i])
                    best: dict[int, float] = {}
                    last = -math.inf
                    for n in np.lexsort((first[mine], -true)).tolist():
                        s = float(true[n])
                        if len(best) >= k and s < last:
                            break
                        for c in ids[mine[n]]:
                            if c != qid and c not in best:
                                best[c] = s
                        last = s
                    out += [(qid, c, s) for c, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def nearest(
    df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
    train_rows: int = 16_384, slices: int = 16, target: float = 0.975, shortlist: int = 400, shard_rows: int = 16_384, query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each
    query row. ``is_query`` is a condition on a column ``id``."""
    spark = df.sparkSession
    d = valid_vectors(df, id_col, vec_col)
    index = stage(distinct_vectors(d, k + 1), "vectors")
    n = index.count()
    few = index.filter(F.pmod(F.xxhash64("e"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.1 * train_rows / max(n, 1)) + 1))
    rows = few.select("e").limit(train_rows).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return spark.createDataFrame([], empty)
    x, kind = np.array([r["e"] for r in rows], dtype=np.float32), index.schema["e"].dataType.simpleString()
    dims = x.shape[1]
    slices = max(s for s in range(1, min(slices, dims) + 1) if dims % s == 0)
    lists = int(min(4096, max(8, 2 ** round(math.log2(math.sqrt(n) / 3.5)))))
    some = d.filter(is_query).select("e").orderBy(F.xxhash64("e", F.lit(1))).limit(256).collect()
    m = fit(x, lists, slices, target, k, asked=np.array([r["e"] for r in some], dtype=np.float32))
    shortlist = max(shortlist, m.shortlist)
    coded = stage(index.mapInPandas(_encoder(m), f"list int, code binary, far float, e {kind}, ids array<long>"), "coded")
    # a row per list, 4,096 at most, and per shard of ``shard_rows`` vectors
    known = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    sizes, far = {r["list"]: r["n"] for r in known}, np.zeros(len(m.centroids))
    for r in known:
        far[r["list"]] = r["far"]
    shards_of: dict[int, list[int]] = {}
    shard, room = 0, shard_rows
    for c in sorted(sizes):
        parts = max(1, math.ceil(sizes[c] / shard_rows))
        if parts > 1 or sizes[c] > room:
            shard, room = shard + (room < shard_rows), shard_rows
        shards_of[c] = list(range(shard, shard + parts))
        shard, room = (shard + parts, shard_rows) if parts > 1 else (shard, room - sizes[c])
    places = spark.createDataFrame([(c, s[0], len(s)) for c, s in shards_of.items()], "list int, at int, width int")
    queries = d.filter(is_query).distinct().mapInPandas(_router(m, shards_of, far), f"id long, e {kind}, shard int, lists array<int>")
    queries = stage(queries, "routed")
    chunks = queries.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("chunks"))
    right = queries.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("id", "e"), F.col("chunks")).cast("int")).drop("chunks")
    left = coded.join(places, "list").select((F.col("at") + F.pmod(F.xxhash64("e"), F.col("width")).cast("int")).alias("shard"), "list", "code", "e", "ids")
    left = left.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(_searcher(m, k, shortlist), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of ``embeddings``, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
