"""Operator 5 - quality classifier: random Fourier features of document statistics, ridge
regression from partition-summed normal equations, isotonic calibration.

Statistics come from the text alone. On labelled rows (crc32 of the id as text modulo 3 is
not 1) they are standardised and mapped to cosine features, which approximate a Gaussian
kernel; the standardised statistics themselves and a constant stand beside them, so that what is
linear needs no waves. Every partition sums its own part of the normal equations, one set per fold; Spark
adds the parts up and the driver solves systems whose size the number of features fixes. Each
fold is scored by the other fold's solution; counts of labels by score bin (at most 3,001
rows) are made monotone by pooling adjacent violators, which turns scores into probabilities.
All labelled rows take part; nothing is sampled.

Defined cases: null and empty texts have statistics of zero and get a score like any other
text; very long texts are counted whole, one at a time in a task; labels that are null or of null ids teach nothing, an id labelled more than once counts
by its mean label; with no labelled rows all scores are 0.5, with one kind of label the score
is that label. Rows with a null id are not held out. Repeated rows give repeated rows, empty tables
none. Columns of any name are kept, ``__score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.staging import stage

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", bytes(range(128, 256)))
_MASKS = np.array([[b in c for b in range(256)] for c in _CLASSES], dtype=np.float64)
N_STATS = len(_CLASSES) + 8


def statistics(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, lengths, and how much of the text repeats."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(N_STATS)
    if not words:
        return out
    n, size = len(words), sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    out[: len(_CLASSES)] = _MASKS @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / len(raw)
    out[len(_CLASSES) :] = (
        np.log1p(n), size / n, lengths.std(), np.log1p(lengths.max()), len(set(words)) / np.sqrt(n), grams / max(1, n - 2),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    )
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    """Statistics of texts as a column."""
    return pd.Series([statistics(t) for t in text])


@dataclass(frozen=True)
class Model:
    """Standardisation, Fourier features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _pool(score: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent violators pooled: increasing scores and non-decreasing means."""
    blocks: list[list[float]] = []
    for s, t, c in zip(score, total, n, strict=True):
        blocks.append([s * c, t, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stats_col: str = "f", waves: int = 128, ridge: float = 1e-3, seed: int = 5) -> Model:
    """``docs``: id and statistics. Learns ``labels.quality`` from rows that aren't held out."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg("quality").alias("y"))
    rows = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(stats_col).alias("f")).join(marks, "id")
    rows = stage(rows.select("f", "y", (F.crc32(F.col("id").cast("string").cast("binary")) % 2).cast("int").alias("fold")), "quality_rows")
    moments = rows.agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[g(F.element_at("f", i + 1)).alias(f"{k}{i}") for i in range(N_STATS) for k, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"] or moments["lo"] == moments["hi"]:
        flat = moments["lo"] if moments["n"] else 0.5
        zero = np.zeros(N_STATS)
        return Model(zero, zero + 1, np.zeros((N_STATS, 1)), np.zeros(1), np.zeros(N_STATS + 2), np.zeros(1), np.array([flat]))
    mean, scale = (np.array([moments[f"{k}{i}"] for i in range(N_STATS)], dtype=float) for k in "ms")
    rng = np.random.default_rng(seed)
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.zeros(1), np.zeros(1))
    width = waves + N_STATS + 1

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width, width + 1))
        for p in parts:
            for fold, g in p.groupby("fold"):
                phi = blank.map(np.stack(g["f"].to_numpy()))
                total[fold] += phi.T @ np.hstack([phi, g["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"fold": np.repeat([0, 1], width), "i": np.tile(np.arange(width), 2), "row": [r for m in total for r in m]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": g["fold"][:1], "i": g["i"][:1], "row": [np.stack(g["row"].to_numpy()).sum(axis=0)]})

    shape = "fold int, i int, row array<double>"
    system = np.zeros((2, width, width + 1))
    for r in rows.mapInPandas(sums, shape).groupBy("fold", "i").applyInPandas(added, shape).collect():  # 2 x width rows
        system[r["fold"], r["i"]] = r["row"]

    def solve(m: np.ndarray) -> Model:
        a = m[:, :width] + ridge * max(1.0, m[-1, width - 1]) * np.eye(width)
        return Model(blank.mean, blank.scale, blank.waves, blank.phases, np.linalg.solve(a, m[:, width]), blank.knots, blank.values)

    other, final = [solve(system[1]), solve(system[0])], solve(system.sum(axis=0))

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.stack(p["f"].to_numpy()) if len(p) else np.zeros((0, N_STATS))
            s = np.where(p["fold"] == 0, other[0].raw(x), other[1].raw(x))
            yield pd.DataFrame({"bin": np.round(np.clip(s, -1, 2) * 1000).astype(np.int32), "y": p["y"].to_numpy()})

    curve = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots, values = _pool(*(np.array([r[k] for r in curve], dtype=float) for k in ("bin", "y", "n")))
    return Model(final.mean, final.scale, final.waves, final.phases, final.weights, knots / 1000, values)


def scorer(model: Model):
    """Column function: statistics to probability of label 1."""

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(f.to_numpy())) if len(f) else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score``; the text is read twice, in training for labelled rows only
    where Spark can push the choice of rows below the statistics."""
    model = fit(docs.select(F.col(f"`{id_col}`").alias("id"), features(F.col(f"`{text_col}`")).alias("f")), labels.withColumnRenamed(id_col, "id"), id_col="id")
    return docs.withColumn("__score", scorer(model)(features(F.col(f"`{text_col}`"))))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = stage(docs.select("doc_id", features(F.col("text")).alias("f")), "quality_stats")
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.select("doc_id", held_out("doc_id").alias("held_out"), scorer(model)("f").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
