"""Operator 2 - mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Within a source each document is expected
``target / source size`` times; expected copies are prefix-summed in order of size, one
offset per source is added, and a document is emitted once per integer boundary its interval
crosses. Sampling in order of size keeps the words taken within one largest document of the
target (summation by parts), and the copies of a document differ from what is expected by
less than one.

No task sees a whole source: rows are counted in cells (source, size, 1 of 4,096 hash
buckets), the cells are prefix-summed over buckets and then over the distinct sizes of a
source, and a row only ranks itself within its cell.

Defined cases: a null source is a source of its own, last in order; null and empty texts have
size 0 and a share of 0 words; very long texts count whole; repeated rows rank next to each other
and give the same rows in any order, and rows that share id and size go by a digest of the text.
An empty table gives no rows. Columns of any name are kept, ``__mix`` is replaced. Results depend
on ids, texts and ``seed`` only, not on partitioning. Targets are found over one row of a few
numbers per source, in one task: sources may be as many as hosts, not as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.text import count_words
from spanloom.staging import stage


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """``sizes``: key, source_size, one row per source. Adds ``target``: what the weights give
    of all sizes together, no source above ``cap`` times its size, excess reshared by weight.

    Sources are filled in order of cap / weight, so the level at which the uncapped ones stand
    has a closed form. The windows here run over one row per source."""
    at = F.row_number().over(W.orderBy("key")) - 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("w"))
    order = W.orderBy("level", "key")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("at", F.row_number().over(order)).withColumn("try", (F.sum("source_size").over(whole) - full) / rest)
    s = s.withColumn("fill", F.min(F.when(F.col("try") <= F.col("level"), F.struct("at", "try"))).over(whole)["try"])
    return s.select("key", "source_size", F.least(F.col("most").cast("double"), F.col("fill") * F.col("w")).alias("target"))


def source_key(source: Column) -> Column:
    """Not null, ordered as the sources by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, tie_col: str | None = None, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, seed: int = 0) -> DataFrame:
    """``docs`` with struct ``__mix``: size, source_size, target, copies. Sizes and digests of texts
    may be given as columns instead of the text."""
    of = lambda c: F.col(f"`{c}`")
    keep = [c for c in docs.columns if c != "__mix"]
    size = of(size_col) if size_col else count_words(of(text_col))
    same = of(tie_col) if tie_col else F.xxhash64(of(text_col))
    tie = F.md5(F.coalesce(of(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[of(c) for c in keep]).alias("row"), size.alias("__size"), source_key(of(source_col)).alias("__key"), tie.alias("__tie"), of(id_col).alias("__id"), same.alias("__same"))
    rows = rows.withColumn("__cell", F.substring("__tie", 1, 3))
    counted = rows.groupBy(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__cell").alias("cell")).agg(F.count("*").alias("n"))
    cells = stage(counted, "mix_cells")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    steps = steps.select("key", "size", before(W.partitionBy("key").orderBy("size")).alias("upto"))
    per_source = targets(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    place = cells.withColumn("inner", before(W.partitionBy("key", "size").orderBy("cell"))).join(steps, ["key", "size"]).join(per_source, "key")
    place = place.select(
        F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("cell").alias("__cell"), (F.col("upto") + F.col("inner")).alias("__before"),
        "source_size", "target", offset.alias("__offset"),
    )
    rank = F.row_number().over(W.partitionBy("__key", "__size", "__cell").orderBy("__tie", "__id", "__same"))
    out = rows.withColumn("__rank", rank).join(place, ["__key", "__size", "__cell"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("__before") + F.col("__rank")
    copies = F.floor(each * upto + F.col("__offset")) - F.floor(each * (upto - 1) + F.col("__offset"))
    made = F.struct(F.col("__size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], made.alias("__mix"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    taken = mix(docs, **options).filter(F.col("__mix.copies") > 0)
    each = F.explode(F.sequence(F.lit(1), F.col("__mix.copies").cast("int"))).alias("__copy")
    return taken.select("*", each).select(*[F.col(f"`{c}`") for c in docs.columns if c != "__mix"])


def op2_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stage(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("same")), "mix_sizes")
    m = mix(sized, size_col="size", tie_col="same")
    return m.select("doc_id", F.col("__mix.size").alias("size"), F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), (F.col("__mix.copies") * F.col("__mix.size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, source_size * 3 AS most, source_size * 3 / w AS level FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY level, k) AS pos,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY level, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
      FROM l),
x AS (SELECT arg_min(fill, pos) AS fill FROM f WHERE fill <= level),
t AS (SELECT k, source_size, least(CAST(most AS DOUBLE), x.fill * w) AS target,
         CAST(CAST('0x' || substr(md5('0:' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
      FROM f, x),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
         row_number() OVER (PARTITION BY k ORDER BY size, tie, doc_id) AS n
      FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target, size * CAST(floor(e * n + u) - floor(e * (n - 1) + u) AS BIGINT) AS taken FROM r
"""
