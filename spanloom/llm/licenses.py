"""Operator 8 - license scan by MinHash bands over overlapping windows, DataFrame functions only.

Templates and texts are words (letters and digits, lower case) and shingles of ``width``
words; a template shorter than that is one shingle of all its words. Templates of about one length
(between two powers of two, the larger one is L) are a class. For a class, a text is cut into blocks
of L shingles; a window is three blocks in a row, so windows overlap by two thirds and a passage of
at most 2L shingles, twice as long as any template of the class, lies whole in some window.

A band is a range of hash values, and what a set posts in it is its smallest hash there. A window
that holds ``held`` of a template's shingles collides with it in a band wherever the smallest hash of
their union is one that both have, so both miss each other with probability C(u - held, n) / C(u, n)
where n of the bands hold any of the u shingles of the union. ``bands_for`` takes the fewest bands
for which the pair meets with probability ``sure``, n being as u balls in so many bins give it. A
window's smallest hash in a band is that of one of its blocks, so the blocks post, each once, and
whatever a window would meet one of its blocks meets. Where that many bands are no fewer than the
shingles of a block (short templates, whose windows are few shingles), every shingle is what its band
holds, and is posted as it stands.

Texts that meet a template are verified exactly: the share of the template's shingles that the
windows around the block that met it, with a block more on either side, hold has to reach
``contain``. Templates are a table of their own; the tables that are joined hold a row per band of a
template, never texts, and whether they are broadcast is left to their measured size. Texts are never
joined with each other.

Defined cases: null and empty texts hold no license; very long texts are cut into blocks like
others; templates without words are ignored; templates that a passage holds alike are all named
(ties); rows that repeat an id are scanned each for itself; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import license_texts
from spanloom.staging import stage


def _words(text: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _shingles(words: str, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words."""
    run = lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, width)])
    return F.slice(F.transform(words, run), F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def bands_for(held: int, union: int, sure: float) -> int:
    """Bands by which two sets with ``held`` of ``union`` shingles in common meet with probability ``sure``."""
    if held >= union:
        return 1
    miss, apart = [1.0], union - held
    for n in range(union):  # chance that the smallest hashes of n + 1 bands are all of one side
        miss.append(miss[-1] * max(apart - n, 0) / (union - n))
    bands = next(n for n, m in enumerate(miss) if m <= 1 - sure)
    while True:
        filled = [1.0] + [0.0] * bands  # how many bands the shingles fall into
        for _ in range(union):
            filled = [0.0] + [filled[n] * n / bands + filled[n - 1] * (bands - n + 1) / bands for n in range(1, bands + 1)]
        if sum(p * miss[min(n, union)] for n, p in enumerate(filled)) <= 1 - sure or bands >= 8 * union:
            return bands
        bands += 1


def _smallest(hashes: Column, bands: int) -> Column:
    """The smallest hash in every band, of an ascending array of hashes."""
    band = lambda v: F.shiftright((F.shiftright(v, 32) + F.lit(2**31)) * F.lit(bands), 32)
    return F.filter(hashes, lambda v, i: (i == 0) | (band(v) != band(F.get(hashes, i - 1))))


def _met(texts: DataFrame, t: DataFrame, shapes: list[tuple[int, int, int]], width: int) -> DataFrame:
    """(id, h, t, k, class, at): blocks of texts that meet a template in a band. ``shapes``: width, class, bands."""
    whole = sorted({k for k, size, bands in shapes if bands >= size})
    cut = [(size, bands) for k, size, bands in shapes if bands < size]
    parts = []
    words = texts.select("id", "h", _words(F.col("text")).alias("w"))
    if whole:  # words are told one by one and hashed in the same generated code, as _shingles hashes them
        run = lambda k: F.when(F.col("p") + k <= F.size("w"), F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(k)]))
        told = words.select("id", "h", "w", F.posexplode_outer("w").alias("p", "x"))
        made = told.select("id", "h", "p", F.explode(F.array(*[run(k) for k in whole])).alias("value"))
        posted = t.filter("bands >= class").select("t", "k", "class", F.explode("ts").alias("value"))
        parts.append(made.join(posted, "value").select("id", "h", "t", "k", "class", F.floor(F.col("p") / F.col("class")).cast("int").alias("at")))
    if cut:  # templates of more than one shingle, so all have the full width
        shingled = words.filter(F.size("w") >= width).select("id", "h", _shingles("w", width).alias("s"))
        blocks = []
        for size, bands in cut:
            starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(size))
            rows = F.transform(starts, lambda i: F.sort_array(F.slice("s", i + 1, F.lit(size))))  # noqa: B023
            blocks.append(F.transform(rows, lambda x, at: F.struct(F.lit(size).alias("class"), at.alias("at"), _smallest(x, bands).alias("values"))))  # noqa: B023
        made = shingled.select("id", "h", F.explode(F.concat(*blocks)).alias("b")).select("id", "h", "b.class", "b.at", F.explode("b.values").alias("value"))
        mine = [F.when(F.col("class") == size, _smallest(F.col("ordered"), bands)) for size, bands in cut]
        posted = t.filter("bands < class").withColumn("ordered", F.sort_array("ts")).select("t", "k", "class", F.explode(F.coalesce(*mine)).alias("value"))
        parts.append(made.join(posted, ["value", "class"]).select("id", "h", "t", "k", "class", "at"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def scan(docs: DataFrame, templates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, contain: float = 0.8, sure: float = 0.9999) -> DataFrame:
    """``templates``: name, form, text; name and form together are unique. One row per row of
    ``docs`` and template found in it: id, uid (of the row), name, form, share (the best that
    windows hold), windows (blocks that met it and hold enough around them)."""
    t = templates.select("name", "form", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    t = t.withColumn("k", F.least(F.size("w"), F.lit(width)))
    t = t.withColumn("ts", F.array_distinct(F.coalesce(*[F.when(F.col("k") == k, _shingles("w", k)) for k in range(1, width + 1)])))
    t = t.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("ts").cast("double")))).cast("int"))
    t = stage(t.select(F.monotonically_increasing_id().alias("t"), "name", "form", "k", "ts", "class"), "license_templates")
    fewest = [tuple(r) for r in t.groupBy("k", "class").agg(F.min(F.size("ts"))).collect()]  # a few: widths up to five, powers of two
    if not fewest:
        return docs.select(F.col(f"`{id_col}`").alias("id"), *[F.lit(None).cast(c).alias(n) for n, c in (("uid", "long"), ("name", "string"), ("form", "string"), ("share", "double"), ("windows", "long"))]).limit(0)
    shapes = []
    for k, size, least in sorted(fewest):
        held = math.ceil(contain * least - 1e-9)
        shapes.append((k, size, bands_for(held, 3 * size + least - held, sure)))
    is_shape = lambda k, size: (F.col("k") == k) & (F.col("class") == size)
    t = t.withColumn("bands", F.coalesce(*[F.when(is_shape(k, size), F.lit(bands)) for k, size, bands in shapes]))

    # a text is known again by its id and digest
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text", F.length("text"), F.lit(3)))
    met = _met(texts, t, shapes, width).groupBy(F.col("id").alias("i"), F.col("h").alias("d")).agg(F.collect_set(F.struct("t", "k", "class", "at")).alias("hits"))  # of one text
    met = stage(met, "license_met")

    widths = sorted({k for k, _, _ in shapes})
    near = texts.join(met, F.col("h").eqNullSafe(F.col("d")) & F.col("id").eqNullSafe(F.col("i")))
    near = near.select("id", F.monotonically_increasing_id().alias("uid"), "hits", _words(F.col("text")).alias("w"))
    near = near.select("id", "uid", "hits", *[_shingles("w", k).alias(f"s{k}") for k in widths])
    near = near.select("id", "uid", *[f"s{k}" for k in widths], F.explode("hits").alias("hit")).select("id", "uid", "hit.*", *[f"s{k}" for k in widths])
    start = F.greatest((F.col("at") - 3) * F.col("class"), F.lit(0))
    wide = lambda s: F.slice(s, start + 1, (F.col("at") + 4) * F.col("class") - start)
    held_in = F.coalesce(*[F.when(F.col("k") == k, wide(f"s{k}")) for k in widths])
    near = near.select("id", "uid", "t", held_in.alias("held"))
    found = near.join(t.select("t", "name", "form", "ts"), "t")
    found = found.select("id", "uid", "name", "form", (F.size(F.array_intersect("ts", "held")) / F.size("ts")).alias("share"))
    found = stage(found.filter(F.col("share") >= contain), "license_found")  # ids of rows stay as they were given
    return found.groupBy("uid", "name", "form").agg(F.any_value("id").alias("id"), F.max("share").alias("share"), F.count("*").alias("windows")).select("id", "uid", "name", "form", "share", "windows")


def known_licenses(spark: SparkSession) -> DataFrame:
    """Notices, tags and texts of common licenses as templates."""
    return spark.createDataFrame(license_texts.templates(), "name string, form string, text string")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses that ``documents`` carry or name: doc_id, license, form (notice, tag or text), share
    of the wording found."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licenses(spark))
    return found.select(F.col("id").alias("doc_id"), F.col("name").alias("license"), "form", "share")
