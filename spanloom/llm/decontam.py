"""Operator 13 - benchmark decontamination by a broadcast hash set of n-grams, DataFrame functions only.

Texts are lower-cased in A-Z and cut into words (letters and digits of ASCII, anything beyond it).
A window is ``width`` consecutive words of a benchmark item; a shorter item is one window of all
its words. The distinct windows with their 64-bit hashes are the set. Every text makes the hashes of
its own windows, of each length that the set has, and probes the set in the pass that reads it; a
hit counts if the words agree. A word inside any occurrence of a window is hit.

The set is broadcast only if its measured size is under ``most_bytes``; a larger one is met by a
join on hashes, whose hits meet the written texts again. Both ways give the same rows. A passage
that a third of all texts hold makes rows in proportion to its occurrences, and never pairs texts.

Defined cases: a null text has no words; a text or item without words hits nothing; very long texts
are scanned whole; items that share a window are all named; an item without id is named by an empty
text, rows that repeat an id or are repeated are judged each for itself; an empty table gives no
rows, an empty benchmark no hits. Other columns are ignored, whatever their names; ``decontaminate``
keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.staging import stage

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(_lowered(text), BETWEEN), "")


def _hashes(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words; the length is part of the hash."""
    run = lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(words, i + j) for j in range(1, k)])
    return F.slice(F.transform(words, run), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def benchmark_windows(bench: DataFrame, *, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (g, h, k, w: number, hash, length, words) and the items of each (g, item)."""
    b = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text_col}`")).alias("words"))
    b = b.filter(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(width)))
    own = F.coalesce(*[F.when(F.col("k") == k, _hashes("words", k)) for k in range(1, width + 1)])
    b = b.select("item", "words", "k", F.posexplode(own).alias("at", "h"))
    b = stage(b.select("item", "k", "h", F.slice("words", F.col("at") + 1, F.col("k")).alias("w")), "decontam_items")
    windows = stage(b.select("h", "k", "w").distinct().withColumn("g", F.monotonically_increasing_id()), "decontam_windows")
    return windows, stage(b.join(windows, ["h", "k", "w"]).select("g", "item").distinct(), "decontam_members")


def _hash_at(words: str, at: Column, k: int) -> Column:
    """Hash of the ``k`` words from place ``at``, as ``_hashes`` makes it."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _probe(rows: DataFrame, windows: DataFrame, most_bytes: int) -> DataFrame:
    """``rows``: uid, id, key, words. A row per row of it with ``start`` null, and one per occurrence
    of a window: uid, id, key, n_words, start, k, g.

    Words are told one by one and the hash of the window that begins there is made in the same
    generated code, so no array of hashes is built; place 0 stands for the text itself."""
    seen = windows.agg(F.sum(F.octet_length(F.array_join("w", " ")) + F.lit(64)).alias("bytes"), F.sort_array(F.collect_set("k")).alias("ks")).first()  # lengths are at most ``width``
    few, lengths = (seen["bytes"] or 0) <= most_bytes, list(seen["ks"] or [])
    rows = rows.select("uid", "id", "key", F.concat(F.array(F.lit("")), "words").alias("words"))
    rows = rows if few else stage(rows, "decontam_texts")
    itself, place = F.col("at") == 0, F.col("at").cast("long")
    told = lambda *keep: rows.select("uid", *keep, (F.size("words") - 1).alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
    windowed = lambda d: d.withColumn("h", F.when(itself, F.lit(0).cast("long")).otherwise(_hash_at("words", F.col("at"), lengths[0]))) if len(lengths) == 1 else d.withColumn("h", F.explode(F.when(itself, F.array(F.lit(0).cast("long"))).otherwise(F.array(*[_hash_at("words", F.col("at"), k) for k in lengths]))))
    texts = rows.sparkSession.sql("SELECT CAST(0 AS BIGINT) AS h, 0 AS k, CAST(array() AS array<string>) AS w, CAST(NULL AS BIGINT) AS g")
    every = windows.select("h", "k", "w", "g").unionByName(texts)
    same = F.when(itself, F.col("k") == 0).otherwise((F.col("k") > 0) & (F.slice("words", F.greatest(F.col("at") + 1, F.lit(1)), F.greatest("k", F.lit(1))) == F.col("w")))
    out = ["uid", "id", "key", "n_words", F.when(F.col("k") > 0, place - 1).alias("start"), F.when(F.col("k") > 0, F.col("k")).alias("k"), "g"]
    if few:
        return windowed(told("id", "key", "words")).drop("word").join(F.broadcast(every), "h").filter(same).select(*out)
    met = windowed(told("words")).select("uid", "n_words", "at", "h").join(every.select("h", "k", "g"), "h")
    met = stage(met, "decontam_met")
    return met.join(rows, "uid").join(every.select("g", "w"), met["g"].eqNullSafe(every["g"])).filter(same).select("uid", "id", "key", "n_words", *out[4:6], met["g"])


def occurrences(docs: DataFrame, windows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """A row per row of ``docs`` with ``start`` null, and one per occurrence of a window, told by the
    place of its first word: uid (of the row), id, key, n_words, start, k, g. ``key`` is carried."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), (F.lit(None).cast("string") if key is None else key).alias("key"), words_of(F.col(f"`{text_col}`")).alias("words"))
    return stage(_probe(rows, windows, most_bytes), "decontam_hits")


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, key: Column | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: id, key, n_words, hit (places of the words hit, ascending), items
    (ids as text, sorted)."""
    windows, members = benchmark_windows(bench, item_col=item_col, text_col=item_text_col, width=width)
    found = occurrences(docs, windows, id_col=id_col, text_col=text_col, key=key, most_bytes=most_bytes)
    inside = F.flatten(F.transform(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "k"))), lambda s: F.sequence(s["start"], s["start"] + s["k"] - 1)))
    texts = found.groupBy("uid").agg(F.first("id").alias("id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(inside)).alias("hit"))
    named = found.filter("g is not null").select("uid", "g").distinct().join(members, "g").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return texts.join(named, "uid", "left").select("id", "key", "n_words", "hit", F.coalesce("items", none).alias("items"))


def spans(hit: Column | str) -> Column:
    """Runs of neighbouring places as an array of (start, end), end exclusive."""
    hit = F.col(hit) if isinstance(hit, str) else hit
    first = F.filter(hit, lambda x, i: ~F.coalesce(F.get(hit, i - 1) == x - 1, F.lit(False)))
    last = F.filter(hit, lambda x, i: ~F.coalesce(F.get(hit, i + 1) == x + 1, F.lit(False)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def decontaminate(docs: DataFrame, bench: DataFrame, *, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window (``remove="documents"``), or with the words
    inside windows and what stands between them and the next word cut out (``"spans"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    text = F.col(f"`{text_col}`")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    dirty = contamination(docs, bench, id_col=id_col, text_col=text_col, key=digest, **options).filter(F.size("hit") > 0)
    dirty = stage(dirty.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("hit").alias("__hit")).dropDuplicates(["__id", "__key"]), "decontam_dirty")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (digest == F.col("__key"))
    if remove == "documents":
        return docs.join(dirty, same, "left_anti")
    word, rest = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", BETWEEN.replace(r"\x60", r"\x40\x5B-\x60")
    units = F.regexp_extract_all(text, F.lit(f"{word}(?:{rest})?"), F.lit(0))
    lead = F.regexp_extract(text, f"^{rest}", 0)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__units") - 1), F.col("__hit"))
    cut = docs.join(dirty, same, "left").withColumn("__units", F.when(F.col("__hit").isNotNull(), units))
    left = F.concat(lead, F.array_join(F.transform(kept, lambda i: F.get("__units", i)), ""))
    names = [F.when(F.col("__hit").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return cut.select(*names)


def op13_decontam(spark, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n = lambda c: F.size(c).cast("long")
    out = contamination(docs, bench)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), n("hit").alias("n_hit"), n("items").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM s),
l AS (SELECT DISTINCT k FROM t),
p AS (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, l WHERE len(w) >= k),
m AS (SELECT uid, i, p.k, item FROM (SELECT uid, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM p) p JOIN t ON p.k = t.k AND p.x = t.x),
h AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT uid, i, k FROM m)) GROUP BY uid),
n AS (SELECT uid, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN n USING (uid)
"""
