"""Operator 9 - URL filters by a temporal list join, DataFrame functions only.

A list is dated: entries are added and removed. Every entry's history becomes validity
intervals [start, end); consecutive additions count once. A capture gives the keys under which
an entry could name it - its host, every parent domain, its address, every path prefix - and
joins the intervals on the key, as of its fetch time. Keys per capture are bounded by the
length of its address, so no capture meets the whole list, and a host with a third of all
captures only makes one join key frequent, which adaptive execution splits.

Addresses are compared without scheme, fragment, port, user and a ``www.`` label, hosts in
lower case. Entry kinds: domain (host or any parent), url (exact), prefix (whole path parts).

Defined cases: a null address or fetch time matches nothing; entries with a null in any column
are ignored; of entries of one key at one time a removal comes first, so the addition holds;
repeated captures give repeated rows; very long addresses have as many keys as labels and path
parts; an empty list blocks nothing, empty captures give no rows. Columns of any name are kept, but
those named ``blocked``, ``n_entries`` and ``entry`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.staging import stage


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and www; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?i:www\.)?([^/:?#]*)", 1))


def address_of(url: Column) -> Column:
    """Host and the rest up to a fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1))


def with_keys(df: DataFrame, url_col: str, out: str) -> DataFrame:
    """``df`` with an array of ``kind:value`` keys; null without a host. The address is taken
    apart once, in columns, before the keys are put together."""
    d = df.withColumns({"__host": host_of(F.col(url_col)), "__address": address_of(F.col(url_col))})
    d = d.withColumns({"__labels": F.split("__host", r"\."), "__parts": F.split(F.regexp_extract("__address", r"^[^?]*", 0), "/")})
    parents = F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice("__labels", i, F.size("__labels")), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda i: F.concat(F.lit("prefix:"), F.array_join(F.slice("__parts", F.lit(1), i), "/")))
    keys = F.array_distinct(F.concat(parents, prefixes, F.array(F.concat(F.lit("url:"), F.col("__address")))))
    return d.withColumn(out, F.when(F.col("__host") != "", keys)).drop("__host", "__address", "__labels", "__parts")


def validity(entries: DataFrame) -> DataFrame:
    """``entries``: kind, value, action (add or remove), at. Intervals key, start, end."""
    e = entries.dropna().select(F.concat_ws(":", "kind", "value").alias("key"), (F.col("action") == "add").alias("on"), "at").distinct()
    w = W.partitionBy("key").orderBy("at", "on")
    turns = e.withColumn("was", F.lag("on", 1, False).over(w)).filter(F.col("on") != F.col("was"))
    return turns.withColumn("end", F.lead("at").over(w)).filter("on").select("key", F.col("at").alias("start"), "end")


def listed(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``n_entries`` and ``entry`` (the first key by code point)
    of the list as it stood when the capture was fetched."""
    spans = stage(validity(entries).filter(F.col("end").isNull() | (F.col("start") < F.col("end"))), "url_spans")
    keep = [c for c in captures.columns if c not in ("blocked", "n_entries", "entry")]
    rows = captures.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{time_col}`").alias("t"), F.col(f"`{url_col}`").alias("url"))
    rows = with_keys(rows, "url", "keys")
    asked = rows.select("uid", "t", F.explode("keys").alias("key"))
    met = asked.join(spans, "key").filter((F.col("start") <= F.col("t")) & (F.col("end").isNull() | (F.col("t") < F.col("end"))))
    hits = met.groupBy("uid").agg(F.count("*").alias("n_entries"), F.min("key").alias("entry"))
    out = rows.select("uid", "row").join(hits, "uid", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("entry").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), "entry")


def derived_list(captures: DataFrame) -> DataFrame:
    """A dated list made from the captures' own hosts and addresses: half of the parent domains
    come and go with dates drawn from their digest, hosts named spam stay, every 50th page's
    address is listed for 200 days, and of every 50th other page all that lies under the first part
    of its path, for 100."""
    draw = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    day = lambda n: F.timestamp_micros((F.lit(1704067200).cast("long") + n * 86400) * 1_000_000)
    domain = captures.select(F.regexp_replace(host_of(F.col("url")), r"^[^.]*\.(?=[^.]*\.[^.]*\.)", "").alias("value")).distinct().filter("value != ''")
    d = domain.withColumn("h", draw(F.col("value")))
    event = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    spam = F.col("value").startswith("spam")
    start = F.col("h") % 300
    events = F.when(spam, F.array(event("add", F.lit(0)))).when(
        F.col("h") % 2 == 0,
        F.concat(F.array(event("add", start)), F.when(F.col("h") % 4 == 0, F.array(event("remove", start + 120), event("add", start + 240))).otherwise(F.array(event("remove", start + 200)))),
    )
    domains = d.select(F.lit("domain").alias("kind"), "value", F.explode(events).alias("e")).select("kind", "value", "e.*")
    pages = captures.filter(F.col("page_id") % 50 == 3).select(address_of(F.col("url")).alias("value"), (F.col("page_id") % 365).alias("n")).filter("value != ''")
    urls = pages.select(F.lit("url").alias("kind"), "value", F.explode(F.array(event("add", F.col("n")), event("remove", F.col("n") + 200))).alias("e")).select("kind", "value", "e.*")
    part = F.regexp_extract(address_of(F.col("url")), r"^[^/?]*/[^/?]+", 0)
    under = captures.filter(F.col("page_id") % 50 == 7).groupBy(part.alias("value")).agg(F.min(F.col("page_id") % 365).alias("n")).filter("value != ''")
    under = under.select(F.lit("prefix").alias("kind"), "value", F.explode(F.array(event("add", F.col("n")), event("remove", F.col("n") + 100))).alias("e")).select("kind", "value", "e.*")
    return domains.unionByName(urls).unionByName(under)


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day drawn from its id, against the list of that day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_micros((F.lit(1704067200).cast("long") + F.pmod(F.col("page_id") * 7919, F.lit(730)) * 86400 + 43200) * 1_000_000))
    out = listed(captures, derived_list(captures))
    return out.select("page_id", F.unix_micros("fetched_at").alias("fetched_us"), "blocked", "n_entries", "entry")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, 1704067200 + (page_id * 7919) % 730 * 86400 + 43200 AS t,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[Ww][Ww][Ww]\.)?([^/:?#]*)', 1)) AS host,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
d AS (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) >= 4 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS value FROM p WHERE host <> ''),
h AS (SELECT value, CAST('0x' || substr(md5(value), 1, 6) AS BIGINT) AS h FROM d),
i AS (
  SELECT 'domain:' || value AS key, 0 AS a, NULL AS b FROM h WHERE starts_with(value, 'spam')
  UNION ALL SELECT 'domain:' || value, h % 300, h % 300 + CASE WHEN h % 4 = 0 THEN 120 ELSE 200 END FROM h WHERE NOT starts_with(value, 'spam') AND h % 2 = 0
  UNION ALL SELECT 'domain:' || value, h % 300 + 240, NULL FROM h WHERE NOT starts_with(value, 'spam') AND h % 4 = 0),
u AS (SELECT DISTINCT 'url:' || host || rest AS key, page_id % 365 AS a FROM p WHERE page_id % 50 = 3 AND host <> ''),
v AS (SELECT regexp_extract(host || rest, '^[^/?]*/[^/?]+') AS value, min(page_id % 365) AS a FROM p WHERE page_id % 50 = 7 GROUP BY 1 HAVING value <> '' AND NOT starts_with(value, '/')),
m AS (
  SELECT page_id, key FROM p JOIN i ON ('domain:' || host = key OR ends_with(host, '.' || substr(key, 8)))
    AND t >= 1704067200 + a * 86400 AND (b IS NULL OR t < 1704067200 + b * 86400)
  UNION ALL
  SELECT page_id, key FROM p JOIN u ON 'url:' || host || rest = key AND t >= 1704067200 + a * 86400 AND t < 1704067200 + (a + 200) * 86400
  UNION ALL
  SELECT page_id, 'prefix:' || value FROM p JOIN v ON (regexp_extract(host || rest, '^[^?]*') = value OR starts_with(regexp_extract(host || rest, '^[^?]*'), value || '/'))
    AND t >= 1704067200 + a * 86400 AND t < 1704067200 + (a + 100) * 86400)
SELECT p.page_id, any_value(p.t) * 1000000 AS fetched_us, count(key) > 0 AS blocked, count(key) AS n_entries, min(key) AS entry
FROM p LEFT JOIN m USING (page_id) GROUP BY p.page_id
"""
