"""Operator 11 - a Merkle manifest of a dataset as a content-addressed DAG with proofs by descent.

Every row is a leaf, the digest of its fields. Leaves of a group stand in order; every ``fan``
consecutive nodes become the digest of their digests until one is left, the group's subroot, and
the subroots in order of groups become the root in the same way. What is stored is a record per
inner node: its digest and its children's digests, each once, however often the same content occurs.

Proofs are made by descent from the root. A request is a leaf's rank; its digits in base ``fan``
say which child to take in each record. Requests that share a prefix of digits travel as one: a round
looks up the records of the nodes reached so far by their digests, takes the children that lead to
a request, and collects those not taken as the next segment of the path. So round by round there are
as many rows as nodes of a level, never a copy of the root per leaf; only the last segment is taken per
leaf. Segments are then read backwards, from the leaf to the root. Ranks are dealt by ranges
(``ranks.ranked``), so no group is in one task, be it all rows.

Defined cases: null fields are written ``-``; ids may be null (they come first) or repeated (rows of
one id stand by their leaf's digest; equal rows are leaves of their own); a null group comes first;
very long texts are digested whole; an empty table has no root and no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontam import LOWER, UPPER
from spanloom.llm.ranks import ranked
from spanloom.staging import stage

FAN = 8


def digest_of(values: list[Column]) -> Column:
    """Digest of fields: each ``-`` if null, else its bytes in UTF-8, ``:`` and itself."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256)


def build(leaves: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``leaves``: grp (not null), rank (from 0 without gaps), digest. The records (digest, children),
    each digest once, and the tops (grp, digest, height) of the groups. A group of one leaf has
    height 0 and no record."""
    counts = leaves.groupBy("grp").agg(F.count("*").alias("n"))
    level = stage(leaves.select("grp", "rank", F.col("digest").alias("d")).join(counts, "grp"), "merkle_leaves")
    most, height = level.agg(F.max("n")).first()[0] or 0, 0
    top = lambda: level.filter("n = 1").select("grp", F.col("d").alias("digest"), F.lit(height).alias("height"))
    tops, inner = top(), level.limit(0).select(F.col("d").alias("digest"), F.array("d").alias("children"))
    while most > 1:
        height, most = height + 1, -(-most // fan)
        run = F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"])  # ``fan`` rows at most
        runs = level.filter("n > 1").groupBy("grp", F.expr(f"rank div {fan}").alias("rank")).agg(run.alias("children"), F.expr(f"(first(n) + {fan - 1}) div {fan}").alias("n"))
        level = stage(runs.withColumn("d", F.sha2(F.array_join("children", ""), 256)), "merkle_level")
        tops, inner = tops.unionByName(top()), inner.unionByName(level.select(F.col("d").alias("digest"), "children"))
    return inner.dropDuplicates(["digest"]), tops


def manifest(leaves: DataFrame, fan: int = FAN) -> dict[str, DataFrame]:
    """``leaves``: grp, rank, digest. Tables records (digest, children), groups (grp, place, digest,
    height: the subroots in order) and root (digest, height), one row or none."""
    inner, tops = build(leaves, fan)
    groups = ranked(tops, [], ["grp"], "place")
    groups = stage(groups.select("grp", "place", "digest", "height"), "merkle_groups")
    upper, root = build(groups.select(F.lit("").alias("grp"), F.col("place").alias("rank"), "digest"), fan)
    records = stage(inner.unionByName(upper).dropDuplicates(["digest"]), "merkle_records")
    return {"records": records, "groups": groups, "root": stage(root.select("digest", "height"), "merkle_root")}


def write(tables: dict[str, DataFrame], path: str) -> None:
    """The manifest as Parquet tables below ``path``."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("records", "groups", "root")}


def _others(children: str, digit: Column, fan: int) -> Column:
    """The children not taken, left and right of the one that is."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(children, digit + 2, F.lit(fan)), "").alias("right"))


def _down(at: DataFrame, records: DataFrame, fan: int) -> DataFrame:
    """One round: from nodes (grp, idx, digest, height, path) to their children."""
    met = at.join(records, "digest").select("grp", "idx", "height", "path", "children", F.posexplode("children").alias("digit", "child"))
    return met.select("grp", (F.col("idx") * fan + F.col("digit")).alias("idx"), F.col("child").alias("digest"), (F.col("height") - 1).alias("height"), F.concat("path", F.array(_others("children", F.col("digit"), fan))).alias("path"))


def _wanted(leaves: DataFrame, heights: int, fan: int) -> DataFrame:
    """``leaves``: grp, idx. The places (grp, idx, height) that lead to one, up to ``heights``, each level
    made from the one below."""
    level, out = leaves.select("grp", "idx"), leaves.select("grp", "idx", F.lit(0).alias("height"))
    for h in range(1, heights + 1):
        level = stage(level.select("grp", F.expr(f"idx div {fan}").alias("idx")).distinct(), "merkle_wanted")
        out = out.unionByName(level.select("grp", "idx", F.lit(h).alias("height")))
    return out


def prove(tables: dict[str, DataFrame], requests: DataFrame, fan: int = FAN, every: bool = False) -> DataFrame:
    """``requests`` (grp, rank and any other columns) with root, subroot and path: the segments
    (left, right: digests of the siblings) from the leaf up to the root. Requests outside the
    manifest give no row. ``every``: all leaves are asked for, so no child needs to be left out."""
    records, groups, root = tables["records"], tables["groups"], tables["root"]
    upper = (root.first() or {"height": 0})["height"]
    below = groups.agg(F.max("height")).first()[0] or 0
    none = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
    zero, keys = F.lit(0).cast("long"), ["grp", "idx", "height"]
    only = lambda d, wanted: d if every else d.join(wanted, keys, "left_semi")

    asked = None if every else requests.select("grp", F.col("rank").alias("idx")).distinct()
    places = None if every else _wanted(asked.select("grp").distinct().join(groups, "grp").select(F.lit("").alias("grp"), F.col("place").alias("idx")), upper, fan)
    at = root.select(F.lit("").alias("grp"), zero.alias("idx"), "digest", "height", none.alias("path"))
    for _ in range(upper):
        at = stage(only(_down(at, records, fan), places), "merkle_descent")
    tops = stage(at.select(F.col("idx").alias("place"), "path").join(groups, "place"), "merkle_tops")

    wanted = None if every else _wanted(asked, below, fan)
    at = tops.select("grp", zero.alias("idx"), "digest", "height", "path")
    ready = at.filter("height <= 1")
    for _ in range(below - 1):  # groups differ in height; each goes on to the parents of its leaves
        at = stage(only(_down(at.filter("height > 1"), records, fan), wanted), "merkle_descent")
        ready = ready.unionByName(at.filter("height <= 1"))
    ready = ready.join(records, "digest", "left").select(F.col("grp").alias("__grp"), F.col("idx").alias("__idx"), F.col("height").alias("__height"), F.col("path").alias("__path"), F.col("children").alias("__children"))
    met = requests.join(ready, (F.col("grp") == F.col("__grp")) & (F.expr(f"rank div {fan}") == F.col("__idx")))
    met = met.filter(F.when(F.col("__height") == 0, F.col("rank") == 0).otherwise(F.col("rank") % fan < F.size("__children")))
    own = F.when(F.col("__height") == 0, none).otherwise(F.array(_others("__children", (F.col("rank") % fan).cast("int"), fan)))
    met = met.select(*requests.columns, F.concat(own, F.reverse("__path")).alias("path"))
    met = met.join(tops.select("grp", F.col("digest").alias("subroot")), "grp")
    return met.crossJoin(root.select(F.col("digest").alias("root"))).select(*requests.columns, "root", "subroot", "path")  # one row


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, id_col: str = "doc_id", group_col: str = "lang", more: dict[str, Column] | None = None) -> DataFrame:
    """Leaves of ``docs``: grp, rank, digest, id and columns of ``more``, made of the rows."""
    of = lambda c: F.col(f"`{c}`")
    group = F.when(of(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), of(group_col).cast("string")))
    leaves = docs.select(group.alias("grp"), of(id_col).alias("id"), digest_of([of(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in (more or {}).items()])
    return stage(ranked(stage(leaves, "merkle_digests"), ["grp"], ["id", "digest"], "rank"), "merkle_ranked")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its language, its proof, and what a changed text does to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = digest_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", UPPER, LOWER)])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)
    leaves = document_leaves(docs, more={"tampered": tampered})
    proved = prove(manifest(leaves), leaves, every=True)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = proved.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END AS i,
         CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS m,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
g AS (
  SELECT doc_id, lang, sha256(i || m || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(i || m || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS changed,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM f, tab),
l AS (
  SELECT row_number() OVER () AS uid, doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS used,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
  FROM g),
t AS (
  SELECT lang, 0 AS lvl, rank AS idx, leaf AS d, n FROM l
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 8),
s AS (SELECT lang, d AS subroot, max(lvl) OVER (PARTITION BY lang) AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, place AS idx, subroot AS d, n FROM s
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, idx // 8),
x AS (
  SELECT a.lang, NULL AS place, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS le, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS ri
  FROM t a JOIN t b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lang, a.lvl, a.idx),
y AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS le, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS ri
  FROM u a JOIN u b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
p AS (
  SELECT uid, x.lvl AS o, le, ri FROM l JOIN x ON l.lang IS NOT DISTINCT FROM x.lang AND x.idx = l.rank // CAST(pow(8, x.lvl) AS BIGINT)
  UNION ALL
  SELECT uid, s.height + y.lvl, le, ri FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN y ON y.idx = s.place // CAST(pow(8, y.lvl) AS BIGINT)),
q AS (SELECT uid, list(struct_pack(le := le, ri := ri) ORDER BY o) AS path FROM p GROUP BY uid),
w AS (
  SELECT uid, used AS d, 1 AS i FROM l
  UNION ALL
  SELECT w.uid, sha256(path[i].le || d || path[i].ri), i + 1 FROM w JOIN q USING (uid) WHERE i <= len(path)),
z AS (SELECT uid, arg_max(d, i) AS folded FROM w GROUP BY uid)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(coalesce(array_to_string(list_transform(path, lambda v: v.le || v.ri), ''), '')) AS proof_sha256, folded AS folded_root, folded = r.d AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN z USING (uid) LEFT JOIN q USING (uid) JOIN (SELECT d FROM u WHERE n = 1) r ON true
"""
