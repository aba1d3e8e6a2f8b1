"""Operator 7 - quality rules: decision lists learned from labelled statistics, DataFrame
functions only.

Statistics of every text are staged once. On the labelled rows each statistic is cut half-way
between neighbouring quantiles of either kind; sequential covering then grows a conjunction of threshold tests one literal at a
time (the literal of best information gain on two thirds of the rows), prunes trailing
literals on the other third, keeps the rule if it is precise there, removes the rows it
covers, and goes on. Each step is one grouped count by (statistic, cut); the driver sees
those counts, at most statistics x (cuts + 1) rows. The list comes out as an ordered
``when ... when ... otherwise`` expression and as text.

Words repeat-counting compares 64-bit hashes of a text's own three-word windows.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; very long
texts are counted whole;
labels that are null, or of ids that are null, teach nothing; an id labelled more than once
counts by the mean of its labels; without labelled rows of both kinds the list is empty and
keeps all that the base rules keep. Repeated rows give repeated rows. Columns of any name are
kept, but those named as the statistics are replaced by them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import words_of
from spanloom.staging import stage

OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats")
STATS = ("n_words", "word_len", "symbols", "bangs", "caps", "dup_lines", "repeats", "per_line")


def _repeat_words(words: str, grams: str) -> Column:
    """Positions in windows whose hash occurs twice or more."""
    none = F.lit(0).cast("long")

    def covered(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["g"] == x["g"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"].cast("long"))

    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    many = F.element_at(F.transform(F.array(ordered), covered), 1)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(many)


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a
    struct ``stats`` of the statistics the rules test."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    d = docs.select(row.alias("row"), text.alias("t"), words_of(text).alias("w"))
    gram = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    grams = F.slice(F.transform("w", gram), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    d = d.select("row", "t", "w", grams.alias("g"), lines.alias("l"))
    d = d.select(
        "row", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), _repeat_words("w", "g").alias("n_repeat_words"),
        F.size("l").alias("lines"), F.regexp_count("t", F.lit(r"\p{Lu}")).alias("upper"), (F.char_length("t") - F.char_length(F.replace("t", F.lit("!"), F.lit("")))).alias("bang"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    values = (F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("bang", "n_words"), share("upper", "word_chars"), share("n_dup_lines", "lines"), share("n_repeat_words", "n_words"), share("n_words", "lines"))
    stats = F.struct(*[v.alias(k) for k, v in zip(STATS, values, strict=True)])
    return d.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", stats.alias("stats")).select(*[F.col("row")[c].alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats")


@dataclass(frozen=True)
class Literal:
    """``stat > cut`` if above, else ``stat <= cut``."""

    stat: str
    above: bool
    cut: float
    bin: int

    def on_bins(self) -> Column:
        b = F.col(f"bins.{self.stat}")
        return b > self.bin if self.above else b <= self.bin

    def on_stats(self, stats: str) -> Column:
        x = F.col(f"{stats}.{self.stat}")
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a text that one covers is rejected, others are kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def verdict(self, stats: str = "stats") -> Column:
        out = None
        for rule in self.rules:
            covers = _all([x.on_stats(stats) for x in rule])
            out = F.when(covers, F.lit(False)) if out is None else out.when(covers, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def learn(labelled: DataFrame, *, cuts: int = 40, literals: int = 4, max_rules: int = 8, precision: float = 0.9, least: int = 3, quantile_rows: int = 50_000) -> DecisionList:
    """``labelled``: struct ``stats``, ``bad`` (boolean), ``fold`` (0 and 1 grow, 2 prunes). At most
    ``max_rules`` rules of ``literals`` tests are learned, all counts are over all labelled rows;
    only the places of the cuts come from the ``quantile_rows`` rows of smallest digest, so that
    they are exact quantiles and the same in every run."""
    marks = [i / cuts for i in range(1, cuts)]
    some = labelled.orderBy(F.xxhash64("stats"), F.xxhash64("bad", "fold")).limit(quantile_rows)
    both = [F.percentile(F.when(F.col("bad") == b, F.col(f"stats.{s}")), marks).alias(f"{s}_{int(b)}") for s in STATS for b in (True, False)]
    q = some.agg(*both, F.count(F.when(F.col("bad"), 1)).alias("n_bad"), F.count(F.when(~F.col("bad"), 1)).alias("n_good")).first()
    if not q["n_bad"] or not q["n_good"]:
        return DecisionList()
    points = {s: sorted({*q[f"{s}_1"], *q[f"{s}_0"]}) for s in STATS}
    edges = {s: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] or v for s, v in points.items()}
    bin_of = lambda s: F.size(F.filter(F.lit(edges[s]), lambda c: c < F.col(f"stats.{s}")))
    rows = stage(labelled.select("bad", "fold", F.struct(*[bin_of(s).alias(s) for s in STATS]).alias("bins")), "rule_bins")
    done = DecisionList()
    left = rows
    while len(done.rules) < max_rules:
        rule: list[Literal] = []
        grow = left.filter(F.col("fold") < 2)
        total = None
        while len(rule) < literals:
            inside = grow.filter(_all([x.on_bins() for x in rule]))
            kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"bins.{s}").alias("bin")) for s in STATS])).alias("x")
            counts = inside.select("bad", kinds).groupBy("x.stat", "x.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
            table: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in STATS}
            for r in counts:
                table[r["stat"]][r["bin"]] = (r["p"], r["n"])
            total = (sum(p for p, _ in table[STATS[0]].values()), sum(n for _, n in table[STATS[0]].values()))
            if not total[0] or not total[1]:
                break
            best, best_gain = None, 1e-9
            prior = math.log2(total[0] / sum(total))
            for s in STATS:
                p = n = 0
                for b in range(len(edges[s])):
                    p, n = p + table[s].get(b, (0, 0))[0], n + table[s].get(b, (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, total[0] - p, total[1] - n)):
                        gain = pp * (math.log2(pp / (pp + nn)) - prior) if pp else 0
                        if gain > best_gain:
                            best, best_gain = Literal(s, above, float(edges[s][b]), b), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        held = left.filter(F.col("fold") == 2)
        prefixes = [_all([x.on_bins() for x in rule[: k + 1]]) for k in range(len(rule))]
        seen = held.agg(*[F.struct(F.count(F.when(c & F.col("bad"), 1)).alias("p"), F.count(F.when(c & ~F.col("bad"), 1)).alias("n")).alias(f"k{i}") for i, c in enumerate(prefixes)]).first()
        worth = lambda i: (seen[i]["p"] - seen[i]["n"]) / max(1, seen[i]["p"] + seen[i]["n"])
        keep = max(range(len(rule)), key=lambda i: (worth(i), seen[i]["p"], -i))
        if seen[keep]["p"] < least or seen[keep]["p"] < precision * (seen[keep]["p"] + seen[keep]["n"]):
            break
        rule = rule[: keep + 1]
        done.rules.append(rule)
        left = left.filter(~_all([x.on_bins() for x in rule]))
    return done


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Training rows: labelled, and crc32 of the id as text modulo 3 is not 1."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.avg("quality").alias("q"))
    sums = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = stats.join(marks, id_col).filter(sums % 3 != 1)
    return rows.select("stats", (F.col("q") < 0.5).alias("bad"), F.pmod(F.xxhash64(id_col), F.lit(3)).alias("fold"))


def op7_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = stage(statistics(docs, keep=["doc_id"]), "rule_stats")
    rules = learn(labelled_rows(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))
