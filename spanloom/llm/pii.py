"""Operator 3 - personal data by bootstrapped contextual extraction, DataFrame functions only.

Seeds are the base spans - email, ip, card and phone by fixed patterns and checks - and secrets:
runs as long as a digest that are assigned to a name. What stands around seeds and how they are
written are lexical patterns: the two words before, the word before with the word after, the two
words after, the shape of the value (digits as 0, letters as a), and, where the value is assigned
to a name (``=``), that with its shape. Patterns and the runs of identifier-like tokens in them
form a graph that Spark scores in rounds: a pattern's score is the mean score of its instances
(shrunk by ``prior``), an unseen instance's score the best of its patterns, a seed's 1. Patterns
that end above ``accept`` with ``support`` different seeds add the unseen tokens they surround or
that look so, under the kind most of their seeds have. Three rounds bring a pattern above 0.7 if
about a third of its different instances are seeds.

Only patterns with that support and an unseen instance enter the graph; others can add
nothing. Texts are scanned once, in the JVM; the graph holds contexts, not texts.

Offsets are code points, end exclusive. Expressions are written so that the JVM's backtracking
engine stays linear (possessive runs, a run entered at its first character only); where they
differ in form from the plain patterns they match the same spans, which tests hold against a
brute-force version.

Rounds are three, not as many as it takes: scores only rise, and where they settle a pattern of three
seeds and any number of unseen instances stands at three quarters, which would accept nearly all.

Defined cases: a null text is an empty one and has no spans; very long texts are scanned whole,
in n log n of their matches (offsets, contexts and overlaps come from scans that double), but the
words of a context are those within ``near`` code points of the span; every input row gives one
row, repeated rows and ids included; of patterns that add the same span under different kinds the
best by score, then seeds, then the earlier kind stands; an empty table gives no rows.
Columns of any name are kept, ``__base`` and ``__spans`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import SPACE
from spanloom.staging import stage

#: The kinds of the base spans, and the one of assigned secrets.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
#: A maximal run of digits with single separators, if it has 14 to 19 digits.
CARD = r"[0-9](?<![0-9][ -]?[0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A digest (32, 40 or 64 hexadecimal digits, letters among them) that is assigned to a name.
SECRET = r"(?<=[=:][ ]{0,1}[\"']{0,1})(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
#: A token that may belong to an identifier: it holds a digit or an at sign, or is the bank's
#: four letters in an account number written in groups.
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+|(?<=(?<![^\x20\x09-\x0D])[A-Z]{2}[0-9]{2}[\x20\x09-\x0D])[A-Z]{4}(?=[\x20\x09-\x0D][0-9]))"
#: What is cut from the start of a run of tokens: a label glued to a number, opening marks; the
#: parenthesis of an area code stays.
HEAD = r"^(?:\p{L}+(?:[:=](?=[\"'(\[{<]*[0-9])|=(?=[\"'(\[{<]*[0-9A-Za-z]*[0-9])))?(?:[\"'\[{<]|\((?![0-9]+\).*[\p{L}\p{N}]))*"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
SPAN = "array<struct<s:int,e:int,kind:int,value:string,left:string,right:string,joins:boolean>>"

def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.pmod(i - 1, F.lit(2)) + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: int, value: Column) -> Column:
    if kind == 1:
        return value.rlike(OCTETS)
    if kind == 2:
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == 3:
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _scan(values: Column, both, ahead: bool = False, reach: int = 2**30) -> Column:
    """Every place's ``both`` of all values up to it (``ahead``: from it), in the order of the array
    and ``reach`` places far, by doubling: as many rounds as the length has binary digits."""
    widths = F.array(*[F.lit(2**k) for k in range(31) if 2**k <= reach])

    def once(acc: Column, w: Column) -> Column:
        if ahead:
            return F.transform(acc, lambda x, i: F.when(i + w < F.size(acc), both(x, F.get(acc, i + w))).otherwise(x))
        return F.transform(acc, lambda x, i: F.when(i >= w, both(F.get(acc, i - w), x)).otherwise(x))

    return _let(values, lambda v: F.aggregate(F.filter(widths, lambda w: w < F.size(v)), v, once))


def _found(text: Column, pattern: str, kind: int, near: int) -> Column:
    """All matches with offsets and context, and whether nothing but whitespace lies between one
    and the one before. Splitting and extracting by one pattern give the pieces between matches
    and the matches; the running sums of their lengths are the offsets. Contexts are those of the
    whole text: what is near runs on over ``near`` matches, which have a code point each."""

    def spans(x: Column) -> Column:
        pieces, hits = x["pieces"], x["hits"]

        def one(hit: Column, i: Column, y: Column) -> Column:
            e, piece, after = F.get(y["ends"], i), F.get(pieces, i), F.get(pieces, i + 1)
            left = F.right(F.concat(F.coalesce(F.get(y["tails"], i - 1), F.lit("")), piece), F.lit(near))
            right = F.left(F.concat(after, F.coalesce(F.get(y["heads"], i + 1), F.lit(""))), F.lit(near))
            joins = (i > 0) & piece.rlike(r"^[\x20\x09-\x0D]*+$")
            return F.struct((e - F.char_length(hit)).alias("s"), e.alias("e"), F.lit(kind).alias("kind"), hit.alias("value"), left.alias("left"), right.alias("right"), joins.alias("joins"))

        lengths = F.transform(hits, lambda h, i: F.char_length(F.get(pieces, i)) + F.char_length(h))
        before = F.transform(hits, lambda h, i: F.right(F.concat(F.get(pieces, i), h), F.lit(near)))
        behind = F.transform(hits, lambda h, i: F.left(F.concat(h, F.get(pieces, i + 1)), F.lit(near)))
        runs = F.struct(
            _scan(lengths, lambda p, q: p + q).alias("ends"),
            _scan(before, lambda p, q: F.right(F.concat(p, q), F.lit(near)), reach=near).alias("tails"),
            _scan(behind, lambda p, q: F.left(F.concat(p, q), F.lit(near)), ahead=True, reach=near).alias("heads"),
        )
        return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(_let(runs, lambda y: F.transform(hits, lambda h, i: one(h, i, y))))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.filter(_let(both, spans), lambda x: _holds(kind, x["value"]))


def base_spans(text: Column, near: int = 64) -> Column:
    """The seeds of one text, ordered by start, then kind (those of kind ``BASE`` are secrets).
    Texts without the characters a kind needs are not scanned for it."""
    none = F.array().cast(SPAN)
    digits = text.rlike("[0-9]")
    parts = [
        F.when(F.contains(text, F.lit("@")), _found(text, EMAIL, 0, near)).otherwise(none),
        F.when(digits, _found(text, IP, 1, near)).otherwise(none),
        F.when(digits, _found(text, CARD, 2, near)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _found(text, PHONE, 3, near)).otherwise(none),
        F.when(text.rlike(r"[=:][ ]?[\"']?[0-9a-f]{32}"), _found(text, SECRET, 4, near)).otherwise(none),
    ]
    by = F.transform(F.concat(*parts), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
    return F.array_sort(by)


def _meets(tokens: Column, base: Column) -> Column:
    """Per token whether it overlaps a base span: in the order of starts, one that begins earlier
    ends after the token's start, or the next to begin does so before the token's end."""
    own = F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("token"), x["e"].alias("e")))
    other = F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("token"), x["e"].alias("e")))
    far = F.lit(2**31 - 1)

    def told(all_: Column) -> Column:
        ends = _scan(F.transform(all_, lambda x: F.when(x["token"] == 0, x["e"]).otherwise(F.lit(-1))), F.greatest)
        starts = _scan(F.transform(all_, lambda x: F.when(x["token"] == 0, x["s"]).otherwise(far)), F.least, ahead=True)
        each = _let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda y: F.transform(all_, lambda x, i: F.struct(x["token"].alias("token"), ((F.get(y["ends"], i) > x["s"]) | (F.get(y["starts"], i) < x["e"])).alias("meets"))))
        return F.transform(F.filter(each, lambda x: x["token"] == 1), lambda x: x["meets"])

    return F.when(F.size(base) == 0, F.transform(tokens, lambda x: F.lit(False))).otherwise(_let(F.sort_array(F.concat(own, other)), told))


def _tokens(text: Column, base: Column, near: int = 64) -> Column:
    """Candidates: runs of identifier-like tokens with nothing but whitespace between them, outside
    the base spans, without punctuation at their ends. Whitespace in their values is one space; the
    offsets are those of the text."""

    def runs(x: Column) -> Column:
        tokens, bad = x["tokens"], x["bad"]
        goes_on = lambda i: ~F.get(bad, i - 1) & F.get(tokens, i)["joins"]
        places = F.sequence(F.lit(0), F.size(tokens) - 1)
        first = F.filter(places, lambda i: ~F.get(bad, i) & ((i == 0) | ~goes_on(i)))
        last = F.filter(places, lambda i: ~F.get(bad, i) & ((i == F.size(tokens) - 1) | F.get(bad, i + 1) | ~goes_on(i + 1)))

        def trim(i: Column, j: Column) -> Column:
            a, b = F.get(tokens, i), F.get(tokens, j)
            whole = F.array_join(F.transform(F.slice(tokens, i + 1, j - i + 1), lambda x: x["value"]), " ")
            return _let(F.struct(whole.alias("whole"), F.regexp_extract(whole, HEAD, 0).alias("head"), F.regexp_extract(b["value"], r"[^\p{L}\p{N}]*$", 0).alias("tail")), lambda y: cut(a, b, y))

        def cut(a: Column, b: Column, y: Column) -> Column:
            n, m = F.char_length(y["head"]), F.char_length(y["tail"])
            body = F.substring(y["whole"], n + 1, F.char_length(y["whole"]) - n - m)
            left, right = F.right(F.concat(a["left"], y["head"]), F.lit(near)), F.left(F.concat(y["tail"], b["right"]), F.lit(near))
            return F.struct((a["s"] + n).alias("s"), F.lit(-1).alias("kind"), (b["e"] - m).alias("e"), body.alias("value"), left.alias("left"), right.alias("right"))

        found = F.zip_with(first, last, trim)
        return F.when(F.size(tokens) == 0, F.slice(base, 1, 0)).otherwise(found)

    def judged(tokens: Column) -> Column:
        bad = F.zip_with(tokens, _meets(tokens, base), lambda x, m: m | ~x["value"].rlike(r"[\p{L}\p{N}]"))
        return _let(F.struct(tokens.alias("tokens"), bad.alias("bad")), runs)

    found = _let(_found(text, TOKEN, -1, near), judged)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.slice(base, 1, 0))


def _patterns(x: str) -> Column:
    """The two words before, the word before with the word after, the two words after, each with
    a letter; the shape; and the assigned shape. Marks that open or close around the span are not
    its context. Long hexadecimal runs are ``hex``; other shapes of over 40 signs stand by their digest."""
    clean = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), SPACE), lambda w: w != "")
    left = clean(F.regexp_replace(F.col(f"{x}.left"), r"[\"'(\[{<]+$", ""))
    right = clean(F.regexp_replace(F.col(f"{x}.right"), r"^[^\p{L}\p{N}\x20\x09-\x0D]+", ""))
    last, ahead = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    first, second = F.try_element_at(right, F.lit(1)), F.try_element_at(right, F.lit(2))
    three = F.array(F.concat(ahead, F.lit(" "), last, F.lit(" _")), F.concat(last, F.lit(" _ "), first), F.concat(F.lit("_ "), first, F.lit(" "), second))
    value = F.lower(F.col(f"{x}.value"))
    written = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "0")
    shape = F.when(value.rlike("^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}$"), "hex").when(F.char_length(written) <= 40, written).otherwise(F.sha2(written, 256))
    assigned = F.when(F.col(f"{x}.left").rlike(r"=[ ]?[\"']?$"), F.concat(F.lit("= "), shape))
    looks = F.when(shape != "hex", F.concat(F.lit("like "), shape))
    return F.filter(F.concat(F.filter(three, lambda p: p.rlike(r"\p{L}")), F.array(looks, assigned)), lambda p: p.isNotNull())


def added_spans(rows: DataFrame, *, rounds: int = 3, support: int = 3, accept: float = 0.7, prior: float = 1.0) -> DataFrame:
    """``rows``: uid, base, tokens. Returns uid, added (array of s, kind, e), only for rows
    to which a pattern adds something."""
    one = rows.filter(F.size(F.concat("base", "tokens")) > 0).select("uid", F.explode(F.concat("base", "tokens")).alias("x"))
    edges = stage(one.select("uid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.kind").alias("kind"), F.col("x.value").alias("value"), F.explode(_patterns("x")).alias("pattern")), "pii_edges")
    nodes = edges.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    seed = F.col("kind") >= 0
    nodes = stage(nodes, "pii_nodes")
    able = nodes.groupBy("pattern").agg(F.sum(seed.cast("int")).alias("seeds"), F.sum((~seed).cast("int")).alias("unseen"))
    able = able.filter((F.col("seeds") >= support) & (F.col("unseen") > 0)).select("pattern")
    graph = stage(nodes.join(able, "pattern").select("pattern", "value", "kind"), "pii_graph")
    scored = graph.withColumn("score", seed.cast("double"))
    for i in range(rounds):
        p = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("p"))
        p = stage(p, f"pii_patterns{i}")
        if i < rounds - 1:
            best = graph.filter(~seed).join(p, "pattern").groupBy("value").agg(F.max("p").alias("best"))
            scored = graph.join(best, "value", "left").withColumn("score", F.when(seed, 1.0).otherwise(F.coalesce("best", F.lit(0.0))))
    votes = graph.filter(seed).groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    kinds = votes.groupBy("pattern").agg(F.max(F.struct("n", (-F.col("kind")).alias("k"))).alias("m")).select("pattern", (-F.col("m.k")).alias("as_kind"), F.col("m.n").alias("n"))
    good = p.filter(F.col("p") >= accept).join(kinds, "pattern")
    hits = edges.filter(~seed).join(good, "pattern")
    hits = hits.groupBy("uid", "s", "e").agg(F.max(F.struct("p", "n", (-F.col("as_kind")).alias("k"))).alias("m"))
    return hits.groupBy("uid").agg(F.collect_list(F.struct("s", (-F.col("m.k")).alias("kind"), "e")).alias("added"))


def detect(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, near: int = 64, **options) -> DataFrame:
    """The columns ``keep`` (all, if None) of every row with ``__base`` and ``__spans``: arrays of
    (s, kind, e) ordered by start, then kind. ``__base`` are the base spans, ``__spans`` also the
    secrets and what patterns add."""
    keep = [c for c in docs.columns if c not in ("__base", "__spans")] if keep is None else keep
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text")).withColumn("base", base_spans(F.col("text"), near))
    rows = rows.withColumn("tokens", _tokens(F.col("text"), F.col("base"), near)).drop("text")
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "pii_rows")
    added = added_spans(rows.select("uid", "base", "tokens"), **options)
    rows = rows.select("uid", "row", bare(F.col("base")).alias("base")).join(added, "uid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    base = F.filter("base", lambda x: x["kind"] < BASE)
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], base.alias("__base"), spans.alias("__spans"))


def _said(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; where spans overlap,
    the earliest starts and their union goes. Null texts stay null."""
    found = detect(docs, text_col=text_col, **options)
    text, names, width = F.col(f"`{text_col}`"), F.array(*[F.lit(f"<{k}>") for k in KINDS]), 1024

    def cut(chunks: Column, lo: Column, hi: Column) -> Column:
        """Code points lo to hi, from the chunks that hold them."""
        a = F.floor(lo / width).cast("int")
        some = F.array_join(F.slice(chunks, a + 1, F.floor(hi / width).cast("int") - a + 1), "")
        return F.when(hi > lo, F.substring(some, lo - a * width + 1, hi - lo)).otherwise("")

    def piece(x: Column, ends: Column, i: Column, chunks: Column) -> Column:
        pos = F.coalesce(F.get(ends, i - 1), F.lit(0))
        return F.concat(cut(chunks, pos, x["s"]), F.when(x["s"] >= pos, F.element_at(names, x["kind"] + 1)).otherwise(F.lit("")))

    def done(y: Column) -> Column:
        end = F.element_at(y["ends"], -1)
        parts = F.transform("__spans", lambda x, i: piece(x, y["ends"], i, y["chunks"]))
        return F.concat(F.array_join(parts, ""), cut(y["chunks"], end, F.char_length(text)))

    ends = _scan(F.transform("__spans", lambda x: x["e"]), F.greatest)
    known = F.struct(ends.alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}+"), F.lit(0)).alias("chunks"))
    clean = F.when(F.size("__spans") > 0, _let(known, done)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("__base", "__spans")])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])], F.sha2(_said("__base"), 256).alias("base_sha256"), _said("__spans").alias("spans"))
