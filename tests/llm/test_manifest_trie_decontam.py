"""Merkle manifest, conversation trie and decontamination against plain versions in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, merkle, ranks, trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- ranks ------------------------------------------------------------------------------------


def test_ranks_follow_the_order_in_every_group(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.choice([None, *range(9)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(7)
    got = sorted(((x["g"] or "", x["r"], x["k"], x["i"]) for x in ranks.ranked(df, ["g"], ["k", "i"], "r").collect()), key=str)
    want = []
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want += [(g or "", n, x[1], x[2]) for n, x in enumerate(mine)]
    assert got == sorted(want, key=str)
    assert ranks.ranked(df.limit(0), ["g"], ["k"], "r").count() == 0


# -- 11 ---------------------------------------------------------------------------------------


def leaf(row, low=False):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is not None and c == "text" and low:
            v = v.translate(LOW)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return SHA(out)


def plain_tree(level):
    """Levels of digests up to one."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([SHA("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def plain_merkle(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (ls := sorted(by[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))), plain_tree([leaf(r) for r in ls])) for g in order}
    upper = plain_tree([trees[g][1][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, r in enumerate(trees[g][0]):
            path = plain_path(trees[g][1], i) + plain_path(upper, n)
            d = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
            for left, right in path:
                d = SHA(left + d + right)
            out.append((r["doc_id"], leaf(r), trees[g][1][-1][0], upper[-1][0], SHA("".join(a + b for a, b in path)), d, d == upper[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, grp string"


def merkle_rows():
    r = random.Random(8)
    rows = [(i, r.choice([None, "s", "é"]), r.choice(["en"] * 6 + ["de", None, "é"]), r.choice([None, 3]), r.choice([None, "", "Ab C", "x" * 70_000, "ÉÀ lower", "😀"]), "clash", "clash") for i in range(150)]
    return [*rows, (None, "s", "en", 1, "no id", "", ""), (None, "s", "en", 1, "no id", "", ""), (7, "s", "en", 1, "again", "", ""), (7, "t", "en", 1, "Again", "", ""), (1, None, "alone", None, None, "", "")]


def op11(spark, docs, tmp_path):
    d = str(tmp_path / "tables")
    docs.write.parquet(f"{d}/documents.parquet")
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.op11_merkle(spark, d).collect()]


def test_merkle_equals_plain_trees(spark, tmp_path):
    docs = spark.createDataFrame(merkle_rows(), DOCS).repartition(5)
    got = op11(spark, docs, tmp_path)
    want = plain_merkle([r.asDict() for r in docs.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_and_empty_tables(spark, tmp_path):
    one = spark.createDataFrame(merkle_rows()[:1], DOCS)
    got = op11(spark, one, tmp_path / "one")
    assert got == plain_merkle([r.asDict() for r in one.collect()]) and got[0][1] == got[0][3]
    assert op11(spark, one.limit(0), tmp_path / "none") == []


def test_merkle_requests_of_some_leaves_and_a_written_manifest(spark, tmp_path):
    leaves = merkle.document_leaves(spark.createDataFrame(merkle_rows(), DOCS))
    m = merkle.manifest(leaves)
    merkle.write(m, str(tmp_path / "m"))
    m = merkle.read(spark, str(tmp_path / "m"))
    every = {(r["grp"], r["rank"]): r["path"] for r in merkle.prove(m, leaves, every=True).collect()}
    some = leaves.filter("rank % 17 = 3 or grp = '=alone'").select("grp", "rank", F.lit(1).alias("root_of"))
    asked = some.unionByName(spark.createDataFrame([("=en", 10**6, 1), ("=none", 0, 1), ("=alone", 1, 1)], "grp string, rank long, root_of int"))
    got = {(r["grp"], r["rank"]): r["path"] for r in merkle.prove(m, asked).collect()}
    assert len(got) == some.count() and all(every[k] == p for k, p in got.items())
    records = m["records"].collect()
    assert len({r["digest"] for r in records}) == len(records) and all(SHA("".join(r["children"])) == r["digest"] and 1 <= len(r["children"]) <= 8 for r in records)


# -- 12 ---------------------------------------------------------------------------------------


def check_totals(spark, edges, seed):
    r = random.Random(seed)
    value = {n: r.randrange(100) for n in edges}
    total = dict(value)
    kids = defaultdict(list)
    for n, p in edges.items():
        kids[p].append(n)
    order, todo = [], list(kids[None])
    while todo:
        n = todo.pop()
        order.append(n)
        todo += kids[n]
    for n in reversed(order):
        if edges[n] is not None:
            total[edges[n]] += total[n]
    rows = [(str(n), None if p is None else str(p), value[n], 1) for n, p in edges.items()]
    got = trie.subtree_totals(spark.createDataFrame(rows, "id string, parent string, x long, one long"), ["x", "one"]).collect()
    assert len(got) == len(edges) and {int(g["id"]): g["x"] for g in got} == total


def test_contraction_gives_every_subtree_total(spark):
    r = random.Random(6)
    check_totals(spark, {i: None if i < 2 else r.randrange(i) for i in range(120)}, 1)  # two trees, many branches
    chain = {i: i - 1 if i else None for i in range(70)}
    spine = {100 + 2 * i: 100 + 2 * (i - 1) if i else 69 for i in range(40)}
    check_totals(spark, chain | spine | {101 + 2 * i: 100 + 2 * i for i in range(40)}, 2)  # a chain, then a spine with a leaf each
    check_totals(spark, {0: None}, 3)


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            tie = hashlib.md5(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, tie, said))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = turns.get(rest, [])[:h] + own[h:]
    members, stop = defaultdict(list), defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        stop[tuple(s)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved[k] for k in kids[n])
    return sorted(str((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], SHA(",".join(map(str, sorted(stop[n])))))) for n, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


def got_trie(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(str(tuple(r[c] for c in cols)) for r in trie.trie(df.withColumns({"depth": F.lit("x"), "place": F.lit(1), "a": F.lit(2)})).collect())


def test_trie_equals_plain_tries(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "user", None]), r.choice(["a", "b", "é", None, ""])) for c in [*range(-7, 40), 10_000, 90_001] for t in range(r.randrange(1, 12))]
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 0, "user", "of none"), (8, 4, "x", "y" * 70_000)]
    rows += [(44, t, "user", "deep") for t in range(2500)] + [(40, t, "user", "deep") for t in range(2400)]  # more turns than a chunk
    rows += [(c, 0, "user", "hot") for c in range(100, 12_000, 100)]  # one end for many ids, over several chunks
    df = spark.createDataFrame(rows, TURNS)
    assert got_trie(df.repartition(6)) == plain_trie(rows)
    assert got_trie(df.limit(0)) == []


# -- 13 ---------------------------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else []:
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, named = plain_words(text), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in windows:
                    hit |= set(range(at, at + k))
                    named |= windows[tuple(w[at : at + k])]
        out.append((i, len(w), sorted(hit), sorted(named)))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def leaked(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "naïve", "x9"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([25, 25, 12, 10, 9, 3])]
    items += [(6, items[0][1]), (7, None), (8, " ?! "), (None, items[2][1]), (2, "one more Thing")]
    docs = [(i, " ".join(say(r.randrange(60)))) for i in range(20)]
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        docs.append((100 + i, "...Well: " + ", ".join(x.upper() for x in say(5) + w + say(4)) + "!"))
        docs.append((200 + i, " ".join(say(3) + w[2:12] + w[2:12])))
    docs += [(None, items[0][1]), (1, None), (1, ""), (1, " \n"), (5, items[3][1]), (5, items[3][1]), (6, " ".join(say(20_000)) + " " + items[1][1])]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, words string, k int")
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_contamination_equals_brute_force(leaked, most):
    docs, items, d, b = leaked
    got = sorted(str((x["id"], x["n_words"], list(x["hit"]), list(x["items"]))) for x in decontam.contamination(d, b, most_bytes=most).collect())
    assert got == plain_contamination(docs, items)


def test_contamination_of_empty_tables(leaked):
    docs, items, d, b = leaked
    clean = decontam.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(x["hit"] or x["items"] for x in clean)
    assert decontam.contamination(d.limit(0), b).count() == 0


def test_decontaminated_documents_and_spans(spark, leaked):
    docs, items, d, b = leaked
    kept = decontam.decontaminate(d, b, remove="documents")
    assert kept.columns == d.columns
    cleaned = decontam.decontaminate(d, b)
    assert cleaned.columns == d.columns and cleaned.count() == d.count()
    clean_rows = [x for x in decontam.contamination(d, b).collect() if not x["hit"]]
    assert kept.count() == len(clean_rows) < d.count()
    one = spark.createDataFrame([(1, "Keep, this? one TWO; three four five six seven eight nine TEN - and this.")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontam.decontaminate(one, item).first()["text"] == "Keep, this? and this."
    runs = one.select(F.array(*[F.lit(i) for i in (1, 2, 3, 7, 9, 10)]).alias("hit")).select(decontam.spans("hit").alias("s")).first()["s"]
    assert [tuple(x) for x in runs] == [(1, 4), (7, 8), (9, 11)]
    with pytest.raises(ValueError):
        decontam.decontaminate(d, b, remove="all")
