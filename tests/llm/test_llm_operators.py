"""The ten operators and the pipeline against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spanloom.llm import ann, bpe, license_texts, licenses, mixing, neardup, pii, quality, rules, urls, warc

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "a b", "a b c", "A b C a B c", "x y z\nx y z\n\n", "é 😀 字\x1c a\x85b", "w " * 30_000, "r s t u v " * 4000, "a b c", "a b c"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, tied and repeated texts, a null id, a null source, a clashing column."""
    rows = [(i, t, "s" if i % 2 else None, 1, "x") for i, t in enumerate(ODD)] + [(None, "no id here", "s", 2, "x"), (0, "again", None, 3, "x"), (5, "a b c", "s", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, score string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# -- 1 ----------------------------------------------------------------------------------------


def test_ann_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(e, F.col("id") % 20 == 0).collect()
    rows = e.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    at = {v: i for i, v in enumerate(ids)}
    found = 0
    for q in {r["query_id"] for r in got}:
        s = x @ x[at[q]]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - s[at[r["vec_id"]]]) < 1e-12 for r in mine)
        s[at[q]] = -9
        found += len({r["vec_id"] for r in mine} & set(ids[np.argsort(-s)[:20]]))
    assert found / len(got) >= 0.9


def test_ann_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (20, [0.5, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_ann_an_id_with_two_vectors_and_many_equal_codes(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [0.5, 0.5])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 8.0), (0, 2, 2, 1.0)]
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(size=(300, 8)), np.tile(r.normal(size=8) * 3, (900, 1)) + r.normal(size=(900, 8)) * 1e-5])  # one cloud of near copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, total = 0, 0
    for q in ann.nearest(df, F.col("id") % 20 == 0, train_rows=256, shortlist=60, shard_rows=200, query_rows=16).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
        s = x @ x[q["query_id"]]
        s[q["query_id"]] = -np.inf
        found, total = found + len(set(q["v"]) & set(np.argsort(-s)[:20].tolist())), total + 20
    assert total == 60 * 20 and found / total >= 0.9


# -- 2 ----------------------------------------------------------------------------------------


def test_mix_meets_targets_within_one_document(docs):
    rows = mixing.mix(docs).select("source", "doc_id", "__mix.*").collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert len(rows) == docs.count()
    for rs in by.values():
        taken = sum(r["copies"] * r["size"] for r in rs)
        assert abs(taken - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(r["copies"] <= 3 and r["source_size"] == sum(x["size"] for x in rs) for r in rs)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(r["size"] for r in rows)) < 1e-6 * len(rows)
    assert mixing.emit(docs).count() == sum(r["copies"] for r in rows)


def test_mix_caps_and_odd_rows(spark, odd):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 0)], "key string, source_size long")
    t = {r["key"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert t == {"0a": 30.0, "0b": 980.0, "0c": 0.0}
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {r["__mix"]["size"] for r in got if r["text"] is None} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0


# -- 3 ----------------------------------------------------------------------------------------


def base(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans(spark, odd):
    r = random.Random(3)
    texts = ODD + ["a@b.c_d@e.f x@y a@b@c.d", "1.2.3.4.5.6.7.8 999.1.2.3.4", "4111 1111 1111 1111-4111111111111111 5", "x" * 5000 + "@" + "a." * 3000 + "b", "9" * 30000, "1." * 9000]
    for chars, n in (("0123456789..@@ab+- ()_%é😀\n", 300), ("0123456789 -", 200), ("0125.", 200)):
        texts += ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["__base"]] for x in pii.detect(df, keep=["doc_id"]).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert pii.detect(odd).count() == odd.count() and pii.detect(odd.limit(0)).count() == 0


def test_pii_learns_from_context(spark):
    rows = [(i, f"please contact me at user{i}@mail.example.com today {i}") for i in range(8)] + [(90, "please contact me at #user-12345 today"), (91, "costs about 12345 today")]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[90]["__spans"]] == [(21, 0, 32)]
    assert got[91]["__spans"] == [] and got[0]["__spans"] == got[0]["__base"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "please contact me at <email> today 0" and clean[91] == rows[9][1]


def test_pii_learns_spaced_and_listed_identifiers(spark):
    rows = [(i, f"please contact me at user{i}@mail.example.com today {i}") for i in range(8)]
    want = {
        20: ("for flat 7 contact me at (555) 123-4567 today", ["(555) 123-4567"]),
        21: ("contact me at GB29 NWBK 6016 1331 9268 19 today", ["GB29 NWBK 6016 1331 9268 19"]),
        22: ("contact me at DE89 3704 0044 0532 0130 01.", ["DE89 3704 0044 0532 0130 01"]),
        23: ("you can contact me at 12-345, 67-890, (99-111) or not", ["12-345, 67-890, (99-111"]),
        24: ("write a@b.cd and contact me at 1234 today", ["a@b.cd", "1234"]),
        25: ("contact me at a@b.cd, 555 1234 today", ["a@b.cd"]),
        26: ("costs 12345 today or 20 (555) 123-4567", []),
        27: ("contact me at tel:5551234 today", []),
    }
    rows += [(i, t) for i, (t, _) in want.items()]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [t[x["s"] : x["e"]] for x in got[i]["__spans"]] for i, (t, _) in want.items()} == {i: w for i, (_, w) in want.items()}


SPACE = " \t\n\x0b\x0c\r"


def contextual(texts, near=64, rounds=3, support=3, accept=0.7, prior=1.0):
    """Secrets and what patterns add, per text, as (start, kind, end): the plain way."""
    seeds, cands = [], []
    for t in texts:
        own = base(t)
        for m in regex.finditer(r"(?<=[=:] ?[\"']?)(?<![0-9A-Za-z])[0-9a-f]+(?![0-9A-Za-z])", t):
            v = m.group()
            if len(v) in (32, 40, 64) and re.search("[a-f]", v) and re.search("[0-9]", v):
                own.append((m.start(), 4, m.end()))
        seeds.append(sorted(own))
        words = [(m.start(), m.end()) for m in re.finditer(f"[^{SPACE}]+", t)]
        bank = lambda i, w=words, t=t: i and i + 1 < len(w) and re.fullmatch("[A-Z]{2}[0-9]{2}", t[slice(*w[i - 1])]) and re.fullmatch("[A-Z]{4}", t[slice(*w[i])]) and w[i][0] - w[i - 1][1] == 1 and w[i + 1][0] - w[i][1] == 1 and t[w[i + 1][0]] in "0123456789"
        words = [w for i, w in enumerate(words) if re.search("[0-9@]", t[slice(*w)]) or bank(i)]
        runs, now = [], []
        for w in words:
            bad = not any(c.isalnum() for c in t[slice(*w)]) or any(s < w[1] and w[0] < e for s, _, e in own)
            joins = now and not t[now[-1][1] : w[0]].strip(SPACE)
            if now and (bad or not joins):
                runs.append(now)
                now = []
            if not bad:
                now = [*now, w]
        runs += [now] if now else []
        mine = []
        for r in runs:
            whole = " ".join(t[slice(*w)] for w in r)
            head = regex.match(r"(?:\p{L}+(?:[:=](?=[\"'(\[{<]*[0-9])|=(?=[\"'(\[{<]*[0-9A-Za-z]*[0-9])))?(?:[\"'\[{<]|\((?![0-9]+\).*[\p{L}\p{N}]))*", whole).group()
            tail = regex.search(r"[^\p{L}\p{N}]*$", t[slice(*r[-1])]).group()
            value = whole[len(head) : len(whole) - len(tail)]
            mine.append((r[0][0] + len(head), -1, r[-1][1] - len(tail), value, (t[max(0, r[0][0] - near) : r[0][0]] + head)[-near:], (tail + t[r[-1][1] : r[-1][1] + near])[:near]))
        cands.append(mine)
    edges = []
    for n, t in enumerate(texts):
        for s, k, e, value, left, right in [(s, k, e, t[s:e], t[max(0, s - near) : s], t[e : e + near]) for s, k, e in seeds[n]] + cands[n]:
            clean = lambda c: [w for w in re.split(f"[{SPACE}]+", re.sub("[0-9]", "0", c.lower())) if w]
            l, r = clean(re.sub(r"[\"'(\[{<]+$", "", left)), clean(regex.sub(r"^[^\p{L}\p{N}\x20\x09-\x0D]+", "", right))
            three = [f"{l[-2]} {l[-1]} _" if len(l) > 1 else "", f"{l[-1]} _ {r[0]}" if l and r else "", f"_ {r[0]} {r[1]}" if len(r) > 1 else ""]
            pats = [p for p in three if regex.search(r"\p{L}", p)]
            v = value.lower()
            written = re.sub("[0-9]", "0", regex.sub(r"\p{L}+", "a", v))
            shape = "hex" if re.fullmatch("[0-9a-f]{16,}", v) and re.search("[a-f]", v) and re.search("[0-9]", v) else written if len(written) <= 40 else hashlib.sha256(written.encode()).hexdigest()
            pats += [f"like {shape}"] if shape not in (None, "hex") else []
            pats += [f"= {shape}"] if shape and re.search(r"= ?[\"']?$", left) else []
            edges += [(n, s, k, e, value, p) for p in pats]
    nodes = {(p, v, k) for _, _, k, _, v, p in edges}
    by = {}
    for p, v, k in nodes:
        by.setdefault(p, []).append((v, k))
    by = {p: x for p, x in by.items() if sum(k >= 0 for _, k in x) >= support and any(k < 0 for _, k in x)}
    best = {}
    for _ in range(rounds):
        score = {p: sum(1.0 if k >= 0 else best.get(v, 0.0) for v, k in x) / (len(x) + prior) for p, x in by.items()}
        best = {}
        for p, x in by.items():
            for v, k in x:
                if k < 0:
                    best[v] = max(best.get(v, 0.0), score[p])
    out = [{(s, k, e) for s, k, e in x} for x in seeds]
    added = {}
    for n, s, k, e, _, p in edges:
        if k < 0 and p in by and score[p] >= accept:
            votes = {kind: sum(x == kind for _, x in by[p]) for kind in range(5)}
            top = max(votes.values())
            kind = min(x for x, c in votes.items() if c == top)
            added.setdefault((n, s, e), []).append((score[p], top, -kind))
    for (n, s, e), x in added.items():
        out[n].add((s, -max(x)[2], e))
    return [sorted(x) for x in out]


def test_pii_spans_match_the_plain_way(spark, docs, odd):
    r = random.Random(6)
    texts = [x["text"] or "" for x in docs.orderBy("doc_id").collect()] + [t or "" for t in ODD[:10]]
    digest = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    for i in range(12):
        texts.append(f"see token = \"{digest(40)}\" and mail a{i}@b.cd or {r.choice(['call', 'ring'])} +1 (555) 010-{1000 + i} now, card 4111 1111 1111 1111")
    texts += [f"set password={digest(18)} there" for _ in range(6)] + ["x commit " + digest(40) + " y", "number 1234567890123456 here", "call (555) 123-4567 now", "IBAN GB29 NWBK 6016 1331 9268 19 of me"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("__base", F.lit("clash"))
    got = {x["doc_id"]: x for x in pii.detect(df).collect()}
    want = contextual(texts)
    assert {i: [tuple(s) for s in got[i]["__spans"]] for i in got} == dict(enumerate(want))
    assert {i: [tuple(s) for s in got[i]["__base"]] for i in got} == {i: base(t) for i, t in enumerate(texts)} and got[0]["a.b"] == 1
    found = {texts[n][s:e] for n, x in enumerate(want) for s, k, e in x if (s, k, e) not in base(texts[n])}
    assert sum(len(v) == 18 for v in found) >= 5 and not any("commit " + v in t for v in found for t in texts)  # passwords shorter than a digest, but no commit


def test_pii_long_texts_and_shapes(spark):
    many = " ".join(f"id{i:06d}x (4{i:06d})" if i % 3 else f"word and {'é' * (i % 9)} user{i}@example.com,10.0.{i % 300}.7" for i in range(3000))
    wide = "call 12345" + " " * 200 + "678 now"
    long_shape = [f"key {'-'.join(['ab1'] * 15)}.{i}@x.yz" for i in range(4)] + [f"key {'-'.join(['cd2'] * 15)}.7@x.yz_ or"]
    texts = [many, wide, *long_shape, "w" * 70 + " a@b.cd " + "v" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["__spans"]] for x in pii.detect(df).collect()}
    want = contextual(texts)
    assert got == dict(enumerate(want)) and len(want[0]) > 1500
    clean = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for s, k, e in want[i]:
            out += [t[at:s], f"<{pii.KINDS[k]}>"] if s >= at else []
            at = max(at, e)
        assert clean[i] == "".join(out) + t[at:]


def test_pii_query_strings(spark):
    said = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, contextual([texts[i] for i in ids]), strict=True))
    for r in pii.op3_pii(spark, DATA).collect():
        own = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(said(own).encode()).hexdigest() and r["spans"] == said(want[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(x == k for _, x, _ in own) for k in range(4))


# -- 4 ----------------------------------------------------------------------------------------


def shingles(t, k=3):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k=3, percent=85):
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        text = [word() for _ in range(r.choice([2, 5, 40, 150]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["id"]: (x["n_shingles"], x["component_id"]) for x in got} == groups(rows)
    assert all(x["kept"] == (x["id"] == x["component_id"]) for x in got)


def test_near_duplicates_odd_rows(odd):
    got = neardup.components(odd).collect()
    assert len(got) == odd.count() and {(x["n_shingles"], x["component_id"], x["kept"]) for x in got if x["id"] == 2} == {(0, 2, True)}
    assert {x["component_id"] for x in got if x["id"] in (5, 11, 12)} == {5} and [x["kept"] for x in got if x["id"] is None] == [True]
    assert neardup.components(odd.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id is not null").collect()]
    root = groups([(n, t) for n, (_, t) in enumerate(rows)])
    first = {g: min(i for n, (i, _) in enumerate(rows) if root[n][1] == g) for _, g in root.values()}
    want = {(i, shingles(t)) for n, (i, t) in enumerate(rows) if first[root[n][1]] == i}  # an id with two texts counts for either
    stay = [(r["doc_id"], shingles(r["text"])) for r in neardup.deduplicated(odd).collect() if r["doc_id"] is not None]
    assert len(stay) == len(set(stay)) and set(stay) == want and {(0, shingles("again")), (0, frozenset())} <= want


def test_near_duplicates_of_one_large_cloud(spark):
    """Copies of one text with so many edits that links hover around the threshold, over several blocks."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(420):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([[], [f"n{n}x{at}"], [copy[at], copy[at]], ["the"]])
        rows.append((n, " ".join(copy)))
    want = groups(rows)
    for block in (32, 1024):
        got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
        assert {x["id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_collisions_and_overlaps_match_plain_counts():
    rng = np.random.default_rng(0)
    sigs = rng.integers(0, 3, (60, 48)).astype(np.uint32)
    i, j = np.triu_indices(60, 1)
    posted = rng.integers(0, 2**48, 60)
    shared = lambda x, y: [k for k in range(48) if posted[x] >> k & posted[y] >> k & 1 and sigs[x][k] == sigs[y][k]]
    many = sorted((x, y) for x, y in zip(i.tolist(), j.tolist()) if sum(p == q for p, q in zip(sigs[x], sigs[y])) >= 20)
    n = np.array([len(shared(x, y)) for x, y in zip(i.tolist(), j.tolist())])
    a, b = neardup.colliding(sigs, posted, i, j, n, 20)
    assert sorted(zip(a.tolist(), b.tolist())) == many
    # lists merged: pairs of a group with the lists they share, by sorting and by table alike
    few, cut = posted & rng.integers(0, 2**48, 60) & rng.integers(0, 2**48, 60), np.array([0, 1, 9, 50, 60])
    posted = few
    want = sorted((x, y, len(shared(x, y))) for s, e in zip(cut[:-1], cut[1:]) for x in range(s, e) for y in range(x + 1, e) if shared(x, y))
    for small in (0, 20, 64):
        assert sorted(z for got in neardup.merged(cut, sigs, few, None, 50, small) for z in zip(*(v.tolist() for v in got))) == want
    left = rng.integers(0, 2, 60).astype(bool)
    either = sorted((x, y, k) for p, q, k in want for x, y in ((p, q), (q, p)) if left[x] and not left[y])
    assert sorted(z for got in neardup.merged(cut, sigs, few, left, 50) for z in zip(*(v.tolist() for v in got))) == either
    assert list(neardup.merged(cut, sigs, few * 0)) == []
    sets = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(60)]
    plain = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(i.tolist(), j.tolist())]
    assert neardup.overlaps(sets, i, j).tolist() == plain and neardup.overlaps(sets, i[:9], j[:9]).tolist() == plain[:9]
    bounds = np.array([0, 1, 3, 703, 708])
    assert sorted((x, y) for p, q in neardup._pairs_within(bounds, 1000) for x, y in zip(p.tolist(), q.tolist())) == [(x, y) for s, e in zip(bounds[:-1], bounds[1:]) for x in range(s, e) for y in range(x + 1, e)]


def test_neardup_broadcasts_no_exploded_coordinates(spark, docs, monkeypatch):
    plans, stage = {}, neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, label: plans.update({label: df._jdf.queryExecution().sparkPlan().toString()}) or stage(df, label))
    neardup.components(docs.select("doc_id", "text"))
    assert "SortMergeJoin [token" in plans["posts"] and "BroadcastHashJoin [token" not in plans["posts"]


# -- 5 ----------------------------------------------------------------------------------------


def test_quality_is_right_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    s = quality.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in s) / len(s) > 0.95 and all(0 <= r["score"] <= 1 for r in s)


def test_quality_odd_rows_and_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__score"] for r in quality.classify(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (1, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r["__score"] <= 1 for r in got)
    assert quality.classify(odd.limit(0), some).count() == 0


def test_quality_matches_plain_ridge_and_isotonic(spark):
    """The same features, solved whole in numpy; the curve pooled by repeated passes."""
    import zlib

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    x = {r["doc_id"]: quality.statistics(r["text"]) for r in docs}
    crc = lambda i: zlib.crc32(str(i).encode())
    ids = sorted(i for i in x if i in y and crc(i) % 3 != 1)
    f, t, fold = np.stack([x[i] for i in ids]), np.array([y[i] for i in ids], dtype=float), np.array([crc(i) % 2 for i in ids])
    rng, n, waves = np.random.default_rng(5), quality.N_STATS, 128
    scale = f.std(axis=0)
    w, b = rng.normal(0, 1 / np.sqrt(n), (n, waves)), None
    b = rng.uniform(0, 2 * np.pi, waves)

    def phi(v):
        z = np.clip((v - f.mean(axis=0)) / np.where(scale > 1e-9, scale, 1.0), -5, 5)
        return np.hstack([np.sqrt(2 / waves) * np.cos(z @ w + b), z, np.ones((len(z), 1))])

    solve = lambda p, q: np.linalg.solve(p.T @ p + 1e-3 * max(1, len(p)) * np.eye(p.shape[1]), p.T @ q)
    p = phi(f)
    other = np.where(fold == 0, p @ solve(p[fold == 1], t[fold == 1]), p @ solve(p[fold == 0], t[fold == 0]))
    bins = np.round(np.clip(other, -1, 2) * 1000)
    knots = [[v, t[bins == v].mean(), (bins == v).sum()] for v in np.unique(bins)]
    while (bad := [i for i in range(len(knots) - 1) if knots[i][1] >= knots[i + 1][1]]):
        a, c = knots[bad[0]], knots.pop(bad[0] + 1)
        m = a[2] + c[2]
        knots[bad[0]] = [(a[0] * a[2] + c[0] * c[2]) / m, (a[1] * a[2] + c[1] * c[2]) / m, m]
    final = solve(p, t)
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, d).collect()}
    want = {i: float(np.clip(np.interp(phi(v[None])[0] @ final, [k[0] / 1000 for k in knots], [k[1] for k in knots]), 0, 1)) for i, v in x.items()}
    assert set(got) == set(x) and max(abs(got[i]["score"] - want[i]) for i in x) < 0.02  # a score on a bin's edge may fall to either side
    assert sum(abs(got[i]["score"] - want[i]) > 1e-6 for i in x) <= 0.02 * len(x)
    assert all(r["held_out"] == (crc(i) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())


# -- 6 ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(4, "u", long), (3, "u", long), (5, None, None), (6, "u\r\nx", "short"), (7, "u", "short"), (None, "u", long), (3, "v", long), (9, "u", "z" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write(df, "file://" + tempfile.mkdtemp(prefix="spark-warc-"), frame_bytes=600)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], len(r["payload"] or b"")) for r in warc.read(index).collect())
    assert got == sorted([("4", "revisit", 3, 0), ("3", "response", None, 120), ("5", "response", None, 0), ("6", "response", None, 5), ("7", "response", None, 5), ("None", "revisit", 3, 0), ("3", "response", None, 120), ("9", "response", None, 5000)])
    for b, frames in {r["bundle"]: r for r in index.collect()}.items():
        table = warc.read_seek_table(b)
        assert sum(c for c, _ in table[: frames["frame"]]) == frames["frame_at"] and table[frames["frame"]][0] == frames["frame_size"]
    assert warc.write(df.limit(0), "file://" + tempfile.mkdtemp(prefix="spark-warc-")).count() == 0


def test_warc_keeps_large_ids_and_null_ones(spark):
    big, same = 2**53 + 1, "y" * 200
    rows = [(big, "u", same), (big + 2, "u", same), (None, "u", same), (None, "v", "z" * 150), (big + 4, "w", "q" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read(warc.write(df, "file://" + tempfile.mkdtemp(prefix="spark-warc-"))).collect())
    assert got == sorted([(str(big), "response", None), (str(big + 2), "revisit", big), ("None", "revisit", big), ("None", "response", None), (str(big + 4), "response", None)])


def test_warc_places_are_those_of_arrow(tmp_path, monkeypatch):
    fs, at = warc.place(f"file://{tmp_path}/x")
    assert at == f"{tmp_path}/x" and fs.type_name == "local" and warc.place(str(tmp_path))[1] == str(tmp_path)
    asked = []

    class Known:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(warc.pafs, "FileSystem", Known)
    assert [warc.place(x)[1] for x in ("s3a://b/k", "s3n://b/k", "s3://b/k", "gs://b/k")] == ["s3://b/k"] * 3 + ["gs://b/k"] == asked
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no file system"):
        warc.place("nowhere://b/k")


# -- 7 ----------------------------------------------------------------------------------------


def counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    at, seen, dup = {}, set(), 0
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rule_statistics(odd, docs):
    d = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in rules.statistics(d).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(r["text"])


def test_rules_learn_a_conjunction(spark, odd):
    r = random.Random(1)
    rows = []
    for _ in range(900):
        x, y = r.random(), r.random()
        rows.append((x > 0.6 and y > 0.5, r.randrange(3), (x, y) + (0.0,) * (len(rules.STATS) - 2)))
    ddl = "bad boolean, fold int, stats struct<" + ",".join(f"{s}:double" for s in rules.STATS) + ">"
    df = spark.createDataFrame(rows, ddl)
    learned = rules.learn(df)
    right = df.filter(learned.verdict() != F.col("bad")).count()
    assert right / len(rows) > 0.95 and "and" in str(learned)
    none = rules.learn(rules.labelled_rows(rules.statistics(odd), spark.createDataFrame([], "doc_id long, quality int")))
    assert str(none) == "\nelse keep"


def test_rules_verdict_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    stats = rules.statistics(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    learned = rules.learn(rules.labelled_rows(stats, spark.read.parquet(f"{d}/labels.parquet")))
    assert learned.rules and str(rules.learn(rules.labelled_rows(stats.repartition(7), spark.read.parquet(f"{d}/labels.parquet")))) == str(learned)  # any order of rows
    values = {r["doc_id"]: r["stats"] for r in stats.collect()}
    for r in rules.op7_rules(spark, d).collect():
        n, *_, again = counts(texts[r["doc_id"]])
        failed = n < 50 or 100 * again > 50 * n
        covered = any(all((values[r["doc_id"]][x.stat] > x.cut) == x.above for x in rule) for rule in learned.rules)
        assert r["base_failed"] == failed and r["kept"] == (not failed and not covered)


# -- 8 ----------------------------------------------------------------------------------------


def held(text, template, width=5):
    """Share of a template's shingles in a text."""
    clean = lambda t: [w for w in regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).split(" ") if w]
    w, t = clean(text), clean(template)
    k = min(width, len(t))
    of = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return len(of(t) & of(w)) / len(of(t))


def test_licenses(spark, odd, docs):
    r = random.Random(9)
    filler = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    more = ["released UNDER the (MIT) license", filler(70) + " This work is licensed under the GNU General Public License version 4", "licensed under the apache license version", "// SPDX-License-Identifier: BSD-3-Clause\n" + filler(30), "# SPDX-License-Identifier: MIT\n" + filler(12), filler(9) + " spdx-license-identifier: Zlib"]
    for name, text in license_texts.TEXTS.items():
        w = text.split()
        inserted = [x for i, x in enumerate(w) for x in ([x, "really"] if i % 60 == 30 else [x])]
        more += [f"{filler(r.randrange(900))} {text} {filler(r.randrange(400))}", f"{filler(333)} {' '.join(inserted)} {filler(50)}", " ".join(w[: int(len(w) * 0.5)]), text.upper().replace(",", " ,")]
        assert name
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*more, *ODD])], "doc_id long, text string")).withColumn("name", F.lit("clash"))
    want = {(x["doc_id"], name, form) for x in d.collect() for name, form, t in license_texts.templates() if held(x["text"], t) >= 0.8}
    got = {(x["id"], x["name"], x["form"]): x for x in licenses.scan(d, licenses.known_licenses(spark)).collect()}
    assert set(got) == want and (10_000, "MIT", "notice") in got and sum(form == "text" for _, _, form in want) >= 3 * len(license_texts.TEXTS)
    texts = {x["doc_id"]: x["text"] for x in d.collect()}
    parts = {(n, f): t for n, f, t in license_texts.templates()}
    assert all(abs(x["share"] - held(texts[i], parts[n, f])) < 1e-9 for (i, n, f), x in got.items() if f == "text")
    assert licenses.scan(odd.limit(0), licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(odd, licenses.known_licenses(spark).limit(0)).count() == 0


def test_license_bands_meet_as_often_as_they_promise(spark):
    import numpy as np

    r = np.random.default_rng(5)
    for held_, union, size in ((66, 400, 128), (104, 793, 256)):
        bands = licenses.bands_for(held_, union, 0.99)
        assert bands < size and licenses.bands_for(held_, union, 0.9999) < size
        missed, tries = 0, 2000
        for _ in range(tries):  # the first ``held_`` hashes are of both sides, the last few of the template alone
            h = r.integers(0, 2**32, union)
            extra = union - 3 * size
            sides = (h[: union - extra], np.concatenate([h[:held_], h[union - extra :]]))
            least = [{int(b): int(x[(x * bands) >> 32 == b].min()) for b in np.unique((x * bands) >> 32)} for x in sides]
            missed += not set(least[0].items()) & set(least[1].items())
        assert missed <= 0.01 * tries + 4 * (0.01 * tries) ** 0.5
    assert licenses.bands_for(3, 3, 0.9999) == 1
    rows = spark.createDataFrame([(sorted(int(x) for x in r.integers(-(2**63), 2**63 - 1, 200)),), ([],)], "h array<long>")
    for row in rows.select("h", licenses._smallest(F.col("h"), 48).alias("s")).collect():
        first: dict[int, int] = {}
        for v in row.h:
            first.setdefault((((v >> 32) + 2**31) * 48) >> 32, v)
        assert row.s == list(first.values())


# -- 9 ----------------------------------------------------------------------------------------


def test_url_lists_as_of_the_fetch(spark):
    e = [("domain", "bad.com", "add", 10), ("domain", "bad.com", "remove", 20), ("domain", "bad.com", "add", 15), ("url", "x.org/a?b=1", "add", 0), ("prefix", "y.net/p", "add", 5), ("domain", None, "add", 1), ("domain", "z.com", "remove", 3), ("domain", "z.com", "add", 3)]
    c = [(1, "http://a.bad.com/q", 9), (2, "http://A.BAD.com:80/q", 10), (3, "https://bad.com", 19), (4, "https://bad.com", 20), (5, "http://www.x.org/a?b=1#f", 1), (6, "http://x.org/a", 1), (7, "http://y.net/p/q?r", 6), (8, "http://y.net/pq", 6), (9, None, 6), (10, "http://bad.com", None), (11, "nonsense", 6), (12, "http://z.com", 4), (3, "https://bad.com", 19)]
    got = urls.listed(spark.createDataFrame(c, "page_id long, url string, fetched_at long"), spark.createDataFrame(e, "kind string, value string, action string, at long"))
    assert sorted((r["page_id"], r["blocked"]) for r in got.collect()) == sorted([(1, False), (2, True), (3, True), (4, False), (5, True), (6, False), (7, True), (8, False), (9, False), (10, False), (11, False), (12, True), (3, True)])


# -- 10 ---------------------------------------------------------------------------------------


def test_bpe_matches_the_library_and_decodes(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, v, r = Tokenizer.from_file(path), bpe.vocabulary(path), random.Random(1)
    letters = ["a", "e", "th", "er", "é", " ", "  ", "\n", "'", "s", "re", "1", "23", "!", "😀", "<|endoftext|>", "字", "\t", "."]
    texts = [t or "" for t in ODD] + [" " * 50000 + "x", "a" * 70000, "'" * 20000 + "s're", "é" * 20000 + "1", "the" * 20000, "a<|endoftext|>b", "a" * 65530 + "'re x", "\U00013460a1\U00032350"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(500)] + ["".join(r.choice(letters[:6]) for _ in range(50000))]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        assert [int(x) for part in bpe.encoded(v, t) for x in part.split(",")] == want
    df = spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, keep=["doc_id", "text"])).collect()
    assert all(x["decoded"] == x["text"] for x in back)
    one = {x["doc_id"]: x for x in bpe.digest(df).collect()}[13]
    ids = ref.encode(texts[13], add_special_tokens=False).ids
    assert (one["n_tokens"], one["ids_sha256"], one["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[13].encode()).hexdigest())
    assert bpe.digest(odd).count() == odd.count()


def test_lookahead_bounds_the_context():
    assert bpe.lookahead([(b"a", b"b"), (b"ab", b"c")]) == 2
    assert bpe.lookahead([(b"ab", b"c")]) is None
    v = bpe.vocabulary(bpe.default_path())
    r = random.Random(9)
    for _ in range(60):
        t = "".join(r.choice(["a", "b", "th", "he", "in", "er"]) for _ in range(600)).encode()
        cut = len(t) - r.randrange(1, 200)
        ends = lambda ids: set(np.cumsum([v.sizes[i] for i in ids]).tolist())
        assert {e for e in ends(v.merge(t)) if e <= cut - v.ahead} == {e for e in ends(v.merge(t[:cut])) if e <= cut - v.ahead}


# -- names that clash ------------------------------------------------------------------------------


def test_columns_named_like_inner_ones_are_kept_or_replaced(spark):
    ddl = "doc_id long, text string, source string, target double, source_size int, size int, n_words int, word_chars int, stats int, ids string, key string, w int, t int"
    d = spark.createDataFrame([(1, "a b c", "s", 1.0, 2, 3, 4, 5, 6, "x", "k", 7, 8), (2, None, None, 1.0, 2, 3, 4, 5, 6, "x", "k", 7, 8)], ddl).withColumn("d.o.t", F.lit("dot")).withColumns({c: F.lit(9) for c in ("row", "blocked", "n_entries", "entry", "__score", "__mix", "uid", "h", "s", "c", "cls", "n", "sig", "b", "g")})
    m = mixing.mix(d)
    assert m.columns == [c for c in d.columns if c != "__mix"] + ["__mix"] and {(r["target"], r["source_size"], r["d.o.t"]) for r in m.collect()} == {(1.0, 2, "dot")}
    assert mixing.emit(d).columns == [c for c in d.columns if c != "__mix"]
    st = rules.statistics(d)
    assert len(st.columns) == len(set(st.columns)) and {r["doc_id"]: (r["n_words"], r["size"], r["d.o.t"]) for r in st.collect()} == {1: (3, 3, "dot"), 2: (0, 3, "dot")}
    e = bpe.encode(d)
    assert len(e.columns) == len(set(e.columns)) and {r["doc_id"]: len(r["ids"]) for r in e.collect()} == {1: 3, 2: 0}
    caps = d.withColumns({"url": F.lit("http://a.b/c"), "fetched_at": F.lit(5).cast("long")})
    u = urls.listed(caps, spark.createDataFrame([("domain", "a.b", "add", 1)], "kind string, value string, action string, at long"))
    assert len(u.columns) == len(set(u.columns)) and [(r["blocked"], r["n_entries"], r["entry"], r["uid"]) for r in u.collect()] == [(True, 1, "domain:a.b", 9)] * 2
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(d, labels).columns == d.columns
    p = pii.redact(d)
    assert p.columns == d.columns and {r["text"] for r in p.collect()} == {"a b c", None}
    assert {r["doc_id"]: r["d.o.t"] for r in neardup.deduplicated(d).collect()} == {1: "dot", 2: "dot"} and neardup.deduplicated(d).columns == d.columns
    assert licenses.scan(d, licenses.known_licenses(spark)).count() == 0


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, odd):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    for name, step in p.STAGES:
        before, now = now, step(spark, now, DATA)
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != p.STAGES[-1][0]:
            assert now.columns == list(docs.columns)
        if name == "quality":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            assert before.join(labels.filter("quality = 1"), "doc_id").join(now, "doc_id", "left_anti").count() <= 3
        if name == "near-duplicates":
            want = {i for i, (_, g) in groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80).items() if i == g}
            assert {r["doc_id"] for r in now.collect()} == want
        if name == "personal data":
            assert not any(base(r["text"]) for r in now.collect())
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            spans = dict(zip(sorted(old), contextual([old[i] or "" for i in sorted(old)]), strict=True))
            assert all((r["text"] != old[r["doc_id"]]) == bool(spans[r["doc_id"]]) for r in now.collect())
        if name == "mix":
            size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
            rows, taken = before.collect(), {}
            for r in now.collect():
                taken.setdefault(r["source"], []).append(r)
            total = sum(size(r["text"]) for r in rows)
            plain = {r["source"]: 0 for r in rows}
            for r in rows:
                plain[r["source"]] += size(r["text"])
            order = sorted(plain, key=lambda x: (x is None, x))
            weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
            capped, free = {}, set(order)
            while True:  # reshares what capped sources leave until none is above
                level = (total - sum(capped.values())) / sum(weight[x] for x in free)
                over = {x for x in free if level * weight[x] > 3 * plain[x]}
                if not over:
                    break
                capped |= {x: 3 * plain[x] for x in over}
                free -= over
            for x in order:
                aim = capped.get(x, level * weight[x] if x in free else 0)
                mine = [r for r in rows if r["source"] == x]
                assert abs(sum(size(r["text"]) for r in taken.get(x, [])) - aim) <= max(size(r["text"]) for r in mine)
            copies = {}
            for r in now.collect():
                copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
            assert max(copies.values()) <= 3 and set(copies) <= {(r["doc_id"], r["text"]) for r in rows}
        if name == "tokens":
            import public_tokenizers
            from tokenizers import Tokenizer

            ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            said = {}
            for r in before.collect():
                said.setdefault(r["doc_id"], set()).add(tuple(ref.encode(r["text"] or "", add_special_tokens=False).ids))
            got = now.collect()
            assert len(got) == before.count() and all(tuple(r["ids"]) in said[r["doc_id"]] for r in got)
    assert now.count() and now.filter("n_tokens <> size(ids)").count() == 0
    odd.write.parquet(str(tmp_path / "odd"))
    now = spark.read.parquet(str(tmp_path / "odd"))
    for name, step in p.STAGES:
        now = step(spark, now, DATA)
    assert set(now.columns) == {"doc_id", "source", "ids", "n_tokens"}
