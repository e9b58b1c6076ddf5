"""The training-data operators against brute force, on small tables with the awkward cases in them."""

import collections
import functools
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, katz, language, licenses, linedup, neardup, packing, pipeline, quality, queries, topk, warc
from millrace.llm.common import held_out, remainder, smallest, table

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
EXTRA = "key string, score string, label string, node string, drops string, n string, lang_pred string, _key string, text_key string, n_lines string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def clashing(df):
    for c in EXTRA.split(", "):
        df = df.withColumn(c.split()[0], F.lit("?"))
    return df


BASE = [(i, prose(60, i)) for i in range(12)]
NEAR = BASE[3][1].replace(BASE[3][1].split()[0] + " ", "zz ", 1)
EDGES = [*BASE, (20, BASE[0][1]), (20, BASE[0][1]), (None, BASE[1][1]), (21, None), (22, ""), (23, "one"), (24, "ab cd ef gh"), (25, "ab cd ef gh"), (26, NEAR), (27, "x" * 50_000), (28, "12 34 !!"), (29, prose(9000, 77)), (None, None), (30, "é ü ñ " * 20)]


def shingle_bag(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 0


# 1


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_exact_topk", "op5_decontamination", "op7_line_dedup", "op9_warc"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = c.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple("-" if pd.isna(x) else x if isinstance(x, str) else float(x) for x in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_smallest(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    plain = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(50)
    assert sorted(smallest(rows, 50, 3).collect()) == sorted(plain.collect())
    assert smallest(rows.limit(0), 50, 3).count() == 0 and smallest(rows.withColumn("doc_id", F.lit(1)), 50, 3).count() == 50


def test_license_cases(spark):
    rows = [(1, "X UNDER the MIT\nlicense, under the mit license"), (2, None), (3, ""), (None, "Released, under  MIT license"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "licensed under CC BY NC 4 0 " * 2000), (6, "the under"), (7, "liKense"), (8, "Licensed under CC BY-SA 4.0")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(clashing(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    assert (got[1, 9].n_base, got[1, 9].first_word, got[1, 9].last_word, got[1, 9].labels) == (2, 1, 5, "mit")
    assert got[2, 0].labels == got[3, 0].labels == "" and got[2, 0].first_word is None
    assert got[None, 4].base_labels == "" and got[None, 4].labels == "mit" and got[None, 4].score == pytest.approx(0.8)
    assert got[5, 12].labels == "gpl-3" and got[6, 14000].n_base == 2000 and got[8, 7].labels == "cc-by-sa"
    assert licenses.scan(frame(spark, [])).count() == 0


LABELLED = {
    "Released under the Apache License": "",
    "released the license under review by the board": "",
    "released by the license board of MIT under review": "",
    "under the terms of the GNU General Public License version 3": "gpl-3",
    "under the terms of the GNU General Public License version 2": "gpl-2",
    "licensed under the GNU Affero General Public License version 3": "agpl-3",
    "licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1",
    "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "the creative commons of the village is an international meeting place": "",
}


def test_license_labels(spark):
    rows = list(enumerate(LABELLED)) + [(100 + i, "zz " * 40 + t.text + " zz" * 40) for i, t in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert {t: got[i].labels for i, t in enumerate(LABELLED)} == LABELLED
    for i, t in enumerate(licenses.TEMPLATES):
        named = got[100 + i].labels.split(",")
        # the base phrase "cc by nc" also stands in its kinds, so its label does
        assert t.label in named and set(named) <= {t.label, "cc-by-nc"}, (t, named)
        assert all(40 - len(t.text.split()) <= m.first_word + len(t.text.split()) for m in got[100 + i].matches)


def test_license_plan_size(spark):
    docs = frame(spark, [(1, "a")])
    nodes = lambda n: licenses.scan(docs, templates=[licenses.Template(f"x{i}", f"one{i} two{i} three four") for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert nodes(300) == nodes(3)


# 2


def test_language(spark, sf):
    docs = table(spark, sf, "documents")
    got = queries.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(i, prose(40, i), "x") for i in range(20)] + [(100 + i, prose(40, i).upper()[::-1].translate(str.maketrans("ABCDEFGHIJ", "QRSTUVWXYZ")), "y") for i in range(20)]
    docs = frame(spark, rows, "doc_id long, text string, label string")
    model = language.fit(language.sample(docs, F.lit(True)))
    got = {r.doc_id: r for r in language.identify(clashing(frame(spark, [(1, None), (2, "12 ;"), (3, prose(5, 99)), (4, ""), (None, "qrst"), (5, "ab" * 200_000)])), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, None, 5)] == ["und", "und", "x", "und", "y", "x"]
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
    one = language.fit(docs.filter("label = 'x'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"x"}
    code = language.codewords(9)
    assert len({tuple(r) for r in code}) == 9 and min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8


def brute_language(model, text):
    """(language, score) by the definition: n-grams one by one, then the codeword of least weighted loss."""
    fold = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    codes = [32, 32] + [ord(fold(c)) for c in text or ""]
    one = lambda x: int(language.mix(np.array([x], np.uint64))[0]) % (language.BUCKETS - 1)
    sums, size = np.zeros(len(model.bias)), 0
    for t in range(2, len(codes)):
        a, b, c = codes[t - 2 : t + 1]
        if c != 32 or b != 32:
            size += 1
            for g in ((1 << 63) + c, (1 << 62) + (b << 21 | c), a << 42 | b << 21 | c):
                sums += model.weights[:, one(g)]
    if not any(c.isalpha() for c in text or "") or not model.languages:
        return "und", 0.0
    margins = sums / max(size, 1) + model.bias
    losses = [sum(trust * math.log1p(math.exp(-m * bit)) for m, bit, trust in zip(margins, code, model.trust)) for code in model.code]
    p = np.exp(min(losses) - np.array(losses))
    return model.languages[int(np.argmin(losses))], float(p.max() / p.sum())


def test_language_brute(spark, sf):
    docs = table(spark, sf, "documents").filter("n_chars < 1500")
    model = language.fit_documents(table(spark, sf, "documents"))
    odd = frame(spark, [(-1, "İstanbul ǅ É"), (-2, ""), (-3, None), (-4, "a"), (-5, "1 2 3"), (-6, "a"), (-6, "a")])
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = language.identify(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        want, score = brute_language(model, r.text)
        assert r.lang_pred == want and r.score == pytest.approx(score, abs=1e-4)


def test_language_sample(spark):
    assert language.shares({"a": 3, "b": 100, "c": 100}, 50) == {"a": 3, "b": 23, "c": 24}
    rows = [(i, f"t{i}", "x") for i in range(900)] + [(2000 + i, f"u{i}", "y") for i in range(7)] + [(5, "same", "z")] * 500
    docs = frame(spark, rows, "doc_id long, text string, label string")
    got = collections.Counter(r.label for r in language.sample(docs, F.lit(True), 60).collect())
    assert got["y"] == 7 and got["x"] >= 20 and 1 <= got["z"] <= 30 and sum(got.values()) <= 60


# 3


def brute_katz(docs):
    """Scores of (train, tokens) documents by the definition, for order 3, with the discounts found the same way."""
    end = "\0end"
    grams = {n: collections.Counter() for n in (1, 2, 3)}
    for train, tokens in docs:
        if train:
            padded = [end, end, *tokens]
            for n in grams:
                grams[n].update(tuple(padded[t - n + 1 : t + 1]) for t in range(2, len(padded)))
    total, types = sum(grams[1].values()), len(grams[1])
    d = {n: katz.good_turing([0] + [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]) for n, c in grams.items()}
    disc = lambda n, c: c * (d[n][c] if c <= katz.K else 1.0)
    spare = 1 - sum(disc(1, c) for c in grams[1].values()) / total
    after = {2: collections.defaultdict(list), 3: collections.defaultdict(list)}
    for n in after:
        for g, c in grams[n].items():
            after[n][g[:-1]].append((g[-1], c))
    sums = {n: {h: sum(c for _, c in ws) + all(d[n][min(c, katz.K)] == 1 or c > katz.K for _, c in ws) for h, ws in x.items()} for n, x in after.items()}

    @functools.cache
    def weight(h):
        n = len(h) + 1
        seen = after[n][h]
        return (1 - sum(disc(n, c) for _, c in seen) / sums[n][h]) / (1 - sum(p(w, h[1:]) for w, _ in seen))

    @functools.cache
    def p(w, h):
        n = len(h) + 1
        if n == 1:
            return disc(1, grams[1][(w,)]) / total if grams[1][(w,)] else spare
        if h not in sums[n]:
            return p(w, h[1:])
        c = grams[n][(*h, w)]
        return disc(n, c) / sums[n][h] if c else weight(h) * p(w, h[1:])

    for n in after:  # a history sums to one over all words and the unseen class
        for h in list(after[n])[:20]:
            assert sum(p(w, h) for (w,) in grams[1]) + p("\0new", h) == pytest.approx(1)
    base = [sum(math.log10((grams[1][(w,)] + 1) / (total + types + 1)) for w in t) for _, t in docs]
    score = [sum(math.log10(p(t[i], tuple([end, end, *t][i : i + 2]))) for i in range(len(t))) for _, t in docs]
    return total, base, score


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_katz(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BATCH", 3000)
    monkeypatch.setattr(katz, "PAIRS", 400)
    texts = [prose(80, i % 25) if i % 3 else "a b\ta " * 20 + prose(10, i) for i in range(60)] + ["", None, "One ONE\x0bone", "q" * 5000, "a b a c zz a b"]
    rows = [(i, i % 7 != 2, t) for i, t in enumerate(texts)] + [(None, False, "a b"), (-(1 << 63), True, "a b c")]
    got = {r.doc_id: r for r in katz.score(clashing(frame(spark, rows, "doc_id long, train boolean, text string"))).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    n, base, score = brute_katz([(train, [*low(t), "\0end"]) for _, train, t in rows])
    assert len(got) == len(rows) and got[0].train_tokens == n
    for (i, _, t), b, s in zip(rows, base, score, strict=True):
        assert got[i].base_score == pytest.approx(b, rel=1e-9) and got[i].score == pytest.approx(s, rel=1e-9)
        assert got[i].n_tokens == len(low(t)) + 1


def test_katz_packing():
    arrays = [np.arange(300, dtype="<u2"), np.zeros(0, "<u1"), np.array([1.5, -2.0]), np.array([1 << 40], "<u8")]
    back = katz.unpack(katz.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))
    value, pos, rank = katz.grouped(np.array([5, 3, 5, 1 << 62, 3]))
    assert value.tolist() == [3, 5, 1 << 62] and rank.tolist() == [1, 0, 1, 2, 0] and sorted(pos.tolist()) == [0, 1, 3]


def test_katz_empty(spark):
    ddl = "doc_id long, train boolean, text string"
    assert katz.score(frame(spark, [], ddl)).count() == 0
    got = katz.score(frame(spark, [(1, False, "a b")], ddl)).first()
    assert (got.score, got.base_score, got.n_known) == (0, 0, 0)


def test_katz_held_out_gain(spark, sf):
    got = queries.op3_katz_lm(spark, sf).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


# 4


def brute_topk(rows, every=50, k=5):
    """Each query row's k best by Python integers; rows count singly."""
    v = [(i, [math.floor(256 * e) for e in x]) for i, x in rows if i is not None and x is not None and all(e is not None and math.isfinite(e) for e in x)]
    clamp = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = []
    for n, (q, x) in enumerate(v):
        if q % every == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(x, y))), c) for m, (c, y) in enumerate(v) if m != n)[:k]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(want)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "RUN", 2)
    monkeypatch.setattr(topk, "GROUP", 2)
    r = np.random.default_rng(3)
    single = lambda x: [float(np.float32(e)) for e in x]
    rows = [(i, single(r.normal(size=20) * (1 + i % 5))) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 20), (1003, [float("inf")] * 20), (None, [1.0]), (1050, []), (1051, [2.0, 1.0])]
    rows += [(2000 + i, rows[0][1]) for i in range(9)] + [rows[7], rows[7], rows[50], rows[50]]
    got = topk.search(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), 50, 5).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), 50).count() == 0


@pytest.mark.parametrize("kind,size", [("float", 1e4), ("float", 1e6), ("double", 1e7), ("double", 1e30), ("double", 1e200), ("float", 3e38)])
def test_topk_large_numbers(spark, monkeypatch, kind, size):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(5)
    rows = []
    for i in range(120):
        x = r.uniform(-1, 1, 12) * (size if i % 4 else 1.0)
        rows.append((i, [float(np.float32(e)) if kind == "float" else float(e) for e in x]))
    got = topk.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), 10, 5).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 10)


# 5


def brute_leaks(rows, items):
    """Best similarity over all windows of an item's length, at every start, of every document."""
    want = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, item in items:
            part = (item or "").lower().split()
            k = min(5, len(part))
            grams = lambda ws: [tuple(ws[x : x + k]) for x in range(len(ws) - k + 1)]
            if not part or not set(grams(part)) & set(grams(w)):
                continue
            b, n, g = collections.Counter(grams(part)), len(part) - k + 1, grams(w)
            best = max(jaccard(collections.Counter(g[max(s, 0) : s + n]), b) for s in range(1 - n, len(g)))
            if best >= 0.8:
                want[d, i] = max(want.get((d, i), 0), best)
    return want


def test_decontamination(spark):
    items = [(1, prose(30, 500)), (2, prose(45, 501)), (3, None), (4, ""), (5, "one two three"), (1, prose(30, 500)), (6, prose(2300, 502) + " of the test"), (7, "What"), (8, "la " * 20 + prose(20, 512))]
    mid, long = prose(50, 600), items[6][1].split()
    rows = [*EDGES, (40, mid + " " + items[0][1] + " " + mid), (41, items[1][1].upper()), (42, "zz " + items[1][1].split(" ", 1)[1]), (43, items[4][1]), (44, " ".join(items[1][1].split()[:30])), (40, mid + " " + items[0][1] + " " + mid), (45, (items[0][1] + " ") * 40)]
    rows += [(46, " ".join(long[:1500])), (47, "zz " + " ".join(long[50:-20]) + " zz"), (48, mid + " of the test " + mid), (49, mid + " one two three " + mid), (50, "what"), (51, "la " * 60), (52, mid + " " + " ".join(items[8][1].split()[15:] + items[8][1].split()[:15]))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(clashing(frame(spark, rows)), frame(spark, items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert {(47, 6), (49, 5), (50, 7)} <= set(got) == set(want) and not {(46, 6), (48, 6)} & set(got)
    assert all(got[k] == pytest.approx(x) for k, x in want.items())
    left = decontamination.clean(clashing(frame(spark, rows)), frame(spark, items, "item_id long, text string"))
    assert left.count() == len(rows) - sum(d in {k[0] for k in got} for d, _ in rows) and "_key" in left.columns
    empty = frame(spark, [], "item_id long, text string")
    assert decontamination.matches(frame(spark, rows), empty).count() == 0
    assert decontamination.matches(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0


def test_decontamination_any_order(spark):
    items = [(1, prose(60, 510)), (2, prose(45, 511)), (3, "la " * 20 + prose(20, 512)), (4, prose(120, 513))]
    one, two, three, four = (i[1].split() for i in items)
    mid = prose(8, 601).split()
    texts = [one[30:] + one[:30], one[20:] + one[:20], two[15:30] + two[:15] + two[30:], three[20:] + three[:20], ["la"] * 60, one[40:] + one[:20], four[60:] + four[:60]]
    rows = [(k, " ".join(t)) for k, t in enumerate([*(mid + t + mid for t in texts), *texts, one, mid + one, two[1:]])]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert {(0, 1), (1, 1), (6, 4)} <= set(want) == set(got)
    assert all(got[k] == pytest.approx(x) for k, x in want.items()) and want[6, 4] > 0.9
    assert not {0, 1, 6} & {r.doc_id for r in decontamination.clean(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_random(spark, seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(VOCAB[:40]) for _ in range(r.randint(1, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        cut = r.randrange(len(w))
        w = w[cut:] + w[:cut] if d % 3 == 0 else w[: len(w) - r.randint(0, 4)] if d % 3 == 1 else w
        pad = lambda: [r.choice(VOCAB) for _ in range(r.choice([0, 0, 3, 30]))]
        rows.append((d, " ".join([*pad(), *w, *pad()])))
    got = {(x.doc_id, x.item_id): x.similarity for x in decontamination.matches(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(x) for k, x in want.items())


def test_decontamination_large_index(spark, monkeypatch):
    items, rows = [(1, prose(30, 500))], [(1, prose(30, 500) + " x"), (2, prose(70, 9))]
    monkeypatch.setattr(decontamination, "LITERAL", 0)
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    got = decontamination.matches(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_simhash(spark):
    hashes = [5, -7, 1 << 62, -(1 << 63), 12345, 5]
    df = spark.createDataFrame([(hashes,)], "h array<long>")
    mark = decontamination.fingerprint(df, "h", "m").first().m
    want = sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in hashes) * 2 > len(hashes))
    assert mark % (1 << 64) == want
    parts = spark.createDataFrame([(mark,)], "m long").select(decontamination.blocks(F.col("m")).alias("b")).first().b
    assert len(parts) == decontamination.RADIUS + 1


# 6


def test_quality(spark, sf):
    labels = table(spark, sf, "labels")
    got = queries.op6_quality(spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_quality_cases(spark):
    rows = [(i, prose(30, i), 1) for i in range(30)] + [(100 + i, ("!! " + prose(1, i) + " ") * 30, 0) for i in range(30)]
    docs = frame(spark, rows, "doc_id long, text string, label int")
    model = quality.fit(quality.sample(docs, F.lit(True)))
    new = frame(spark, [(1, None), (2, ""), (3, prose(25, 999)), (4, "!! ab " * 5000), (None, "?")])
    got = {r.doc_id: r.score for r in quality.score(clashing(new), model).collect()}
    assert got[1] == got[2] == pytest.approx(0.5) and got[3] > 0.7 > got[4]
    v = model.embed(*__import__("millrace.llm.textvec", fromlist=["x"]).text_buffers(__import__("pyarrow").array([prose(25, 999)])))
    sims = (v / np.linalg.norm(v)) @ model.vectors.T
    near = np.argsort(-sims[0])[: quality.NEIGHBOURS]
    w = np.maximum(sims[0][near], 0) ** 4 + 1e-9
    assert got[3] == pytest.approx(float((w * model.labels[near]).sum() / w.sum()), rel=1e-3)
    assert {r.score for r in quality.score(new, quality.fit(docs.limit(0))).collect()} == {0.5}


def brute_quality(model, text):
    """The vote of the nearest labelled vectors, with terms found token by token."""
    from millrace.llm import textvec

    def kind(b):
        return 0 if b in b",.'-" else 1 if 97 <= b < 123 or b >= 128 else 2 if 65 <= b < 91 else 4 if 48 <= b < 58 else 8

    half, bag = quality.TERMS // 2, collections.Counter()
    mixed = lambda x: half + int(textvec.mix(np.array([x % (1 << 64)], np.uint64))[0]) % half
    shapes, last = [], None
    for token in (text or "").encode().split():
        low = np.frombuffer(token.lower(), np.uint8)
        h = int(textvec.span_hashes(low, np.array([0]), np.array([len(low)]))[0])
        bits = 0
        for b in token:
            bits |= kind(b)
        shapes.append(bits << 6 | min(len(token), 31) // 4 << 2 | (h == last) << 1 | (kind(token[0]) == 2))
        bag[h % half] += 1
        bag[mixed(shapes[-1])] += 1
        last = h
    for n in (2, 3):
        for i in range(len(shapes) - n + 1):
            s = 0
            for x in shapes[i : i + n]:
                s = (s << 10) | x
            bag[mixed(s + n)] += 1
    if not bag:
        return model.prior
    v = np.zeros(quality.TERMS)
    for k, c in bag.items():
        v[k] = math.log1p(c) * model.idf[k]
    z = v @ model.basis.astype(float)
    sims = model.vectors.astype(float) @ (z / np.linalg.norm(z))
    near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[: quality.NEIGHBOURS]
    w = [max(sims[i], 0) ** 4 + 1e-9 for i in near]
    return sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w)


def test_quality_brute(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.join(quality.sample(labels, remainder(F.col("doc_id"), 4) != 2), "doc_id"))
    rows = docs.filter(F.length("text") < 1500).unionByName(frame(spark, [(-1, None), (-2, ""), (-3, "?! ?! 12,5 Abc abc abc"), (-3, "?! ?! 12,5 Abc abc abc"), (-4, "é" * 50)]))
    got = quality.score(rows, model).join(rows.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert len(got) == rows.count()
    off = [abs(r.score - brute_quality(model, r.text)) for r in got]
    # rounding may swap neighbours at the cut, each with a vote of about 1 / NEIGHBOURS
    assert sorted(off)[int(0.98 * len(off))] < 1e-3 and max(off) < 0.1


def test_quality_ties():
    vectors = np.tile(np.array([[1.0, 0.0]], np.float32), (80, 1))
    labels = np.r_[np.ones(quality.NEIGHBOURS), np.zeros(80 - quality.NEIGHBOURS)]
    model = quality.Model(np.ones(4), np.ones((4, 2)), vectors, labels, 0.5)
    assert model.score(np.array([[2.0, 0.0], [0.0, 0.0]], np.float32)).tolist() == [1.0, 0.5]


# 7


def test_line_dedup(spark):
    long = prose(55, 700)
    other = " ".join(["zz" if i == 30 else w for i, w in enumerate(long.split())])
    far = " ".join(["zz" if i in (10, 30, 50) else w for i, w in enumerate(long.split())])
    short = "please log in as user 7 now"
    rows = [(1, f"a\n{long}\nb"), (2, f"{long}\nc d"), (3, f"x\n{other}"), (4, f"y\n{far}"), (5, None), (6, ""), (None, f"{long}\nq"), (7, f"{long}\n{long}"), (7, f"{long}\n{long}")]
    rows += [(50 + i, f"{prose(30, 800 + i)}\n{short.replace('7', str(i * 37))}") for i in range(9)]
    names = ["ann", "bob", "cy", "dee", "ed", "flo", "gil", "hal", "ida", "jo"]
    rows += [(70 + i, f"user {x} logged into the main portal\n{x} was here at the time") for i, x in enumerate(names[:7] + names[:1])]
    rows += [(80 + i, f"the {x} logged out of the main portal") for i, x in enumerate(names)]
    got = {(r.doc_id, r.n_lines): r for r in linedup.strip(clashing(frame(spark, rows)), ("n_lines", "drops")).collect()}
    assert got[1, 3].text == f"a\n{long}\nb" and got[2, 2].text == "c d" and got[3, 2].text == "x"
    assert got[4, 2].drops == [] and got[5, 1].text is None and got[6, 1].text == "" and got[None, 2].text == "q"
    assert got[7, 2].drops == [0, 1] and got[7, 2].text == ""
    assert got[50, 2].drops == [] and all(got[50 + i, 2].drops == [1] for i in range(1, 9))
    # variable words: seven names in eight documents are enough, seven documents would not be
    assert got[70, 2].drops == [] and all(got[70 + i, 2].drops == [0, 1] for i in range(1, 8))
    assert got[80, 1].drops == [] and all(got[80 + i, 1].text == "" for i in range(1, 10))
    few = [r for r in rows if r[0] is None or r[0] < 76]
    assert all(r.drops == [] for r in linedup.strip(frame(spark, few)).filter("doc_id between 70 and 75").collect())
    assert linedup.strip(frame(spark, [])).count() == 0


def brute_lines(docs):
    """{doc_id: numbers of the lines it loses} for documents with different ids."""
    of, limits = collections.defaultdict(list), linedup.LIMITS
    for d, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            t = "".join("0" if c.isdigit() and c.isascii() else c for c in line)
            while "00" in t:
                t = t.replace("00", "0")
            t = tuple(x for x in t.replace("\t", " ").replace("\r", " ").split(" ") if x)
            n = len(t)
            if n >= limits.least:
                of[n, "exact", t].append((d, at))
                for j in range(linedup.RUNS):
                    a, z = j * n // linedup.RUNS, (j + 1) * n // linedup.RUNS
                    of[n, j, t[:a], t[z:]].append((d, at))
    lost = collections.defaultdict(set)
    for k, places in of.items():
        ids = {d for d, _ in places}
        if len(ids) >= (2 if k[0] >= limits.long else limits.often):
            for d, at in places:
                if d != min(ids):
                    lost[d].add(at)
    return lost


def test_line_dedup_brute(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.drops for r in queries.op7_line_dedup(spark, sf).collect()}
    assert {d: x for d, x in got.items() if x} == {d: ",".join(map(str, sorted(x))) for d, x in brute_lines(docs).items()}


# 8


def test_signatures_are_unbiased():
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    wa, wb = np.r_[np.full(200, 3), np.full(100, 1), np.zeros(100, int)], np.r_[np.full(200, 2), np.zeros(100, int), np.full(100, 5)]
    sim = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    both = []
    for w in (wa, wb):
        k = w > 0
        both.append(neardup.signatures(a[k], np.zeros(k.sum(), int), w[k], 1, 4096)[0])
    assert np.mean(both[0] == both[1]) == pytest.approx(sim, abs=0.04)


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    bags, up = [shingle_bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                up[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        c = of[t or ""]
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return sorted(((d, least[of[t or ""]]) for d, t in rows), key=str)


@pytest.mark.parametrize("stars,fine,tile", [(2, neardup.FINE, 256), (0, (), 4), (0, (), 256)])
def test_near_duplicates(spark, monkeypatch, stars, fine, tile):
    monkeypatch.setattr(neardup, "CELL", 64)
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "FINE", fine)
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "WIDTH", 300)
    chain = [prose(120, 900).split()]
    for i in range(8):  # neighbours are near, the ends are not
        chain.append(["w%d%d" % (i, j) if 10 * i <= j < 10 * i + 8 else w for j, w in enumerate(chain[-1])])
    rows = [*EDGES, *((60 + i, " ".join(w)) for i, w in enumerate(chain))]
    base = prose(200, 901).split()
    r = random.Random(2)
    for i in range(40):  # a group of near copies
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = "q%d" % r.randrange(1000)
        rows.append((100 + i, " ".join(w)))
    got = neardup.classes(clashing(frame(spark, rows))).collect()
    assert sorted(((x.doc_id, x.class_id) for x in got), key=str) == brute_classes(rows)
    kept = [x for x in got if x.representative]
    assert len({(x.doc_id, x.text_key) for x in kept}) == len(set(x.class_id for x in got if x.class_id is not None)) + len({x.text_key for x in got if x.class_id is None})
    assert neardup.classes(frame(spark, [])).count() == 0


def test_near_duplicates_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op8_near_duplicates(spark, sf).collect()
    assert sorted(((x.doc_id, x.class_id) for x in got), key=str) == brute_classes(docs)


# 9


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc(spark, sf, monkeypatch, broadcast):
    import base64
    import hashlib

    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    pages = table(spark, sf, "pages").collect()
    rows = [(p.page_id, p.url, p.html) for p in pages] + [(9001, "u\r\nx", None), (9002, None, ""), (9003, "u", pages[0].html), (9004, "u", "x" * 900_000), (None, "n", "only"), (None, "n", pages[1].html), (9005, "é", "ü\r\n\r\nWARC/1.1"), (9006, "d", "same"), (9006, "d", "same")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    bundles = warc.archive(df)
    got = warc.read_records(bundles).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        top[sha(h)] = max((x for x in (top.get(sha(h)), i) if x is not None), default=None)
    want = sorted(((i, len((h or "").encode()), sha(h), "revisit" if top[sha(h)] is not None and i != top[sha(h)] else "response", top[sha(h)] if top[sha(h)] is not None and i != top[sha(h)] else None) for i, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    spot = warc.index(bundles).filter("page_id = 9004").first()
    data = bytes(bundles.filter(F.col("bundle_id") == spot.bundle_id).first().data)
    head, body = warc.read_record(data, spot.frame, spot.frame_offset)
    assert len(body) == 900_000 and head["WARC-Record-ID"] == "<urn:page:9004>"
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # plain readers skip the footer
    assert sum(r for _, _, r in warc.read_seek_table(data)) == len(whole)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_threshold_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "tiny"), (2, "b", "tiny"), (3, "a", "x" * 99), (4, "a", "x" * 99)], "page_id long, url string, html string")
    bundles = warc.archive(df, least=50)
    assert {r.page_id: r.refers_to for r in warc.read_records(bundles).collect()} == {1: None, 2: None, 3: 4, 4: None}
    assert warc.export(bundles, str(tmp_path)) == len(list(tmp_path.iterdir())) == bundles.count()


# 10


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    odd = [(70, "İstanbul ΑΣ ΟΔΟΣ it's I'LL we'Re"), (71, "a <|endoftext|> x"), (76, "<|endo<|startoftext|>é <|ENDOFTEXT|>"), (77, "<|endoftext|>" * 300), (72, "a b\x1cc\x85d ½²³ ªº µ"), (73, "naïve K Ǆ ß ẞ"), (74, "x" * 100 + "'s"), (75, "".join(chr(c) + " " * (c % 3 == 0) for c in range(0xA1, 0x250)))]
    rows = [*EDGES, *odd]
    got = packing.pack_documents(clashing(frame(spark, rows)), packing.default_tokenizer()).collect()
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((d, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 3
    assert packing.pack_documents(frame(spark, []), packing.default_tokenizer()).count() == 0


def test_packing_spreads_equal_rows(spark):
    rows = spark.range(0, 1000, 1, 4).select(F.lit(1).alias("doc_id"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(rows, capacity=64, group=100).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 200 and sum(r["count"] for r in got) == 1000


def test_sum_of_squares_rule():
    r = random.Random(4)
    sizes, cap = [r.randint(1, 20) for _ in range(300)], 20
    seq, off = packing.sum_of_squares(np.array(sizes), cap)
    gaps = {}
    for s, q, o in zip(sizes, seq, off, strict=True):
        count = collections.Counter(g for g in gaps.values() if g)

        def after(g, s=s, count=count):
            c = count.copy()
            if g != cap:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(x * x for x in c.values())

        options = [g for g in range(s, cap) if count[g]] + [cap]
        assert gaps.get(q, cap) == min(options, key=lambda g: (after(g), g)) and o == cap - gaps.get(q, cap)
        gaps[q] = gaps.get(q, cap) - s


# the pipeline


def test_pipeline_brute(spark, sf):
    """Every stage's rows against brute force on its own input, for the whole tables."""
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    stages = dict(pipeline.STAGES)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]

    found = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    kept = docs.filter(F.col("doc_id").isin([d for d, r in found.items() if r.lang_pred != "und" and not r.ambiguous]))
    assert plain(stages["language_id"](spark, docs, sf)) == plain(kept) and kept.count() >= 0.95 * docs.count()

    lost = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    want = []
    for r in kept.collect():
        text = "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in lost[r.doc_id]) if lost[r.doc_id] else r.text
        if text is None or text.strip() or not lost[r.doc_id]:
            want.append(r.asDict() | {"text": text, "n_chars": len(text) if lost[r.doc_id] else r.n_chars})
    want = spark.createDataFrame(want, docs.schema)
    assert plain(stages["line_dedup"](spark, kept, sf)) == plain(want)

    rows = [(r.doc_id, r.text) for r in want.collect()]
    firsts = {c for _, c in brute_classes(rows)}
    unique = want.filter(F.col("doc_id").isin(list(firsts)))
    assert plain(stages["near_duplicates"](spark, want, sf)) == plain(unique)

    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bad = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in unique.collect()], items)}
    clean = unique.filter(~F.col("doc_id").isin(list(bad) or [-1]))
    assert bad and plain(stages["decontamination"](spark, unique, sf)) == plain(clean)

    t = Tokenizer.from_file(packing.default_tokenizer())
    pieces = []
    for r in clean.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces += [(r.doc_id, p, a, min(4096, len(ids) - a), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    got = pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_pipeline_languages(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    monkeypatch.setattr(pipeline, "LANGUAGES", ("en",))
    got = pipeline.keep_languages(spark, docs, sf).groupBy("lang").count().collect()
    count = {r.lang: r["count"] for r in got}
    assert count["en"] >= 0.9 * docs.filter("lang = 'en'").count() and sum(count.values()) <= 1.1 * count["en"]
    monkeypatch.setattr(pipeline, "LANGUAGES", None)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.keep_languages(spark, none, sf).count() >= 0.9 * docs.count()


def test_pipeline_edges(spark, sf):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in EDGES]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.filter("key <> '?' or _key <> '?' or drops <> '?' or lang_pred <> '?'").count() == 0
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() >= 12


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "k long")
    for r in df.select("k", remainder(F.col("k"), 7).alias("m"), held_out(F.col("k"), 7).alias("h")).collect():
        assert (r.m, r.h) == ((None, False) if r.k is None else (zlib.crc32(str(r.k).encode()) % 7, zlib.crc32(str(r.k).encode()) % 7 == 2))


def test_purge(spark):
    from millrace.llm import common

    df = common.materialize(frame(spark, [(1, "a")]), "t", arrow_rows=10)
    assert df.count() == 1 and spark.conf.get(common.ARROW_ROWS) == "10000"
    common.purge(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        spark.read.parquet(df._millrace_path).count()


def test_worker_state():
    """A worker keeps one thing from task to task; parts of batches have the batches' rows in order."""
    import pyarrow as pa

    from millrace.llm import textvec

    made = []
    for key in ("a", "a", "b", "a"):
        assert textvec.kept(key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "a"] and list(textvec._kept) == ["a"]
    textvec.fresh()
    assert not textvec._kept
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([f"{b} {i}" if i % 3 else None for i in range(n)], pa.string())}) for b, n in enumerate((5, 0, 4))]
    parts = list(textvec.parts_of(iter(batches), 2))
    assert [p.num_rows for p in parts] == [2, 2, 1, 2, 2]
    assert [x for p in parts for x in p["text"].to_pylist()] == [x for b in batches for x in b["text"].to_pylist()]
    for p in parts:
        raw, at = textvec.text_buffers(p["text"])
        assert [raw[a:z].tobytes().decode() for a, z in zip(at, at[1:])] == [x or "" for x in p["text"].to_pylist()]
