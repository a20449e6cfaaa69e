"""Periodic runs, hard negatives and toxicity against plain re-computations, and their edge cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# ---- periodic runs


def brute_runs(words, least=12):
    found = {}
    for d in range(1, len(words) // 2 + 1):
        u = 0
        while u < len(words) - d:
            v = u
            while v < len(words) - d and words[v] == words[v + d]:
                v += 1
            if v > u and v + d - u >= max(least, 2 * d):
                found.setdefault((u, v + d), d)
            u = v + 1
    return sorted((u, e - u, d) for (u, e), d in found.items())


def repetitive(r):
    n = r.choice([5, 12, 13, 20, 40, 80, 200, 500])
    a = [r.randrange(r.choice([1, 2, 3, 5, 30])) for _ in range(n)]
    for _ in range(r.randrange(4)):
        s, p = r.randrange(n), 1 + r.randrange(max(1, n // 3))
        for i in range(s, min(n, s + r.randrange(n))):
            a[i] = a[s + (i - s) % p]
    return a


@pytest.mark.parametrize("least", [2, 7, 12, 30, 300])
def test_runs_equal_brute_force(least):
    from cityloom.llm.periodic import find_runs

    r = random.Random(least)
    for _ in range(150):
        a = repetitive(r)
        assert find_runs(np.array(a), least) == brute_runs(a, least)


def fibonacci(n):
    x, y = [0], [0, 1]
    while len(y) < n:
        x, y = y, y + x
    return y


@pytest.mark.parametrize("name", ["ones", "two", "thirds", "copies", "fibonacci"])
def test_repetitive_texts_stay_near_linear(name):
    from cityloom.llm.periodic import find_runs

    n = 60_000
    a = {"ones": np.zeros(n, int), "two": np.arange(n) % 2, "thirds": np.arange(n) % (n // 3), "copies": np.repeat(np.arange(n // 50), 50), "fibonacci": np.array(fibonacci(n))}[name]
    began = time.process_time()
    runs = find_runs(a)
    assert time.process_time() - began < 20
    if name in ("ones", "two", "thirds"):
        assert runs == [(0, n, {"ones": 1, "two": 2, "thirds": n // 3}[name])]
    if name == "copies":
        assert runs == [(50 * i, 50, 1) for i in range(n // 50)]


def test_block_of_each_period_lies_in_every_run():
    from cityloom.llm.periodic import block_length, scales

    for least in (2, 7, 12, 30, 301):
        steps = scales(4000, least)
        assert [q for _, near, far in steps for q in range(near, far + 1)] == list(range(1, 2001))
        for b, near, far in steps:
            for q in range(near, far + 1):
                assert 2 * b - 1 <= max(least - q, q) < 4 * b - 1 and b == block_length(q, least)


def test_periodic_runs_of_the_table(spark):
    from cityloom.llm.queries import op11_periodic_runs

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs = brute_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        if runs:
            s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, length, q, 1000 * length // q)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4


def test_periodic_runs_edges(spark):
    from cityloom.llm.periodic import with_runs

    tie = "a " * 12 + "x y " + "b " * 12
    rows = [(1, None, "p", 7), (2, "", "p", 7), (None, "w " * 30, "p", 7), (4, tie, "p", 7), (4, tie, "p", 7), (5, " \t\n w", "p", 7), (6, "q " * 400_000, "p", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, _key int")
    got = with_runs(df, df.columns, texts=True).collect()
    assert len(got) == 7 and got[0]["_key"] == 7 and sum(r["doc_id"] == 4 for r in got) == 2
    by = {r["doc_id"]: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1]["n_runs"] == by[2]["n_runs"] == 0 and by[1]["collapsed_sha256"] == by[1]["runs_sha256"] == empty and by[1]["length"] is None
    assert by[None]["length"] == 30 and by[None]["period"] == 1 and by[None]["collapsed"] == "w"
    assert (by[4]["start"], by[4]["length"], by[4]["n_runs"], by[4]["collapsed"]) == (0, 12, 2, "a x y b")
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 12, 1), (14, 12, 1)]
    assert by[6]["length"] == 400_000 and by[5]["collapsed"] == "w"
    assert with_runs(df.limit(0), ["doc_id"]).count() == 0


# ---- hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """rows: (key, label, whole vector)."""
    out = []
    for i, (k, label, v) in enumerate(rows):
        if not is_anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for n, (j, m, w) in enumerate(rows) if n != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = [x for x in sorted(scored) if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(k, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(seed, n=900, width=6):
    r = np.random.default_rng(seed)
    centres = r.integers(-60, 60, (7, width))
    which = r.integers(0, 7, n)
    which[: n // 3] = 0  # a hot cluster
    x = centres[which] + r.integers(-12, 12, (n, width))
    x[: n // 6] = x[0]  # with many copies
    return [(int(k), int(r.integers(0, 4)), x[k].tolist()) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    from cityloom.llm import hard_negatives as hn

    monkeypatch.setattr(hn, "LEAST_ROWS", 64)
    rows = clustered(seed)
    df = spark.createDataFrame([(k, m, [float(a) for a in v]) for k, m, v in rows], "vec_id long, label int, embedding array<double>").repartition(5)
    got = hn.mined(df, anchor=F.col("vec_id") % 10 == 0, scale=0).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda k: k % 10 == 0)


def test_brackets_hold_and_prune(spark):
    from cityloom.llm import hard_negatives as hn

    rows = clustered(4)
    x = np.array([v for _, _, v in rows], float)
    norm = float(np.sqrt((x * x).sum(1).max())) * (1 + 1e-12)
    chosen = x[[0, 400, 600, 800]]
    pivots = hn.Pivots(chosen, np.sqrt(np.maximum(norm**2 - (chosen * chosen).sum(1), 0)), norm, x.shape[1], "<f8")
    away, towards = pivots.of_rows(x), pivots.of_anchors(x)
    d = pivots.reach(x, x @ x.T)
    assert (np.abs(towards[:, None] - away[None]).max(2) <= d + 1e-6 * norm).all() and (d <= (towards[:, None] + away[None]).min(2) + 1e-6 * norm).all()
    # a radius that clusters have within leaves less than all
    assert (np.abs(towards[:, None] - away[None]).max(2) <= np.median(d) / 2).mean() < 0.8


def test_hard_negatives_edges(spark):
    from cityloom.llm import hard_negatives as hn

    schema = "vec_id long, label int, embedding array<float>, uid string, cell int, away int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.75, 0.0]), (3, 2, [0.75, 0.0]), (4, 2, [0.5]), (5, 2, [0.25, 9.0])]
    broken = [(6, None, [1.0, 0.0]), (7, 1, None), (8, 2, [nan, 0.0]), (9, 2, [inf, 0.0]), (10, 2, [None, 0.0]), (None, 2, [0.75, 0.0])]
    df = spark.createDataFrame([(*r, "u", 1, 2) for r in rows + broken], schema)
    got = sorted(tuple(r) for r in hn.mined(df, anchor=F.col("vec_id") == 0).collect())
    one = 256 * 256
    # both copies of row 1 are positives; equal scores go by key; the short vector is filled up with zeros
    want = [(0, 1, rank, n, one, int(s * one)) for rank, n, s in ((1, 2, 0.75), (2, 3, 0.75), (3, 4, 0.5))]
    assert got == sorted(want * 2)
    assert hn.mined(df.limit(0), anchor=F.col("vec_id") == 0).count() == 0
    assert hn.mined(df.filter("label is null"), anchor=F.col("vec_id") == 0).count() == 0
    assert hn.mined(df, anchor=F.lit(None).cast("boolean")).count() == 0
    big = spark.createDataFrame([(0, 1, [1e8, 3.0]), (1, 1, [1e8, 2.0]), (2, 2, [7e7, 1.0])], "vec_id long, label int, embedding array<double>")
    (r,) = hn.mined(big, anchor=F.col("vec_id") == 0, scale=0).collect()
    assert (r["positive_score"], r["negative_score"], r["negative_id"]) == (10**16 + 6, 7 * 10**15 + 3, 2)
    beyond = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [7e29])], "vec_id long, label int, embedding array<double>")
    assert hn.mined(beyond, anchor=F.col("vec_id") == 0, scale=0).count() == 0


# ---- toxicity


def labelled_docs(seed=5, n=600):
    r = random.Random(seed)
    plain = ["".join(r.choice("abdehnortu") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(20, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(1, len(words)), r.choice(["zlorgish", "Zl0rgish", "kweb" + r.choice(plain), "mucky"]))
        elif i % 7 == 0:
            words.insert(r.randrange(1, len(words)), "mucky pup")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_folding():
    from cityloom.llm.toxicity import folded

    plain = folded("stupid loser scum")
    for other in ("STUPID Loser SCUM", "stup1d l0ser $cum", "ѕtuрid lоѕеr ѕсum", "ｓｔｕｐｉｄ ｌｏｓｅｒ ｓｃｕｍ", "stu​pid lo­ser s\u0336cum", "stup!d Ioser, scum."):
        assert folded(other) == plain, other
    assert folded("schön schon") == ["schön", "schon"]  # letters with accents are letters of their own
    assert folded("in 1995, 300 of them") == ["in", "1995", "300", "of", "them"]
    assert folded(None) == folded(" ..!? ") == []


def test_toxicity_learns_words_stems_and_exceptions(spark):
    from cityloom.llm import toxicity

    docs, labels = labelled_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    train = spark.createDataFrame([x for x in labels if x[0] < 450], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_texts(df, train))
    assert {"ziorgish ", "kweb"} <= set(model.terms) and model.exceptions == ["mucky pup"]
    assert "mucky " in model.terms  # without the exception clean documents would outweigh it
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(df, model, ["doc_id"]).collect()}
    wrong = [i for i, toxic in labels[450:] if (got[i] >= 0.7) != bool(toxic)]
    assert not wrong
    odd = ["zlorgish", "such a ZLORG1SH thing", "kwebling", "kweb", "a mucky pup came", "mucky Pup. mucky pup", "", None, "zlorgishness"]
    odd = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    flags = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score_texts(odd, model).collect()}
    assert flags == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False}


def test_copies_of_a_document_prove_nothing(spark):
    from cityloom.llm import toxicity

    docs, labels = labelled_docs(9)
    text = " ".join(f"onlyhere{chr(97 + i)}" for i in range(20))
    docs += [(1000 + i, text) for i in range(40)]
    labels += [(1000 + i, 1) for i in range(40)]
    model = toxicity.fit(toxicity.labelled_texts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert "ziorgish " in model.terms and not any(t.startswith("oniyhere") and t != "oniyhere" for t in model.terms)


def test_toxicity_edges(spark):
    from cityloom.llm import toxicity

    docs = spark.createDataFrame([(1, "some text", 5), (1, "some text", 5), (2, None, 5), (None, "x" * 1_000_000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_texts(docs, toxicity.fit(toxicity.labelled_texts(docs, none))).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_texts(docs, toxicity.fit(toxicity.labelled_texts(docs, nulls))).collect()} == {0.5}
    alike = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, toxic int")
    got = toxicity.score_texts(docs, toxicity.fit(toxicity.labelled_texts(docs, alike))).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {1.0}
    model = toxicity.fit(toxicity.labelled_texts(docs, none), {"rotten": 4.0, "slim*": 5.0}, ["rotten apple"])
    found = toxicity.score_texts(spark.createDataFrame([("Rotten s1ime", 1), ("a rotten apple, slim", 1)], "text string, hits int"), model, matches="hits").collect()
    assert [r["hits"] for r in found] == [["rotten", "siim"], ["siim"]]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    assert toxicity.fit(toxicity.labelled_texts(docs.limit(0), alike)).values == [0.5]


def test_toxicity_held_out(spark):
    from cityloom.llm.queries import op13_toxicity

    got = op13_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    clean = [r for r in got if r["toxic"] == 0]
    caught = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean) and sum(r["predicted"] for r in caught) >= 0.7 * len(caught)
