"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [w for w in "the quick brown fox jumps over lazy dogs while seven wizards mix potent brews under moonlit towers beside rivers that wander through ancient valleys full of whispering reeds and silver stones where travellers rest before dawn".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "é中😀 x", "<|endoftext|>mid<|endoftext|>", "x" * 4000, "a b " * 2000, "I'll  don't", "\u3000\x85 z", "Same text", "Same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", 1.0, 7) for i, t in enumerate(ODD)] + [(None, "no key", "extra", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, score double, _fp int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def by_key(rows, key="doc_id"):
    return sorted(rows, key=lambda r: (r[key] is None, r[key] or 0))


# 2: BPE


def test_bpe_equals_the_library(tokenizer):
    from cityloom.llm.bpe import PairIndexBpe

    r = random.Random(1)
    parts = ["a", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "é", "ß", "1", "23", "'s", "'S", "!", "<|endoftext|>", "\0", "中", "😀", "\u200d", "x", " b", "\r\n", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)] + [t or "" for t in ODD]
    codec = PairIndexBpe(VOCABULARY)
    ids, size = codec.encode(texts)
    at = 0
    for text, n, want in zip(texts, size.tolist(), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == want.ids, repr(text)
        assert codec.decode(want.ids) == tokenizer.decode(want.ids, skip_special_tokens=False)
        at += n


def test_bpe_frames(docs, empty, tokenizer):
    from cityloom.llm import bpe

    got = by_key(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, out="back").collect())
    for r in got:
        assert r["back"] == (r["text"] or "") and r["ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids and r["score"] == 1.0
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        assert r["decoded_sha256"] == hashlib.sha256(next((x["text"] or "" for x in got if x["doc_id"] == r["doc_id"])).encode()).hexdigest()
    assert bpe.round_trip(empty, VOCABULARY).count() == 0


# 7: token records


def test_token_records_round_trip(spark, docs, empty, tokenizer):
    from cityloom.llm import token_records as tr
    from cityloom.session import shared_dir

    folder = shared_dir(spark, "t7")
    index = tr.write_records(docs, folder, VOCABULARY, shards=3)
    rows = by_key(tr.with_start(tr.read_records(index, folder)).collect())
    start = 0
    rows = [rows[-1], *rows[:-1]]  # null keys come first
    texts = {None: "no key"} | dict(enumerate(ODD))
    for r in rows:
        want = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert r["ids"] == want and r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    some = tr.read_records(index.filter("doc_id % 5 = 2").orderBy(F.desc("offset")), folder)  # any order, any selection
    assert sorted(r["doc_id"] for r in some.collect()) == [2, 7, 12]
    assert tr.with_start(tr.read_records(tr.write_records(empty, shared_dir(spark, "t7e"), VOCABULARY), folder)).count() == 0
    with pytest.raises(ValueError):
        data = bytearray(tr.frame(b"payload"))
        data[14] ^= 1
        tr.unframe(bytes(data), 0)


# 3: SimHash


def brute_components(keys, prints, distance):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min(k, least.get(find(i), k))
    return [least[find(i)] for i in range(len(keys))]


def test_simhash_components(spark, docs, empty):
    from cityloom.llm import simhash

    r = random.Random(2)
    base = [prose(i, 300) for i in range(12)]
    texts = []
    for b in base:
        texts += [b, b] + [" ".join(w if r.random() > 0.002 else "zz" for w in b.split()) for _ in range(50)]
    texts += [t for t in ODD]
    keys = list(range(100, 100 + len(texts)))
    got = by_key(simhash.near_duplicates(spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string")).collect())
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 4), simhash.bit_table()) for t in texts]
    assert [x["fingerprint"] for x in got] == [f"{p:016x}" for p in prints]
    assert [x["component_id"] for x in got] == brute_components(keys, prints, 4)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(docs.union(docs))  # repeated rows: one stays
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 13 not in ids and 12 in ids


def test_simhash_fingerprint_by_definition():
    import xxhash

    from cityloom.llm import simhash

    for text in ("One two  THREE\tfour\x0bfive ünï", "a b", "", "x " * 50):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(simhash.shingle_hashes(text, 4), simhash.bit_table()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# 4: WARC


def test_warc(spark):
    from cityloom.llm import warc
    from cityloom.session import shared_dir

    big = "<p>" + "page " * 100
    rows = [(1, "http://a/\n1", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "http://é", None), (6, "x", big + "2"), (7, "x", ""), (None, "y", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    folder = shared_dir(spark, "t4")
    index = warc.write_archives(pages, folder)
    got = by_key(warc.read_archives(index, folder).collect(), "page_id")
    for r, (page, url, html) in zip(got, rows):
        html = html or ""
        again = page in (2, None)
        assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (page, len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"], r["payload"]) == (("revisit", 1, None) if again else ("response", None, html))
        assert r["url"] == (url.replace("\n", "%0A") if url else None)
    assert [r["page_id"] for r in warc.read_archives(index.filter("page_id = 6"), folder).collect()] == [6]
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_dir(spark, "t4e")), folder).count() == 0


# 1: HTML


PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header class="site"><h2>Site</h2></header><nav><a href=/>Home</a></nav>
<div id="wrap"><div class="cookie-notice">We use cookies</div><main><article class="post-{n}"><header><h1>Big &amp; Title</h1><span>by me</span></header><p>First   para&nbsp;one<br>two <b>bold<p>Second <a href="x">link</a> text number {n} with more words.<ul><li>a<li>b</ul><div class="ad">Buy</div><aside>Side</aside>
<form><input name=q>Search</form></article><section class="comments"><p>User says hi a lot, really a lot of long things here.</p></section></main><div class="sidebar"><p>Popular</p></div></div><footer>(c)</footer></body></html>"""


def test_html(spark):
    from cityloom.llm import html_text

    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(10, None, None), (11, "u", ""), (12, "u", "no tags at all"), (13, "u", "<p>a<p>b"), (14, "u", "<script>x"), (15, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_winner", F.lit(1))
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Big & Title\n\nFirst para one two bold\n\nSecond link text number {i} with more words.\n\na\n\nb"
        assert got[i]["text_path"] == "/html/body/div/main/article.post-"
    assert [got[i]["text"] for i in range(10, 16)] == ["", "", "no tags at all", "a\n\nb", "", "deep"]
    assert html_text.main_text(pages.limit(0)).count() == 0


# 5: URLs


def test_url_filter(spark):
    from cityloom.llm.url_filter import judged, propagated, rule

    rules = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]
    rows = [
        (1, "http://a.net/x", '<a href="http://Bad.example.com/de/1">x</a>', "", "", None, "block"), (2, "http://b.net/", "<A class=x HREF=//good.org/>y</a>", "", "", None, "allow"), (3, "http://good.org/1", "", "", "", "org/", "allow"),
        (4, "http://bad.example.com/de/9", None, "", "", "com/de/", "block"), (5, None, None, "", "", None, "allow"), (6, "nourl", "", "", "", None, "allow"), (7, "x://H.Example.ORG/en/12?q#f", "", "", "", "example.org/en/1", "block"),
        (8, "http://org", "", "", "", None, "allow"), (9, "http://com/fr/", "", "", "", "com/fr/", "allow"), (10, "http://xorg/es/", "", "", "", None, "allow"), (11, "http://example.org/es/x", "", "", "", "example.org/es/", "block"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged(pages, rules, ["page_id"]).collect()}
    assert got == {r[0]: (r[5], r[6]) for r in rows}
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0)], "src string, dst string, links double")
    rank = {r["host"]: r["rank"] for r in propagated(e, spark.createDataFrame([("a", 1.0)], "host string, seed double")).collect()}
    # c leads nowhere: what reaches it starts again at a
    a = 1 / (1 + 0.85 / 4 + 0.85 * 0.75 + 0.85**2 / 4)
    assert rank["a"] == pytest.approx(a, abs=1e-3) and rank["b"] == pytest.approx(a * 0.85 / 4, abs=1e-3) and rank["c"] == pytest.approx(a * (0.85 * 0.75 + 0.85**2 / 4), abs=1e-3) and sum(rank.values()) == pytest.approx(1)


# 6: language


def test_language(spark, docs, empty):
    from cityloom.llm import language

    syllables = {"aa": "ka lo mi tu re sa".split(), "bb": "zh kr ösch nt gro ß".split(), "cc": "ции при ост ать".split()}
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(60)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d.filter("doc_id % 4 <> 2"))
    got = language.predict(d.filter("doc_id % 4 = 2"), model).collect()
    assert np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.98 and all(0 <= x["score"] <= 1 for x in got)
    odd = {x["doc_id"]: x for x in language.predict(docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and odd[3]["lang_pred"] != "und" and odd[3]["_text"] == "extra"
    assert language.fit(empty) == {} and language.predict(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_language_vectors_are_bound_and_bundled():
    from cityloom.llm.language import Hypervectors

    h = Hypervectors(64)
    code, count = h.trigrams("Ab  ab!")  # " ab ab "
    v = h.bundle(code, count)
    want = np.zeros(64)
    for t in (" ab", "ab ", "b a", " ab", "ab "):
        n = [h.number[ord(c) if c != " " else 0] for c in t]
        want += h.letters[0][n[0]].astype(int) * h.letters[1][n[1]] * h.letters[2][n[2]]
    assert (v == want).all() and h.trigrams("12 !") is None


# 9: quality


def test_quality(spark, docs, empty):
    from cityloom.llm import quality

    r = random.Random(9)
    good = [(i, prose(i, r.randrange(30, 200)).capitalize() + ".", 1) for i in range(0, 600, 2)]
    bad = [(i, (prose(i, 60).upper().replace(" ", "!! ") if i % 4 == 1 else "spam " * r.randrange(20, 100)), 0) for i in range(1, 600, 2)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    stats = quality.document_statistics(d, ["doc_id"])
    model = quality.fit(quality.labelled(stats.filter("doc_id % 5 <> 0"), d.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))))
    got = quality.score(stats.filter("doc_id % 5 = 0"), model, ["doc_id"]).collect()
    assert np.mean([(x["score"] >= 0.3) == (x["doc_id"] % 2 == 0) for x in got]) > 0.97
    odd = quality.score_texts(docs, model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= x["score"] <= 1 for x in odd)
    none = quality.fit(quality.labelled(quality.document_statistics(empty, ["doc_id"]), d))
    assert {x["score"] for x in quality.score_texts(docs, none).collect()} == {0.5}


def test_isotonic_pooling():
    from cityloom.llm.quality import pool

    assert pool(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1])).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 1])


# 8: decontamination


def test_decontamination(spark, docs, empty):
    from cityloom.llm import decontaminate as D

    item = "Tom has 12 apples and gives 5 apples to Anna in 3 hours, how many apples does Tom have left now"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny one"), (1, item)], "item_id long, text string")
    texts = {
        1: ("xx " + item + " yy", [1]), 2: (item.replace("12", "47").replace("5", "9").replace("3 hours", "8 minutes"), [1]), 3: (item.upper(), [1]), 4: ("nothing here at all of the sort", []), 5: (None, []), 6: ("", []),
        7: ("but Lily has 47 apples and gives 47 apples to Bob in 8 minutes, how many apples does Rob have left now", []), 8: ("Tiny ONE!", [4]), 9: (prose(1, 3000) + " " + item + " " + prose(2, 3000), [1]), 10: ("how many apples does", []),
    }
    d = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string").withColumn("run", F.lit("mine"))
    got = {r["doc_id"]: r["item_ids"] for r in D.marked(d, bench).collect()}
    assert got == {k: v for k, (_, v) in texts.items()}
    kept = D.clean(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, v) in texts.items() if not v} and kept.filter("run <> 'mine'").count() == 0
    assert D.marked(empty, bench).count() == 0 and D.marked(docs, bench.limit(0)).filter("contaminated").count() == 0


# 10: I-Match


def test_imatch(spark, docs, empty):
    from cityloom.llm import imatch
    from cityloom.session import stored

    rows = [(i, prose(i, 150)) for i in range(60)] + [(100, prose(3, 150)), (101, " ".join(prose(4, 150).split()[:120]) + " other words"), (102, None), (103, ""), (104, "!!!"), (105, "???")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    slots = stored(imatch.lexicon(d), "lexicon")
    got = {r["doc_id"]: r for r in imatch.fingerprints(d, slots).withColumn("fp", imatch.as_text(F.col("signature"))).collect()}
    assert got[3]["fp"] == got[100]["fp"] and got[102]["fp"] == got[103]["fp"] and len({r["fp"] for r in got.values()}) == len(rows) - 2
    like = lambda a, b: imatch_like(got[a]["signature"], got[b]["signature"])
    assert like(3, 100) == 1 and like(4, 101) > like(4, 5)
    pairs = imatch.with_next(imatch.fingerprints(d, slots), "doc_id", ["text"], 5).collect()
    ids = sorted(got, reverse=True)
    text = dict(rows)
    assert {p["doc_id"]: p["next_text"] for p in pairs} == {k: text[ids[(i + 1) % len(ids)]] for i, k in enumerate(ids)}
    assert imatch.fingerprints(empty, slots).count() == 0 and imatch.with_next(empty, "doc_id", ["text"]).count() == 0
    assert imatch.with_next(docs.select("doc_id", "text"), "doc_id", ["text"], 3).count() == docs.count()


def imatch_like(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    from cityloom.session import stored

    good = [(i, prose(i, 120).capitalize() + ".") for i in range(200)]
    leak = prose(900, 40)
    rows = good + [(300, good[0][1]), (301, " ".join(good[1][1].split()[:-1])), (302, "spam " * 80), (303, good[2][1].split(".")[0][:50] + " " + leak + " and more " + prose(901, 90)), (304, "12 34"), (305, None)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string, run string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 302), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert sorted(docs.columns) == sorted(d.columns)
    kept = {r["doc_id"] for r in docs.collect()}
    assert set(range(200)) <= kept and kept.isdisjoint({300, 301, 303, 304, 305})
    out = C.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == kept
