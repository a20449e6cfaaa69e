"""Very long and malformed input, repeated attempts, ties and clashing names."""

import random
import time

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BENCH = [(7, "A train travels sixty kilometres in two hours and then rests beside a quiet northern harbour until the morning mail arrives")]


def long_text(n=1_000_000):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    out = []
    while n > 0:
        out.append(r.choice(words))
        n -= len(out[-1]) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def long_docs(spark):
    text = long_text()
    other = text[: len(text) // 2] + " " + BENCH[0][1] + " " + text[len(text) // 2 :]
    rows = [(1, text, "en"), (2, text, "en"), (3, other, "en"), (4, "x" * 1_000_000, "en"), (5, None, None), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_long_texts_and_repeated_rows(spark, long_docs):
    from cityloom.llm import bpe, decontaminate, imatch, language, quality, simhash, token_records
    from cityloom.session import shared_dir, stored

    n = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(long_docs, VOCABULARY).collect()}
    assert n[1] == n[2] > 200_000 and n[5] == 0
    folder = shared_dir(spark, "long")
    assert {r["doc_id"]: r["n_tokens"] for r in token_records.read_records(token_records.write_records(long_docs, folder, VOCABULARY), folder).collect()} == {k: v + 1 for k, v in n.items()}
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(long_docs).collect()}
    assert near[1] == near[2] == near[3] == 1 and near[5] == 5
    told = language.predict(long_docs, language.fit(long_docs)).collect()
    assert len(told) == 6 and {r["lang_pred"] for r in told if r["doc_id"] in (1, 2, 3)} == {"en"} and {r["lang_pred"] for r in told if r["doc_id"] == 5} == {"und"}
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (4, 0), (5, None)], "doc_id long, quality int")
    scored = quality.score_texts(long_docs, quality.fit(quality.labelled_texts(long_docs, labels))).collect()
    assert len(scored) == 6 and len({r["score"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    hit = {r["doc_id"]: r["contaminated"] for r in decontaminate.marked(long_docs, spark.createDataFrame(BENCH * 2, "item_id long, text string")).collect()}
    assert hit == {1: False, 2: False, 3: True, 4: False, 5: False}
    signed = imatch.fingerprints(long_docs, stored(imatch.lexicon(long_docs), "long-lexicon")).collect()
    assert len(signed) == 6 and len({tuple(r["signature"]) for r in signed if r["doc_id"] in (1, 2)}) == 1


PATHOLOGICAL = {"div": "<div>", "font": "<font>", "link": "<a ", "quote": '<a "', "value": '<p class="x', "item": "<ul><li>", "cell": "<table><tr><td>", "article": '<article class="ad">', "comment": "<!--", "end": "</p", "weak": '<div class="related-work">'}


@pytest.mark.parametrize("name", PATHOLOGICAL)
def test_malformed_pages_take_linear_time(name):
    from cityloom.llm.html_text import extract, vote

    part = PATHOLOGICAL[name]
    took = []
    for size in (100_000, 400_000):
        page = part * (size // len(part)) + "<p>text at the end</p>"
        began = time.process_time()
        vote(page), extract(page, None)
        took.append(time.process_time() - began)
    assert took[1] < 4 and took[1] < 12 * max(took[0], 0.02)


def test_forms_and_layout_names_around_the_page_are_no_asides():
    from cityloom.llm.html_text import extract

    p = "<p>The harbour was quiet in the morning and the boats lay still upon the water, as they had for years.</p>"
    text = "\n\n".join([p[3:-4]] * 3)
    pages = [
        f'<form id="aspnetForm" action="x"><input name="q"><div id="c">{p * 3}</div><button>Go</button></form>',
        f'<div class="page-with-sidebar"><div class="text">{p * 3}</div><div class="sidebar"><a href="/x">Home</a> words beside</div></div>',
        f'<form><div class="no-sidebar layout"><div class="text">{p * 3}</div></div><select><option>One</option></select></form>',
        f'<div class="text">{p * 3}</div><form><p>Sign in with name and address, or register for our letters, which come each week.</p></form>',
        f'<form role="search"><p>Search here</p></form><div class="text">{p * 3}</div>',
    ]
    for page in pages:
        assert extract(f"<html><body>{page}</body></html>", None)[0] == text, page
    long_comments = f'<div class="text">{p * 3}</div><div class="comments-area">{p * 40}</div><form class="comment-form">{p * 40}</form>'
    assert extract(long_comments, None)[0] == text


@pytest.mark.parametrize("name", PATHOLOGICAL)
def test_links_of_malformed_pages_take_linear_time(spark, name):
    from cityloom.llm.url_filter import host_edges

    page = PATHOLOGICAL[name] * (1_000_000 // len(PATHOLOGICAL[name])) + '<a class="x" href="https://Other.org/a">'
    df = spark.createDataFrame([("http://here.org/", page), ("http://here.org/2", '<a title="1 &lt; 2" href=//third.org>')], "url string, html string")
    began = time.time()
    got = {(r["src"], r["dst"]) for r in host_edges(df).collect()}
    assert time.time() - began < 20 and got >= {("here.org", "third.org")}


def test_no_markup_is_left_and_hosts_decide_on_weak_names(spark):
    from cityloom.llm.html_text import extract, main_text

    assert extract('<div class="content"><p class="x>First para</p><p class="y">Second</p></div>', None)[0] == "First para\n\nSecond"
    assert extract("<body><p title='a > b'>Kept</p><p data-class=ad>Too</body>", None)[0] == "Kept\n\nToo"
    r = random.Random(3)
    sentence = lambda n: " ".join(r.choice(["stone", "river", "lamp", "winter", "paper", "cloud"]) for _ in range(n)).capitalize() + "."
    bar = "Tell your friends about this page and about all the other pages that we have written for you, every day anew."
    rows, want = [], {}
    for i in range(8):
        lead, own = sentence(40), sentence(30)
        page = f'<html><body><nav><a href=/>Home</a></nav><div class="content"><p>{lead}</p><div class="share-of-market"><p>{own}</p></div><div class="share-with-friends"><p>{bar}</p></div><div class="related-posts"><a href=1>{sentence(9)}</a><a href=2>{sentence(9)}</a></div><div class="comments"><p>{sentence(30)}</p></div></div></body></html>'
        rows.append((i, f"http://host/{i}", page))
        want[i] = f"{lead}\n\n{own}"
    frame = spark.createDataFrame(rows + rows[:1] + [(9, None, None)], "page_id long, url string, html string").withColumn("_kept", F.lit(1))
    got = main_text(frame).collect()
    assert len(got) == 10 and {x["page_id"]: x["text"] for x in got} == want | {9: ""}


def test_a_repeated_attempt_changes_nothing_that_is_read(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    from cityloom.llm import token_records, warc

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    folder = f"file://{tmp_path}"
    rows = [(i, f"u{i}", f"<p>page {i}" + "x" * 200, 210, f"d{i}", None, False) for i in range(20)]
    batch = lambda r: pa.RecordBatch.from_pylist([dict(zip(("page_id", "url", "html", "size", "digest", "refers_to", "revisit"), x)) for x in r], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("revisit", pa.bool_())]))
    monkeypatch.setattr(warc, "TaskContext", Task)
    monkeypatch.setattr(token_records, "TaskContext", Task)
    first = [x for b in warc._write(iter([batch(rows)]), folder=folder, date="1970-01-01T00:00:00Z") for x in b.to_pylist()]
    list(warc._write(iter([batch(rows[::-1])]), folder=folder, date="1970-01-01T00:00:00Z"))  # a later attempt, rows in another order
    for x in first:
        with open(f"{tmp_path}/archives/{x['file']}", "rb") as f:
            f.seek(x["offset"])
            fields, _, payload = warc.parse(f.read(x["length"]))
        assert int(fields["WARC-Page-ID"]) == x["page_id"] and payload.decode().startswith(f"<p>page {x['page_id']}x")
    texts = [(i % 3, f"text number {i}") for i in range(12)]
    names = ["shard", "file", "row", "doc_id", "offset", "length", "n_tokens"]
    part = lambda r: pa.RecordBatch.from_pylist([{"doc_id": k, "text": t} for k, t in r], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    write = lambda r: [x for b in token_records._write(iter([part(r)]), folder=folder, vocabulary=VOCABULARY, end_id=2, names=names) for x in b.to_pylist()]
    one, two = write(texts), write(texts[::-1])
    assert {x["file"] for x in one}.isdisjoint(x["file"] for x in two)
    index = spark.createDataFrame([tuple(x[n] for n in names) for x in one], "shard int, file string, row long, doc_id long, offset long, length long, n_tokens long")
    assert token_records.read_records(index, folder).count() == 12


def test_clashing_names_stay(spark):
    from cityloom.llm import imatch, quality, url_filter
    from cityloom.session import stored

    d = spark.createDataFrame([(i, f"some words number {i} of a text", 1, 2, 3, 4, 5, "s") for i in range(9)], "doc_id long, text string, _n int, _slots int, _block int, _last int, _head int, stats string")
    signed = imatch.fingerprints(d, stored(imatch.lexicon(d), "clash-lexicon"))
    assert set(d.columns) < set(signed.columns)
    after = imatch.with_next(signed, "doc_id", ["text"], 3)
    assert set(signed.columns) | {"next_text"} == set(after.columns) and {r["_block"] for r in after.collect()} == {3}
    assert quality.document_statistics(d, ["doc_id", "stats"]).columns == ["doc_id", "stats"] and quality.document_statistics(d, ["_n"]).count() == 9
    p = spark.createDataFrame([(1, "http://a.org/x", None, "k", "q")], "page_id long, url string, html string, path string, _match string")
    assert url_filter.judged(p, [url_filter.rule("allow", "org/")], ["page_id", "path", "_match"]).first().asDict() == {"page_id": 1, "_match": "q", "host": "a.org", "path": "/x", "rule": "org/", "verdict": "allow", "by": "rule"}
    assert url_filter.judged(p.limit(0), [], ["page_id"]).count() == 0


def test_ties(spark):
    from cityloom.llm import language, quality

    d = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(d, language.fit(d)).collect()} == {"a"}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_texts(d, quality.fit(quality.labelled_texts(d, one))).collect()} == {1.0}


def test_few_labels_are_chosen_where_there_are_many(spark):
    from cityloom.llm import quality

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    n = quality.labelled_texts(d, d.select("doc_id", F.lit(1).alias("quality")), most=500).count()
    assert 400 < n < 600


def test_language_stage_drops_what_no_learned_language_resembles(spark):
    import corpus_pipeline as C

    r = random.Random(2)
    english = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews under moonlit towers".split()
    rows = [(i, " ".join(r.choice(english) for _ in range(n)), "en", "s", 1) for i, n in enumerate([1, 2, 3, 5, 9, 30, 200] * 3)]
    other = ["Привет мир как дела сегодня " * 9, "qzxvkj wqpzx jkvqz xqzwv kjzq vxwk " * 6, "12345 !!!", "", None]
    docs = spark.createDataFrame(rows + [(100 + i, t, None, "s", 1) for i, t in enumerate(other)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in C.keep_language(spark, docs, "").collect()}
    assert kept == {x[0] for x in rows}
    assert C.keep_language(spark, docs.limit(0), "").count() == 0
