"""Near-duplicates of the pipeline against the exact similarity of their five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tests.llm.test_llm import ODD, prose  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts, least):
    """Keys that stay: the smallest of each component over all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def test_only_similar_texts_are_dropped(spark, monkeypatch):
    import corpus_pipeline as C
    from cityloom.llm import simhash

    r, texts = random.Random(4), []
    for i in range(6):
        words = [f"{w}{k}" for k, w in enumerate(prose(i, 150).split())]
        shuffled = r.sample(words, len(words))  # the same long words and so the same fingerprint, no shingle shared
        texts += [" ".join(words), " ".join(words).upper(), " ".join(shuffled), " ".join(words[:140] + ["new"]), " ".join(w if k % 12 else "x" for k, w in enumerate(words))]
    base = prose(50, 200).split()
    for i in range(30):  # a group of more texts than a block holds
        at = r.randrange(190)
        texts.append(" ".join(base[:at] + ["q", str(i)] + base[at + 2 :]))
    texts += [t for t in ODD if t is not None and t.isascii()]
    monkeypatch.setattr(simhash, "BLOCK", 8)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("other", F.lit(1))
    kept = C.drop_near_duplicates(spark, d, "")
    assert kept.columns == d.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == brute(texts, 0.8)
    assert len(brute(texts, 0.8)) > 20
    again = C.drop_near_duplicates(spark, d.union(d.limit(3)).union(spark.createDataFrame([(None, None, 1)], "doc_id long, text string, other int")), "")
    assert again.count() == kept.count()
