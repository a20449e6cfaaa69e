"""Corpus pipeline: quality, language, near-duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
and all but the last return rows of `documents` with all their columns, further
ones that a table has included.  A null text counts as empty everywhere.
Repeated rows are judged alike by quality, language and decontamination; the
near-duplicate stage keeps one of them.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import bpe, decontaminate, language, quality, simhash
from cityloom.llm.queries import vocabulary
from cityloom.session import fresh, stored, table

#: A document is kept with at least this probability of good quality.
MIN_QUALITY = 0.3
#: Bits in which long-word fingerprints of texts that are compared differ at most, and the share of shingles that near-duplicates have in common.
MAX_BITS, MIN_SHARED = 7, 0.8
#: A text of n characters is in no learned language if its cosine with each is below MIN_COSINE n / (n + HALF_CHARS): the shorter a text, the further it may stray.
MIN_COSINE, HALF_CHARS = 0.2, 100.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones (quality.MAX_LABELLED of them at most), doesn't reject.

    Empty texts are scored like others; without labels all documents stay.
    """
    model = quality.fit(stored(quality.labelled_texts(docs, table(spark, sf_dir, "labels")), "quality-labelled"))
    (score,) = fresh(docs, "_score")
    return quality.score_texts(docs, model, out=score).filter(F.col(score) >= MIN_QUALITY).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with letters whose letter sequences resemble a learned one's.

    Empty texts and texts without a letter go.  Where no document has a language nothing can be told and all stay.
    """
    model = language.fit(docs)
    if not model:
        return docs
    lang, cosine = fresh(docs, "_lang", "_cosine")
    told = language.predict(docs, model, out=(lang, cosine))
    n = F.char_length("text")
    near = F.col(cosine) >= MIN_COSINE * n / (n + HALF_CHARS)
    return told.filter((F.col(lang) != language.UNDETERMINED) & near).drop(lang, cosine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Texts that share at least 0.8 of their five-word shingles differ in up to 14
    bits of a shingle fingerprint, more than deletion variants can index, but in
    few bits of a fingerprint over distinct long words, which unrelated texts
    miss by 18 bits and more.  So that fingerprint finds the texts to compare,
    and the exact share of shingles links them.  Empty texts are one another's
    copies; rows with a null doc_id stay only where no other row is like them.
    """
    return simhash.representatives(docs, width=None, distance=MAX_BITS, least=MIN_SHARED)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; empty ones have none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the text decoded from them; an empty text has no ids."""
    return bpe.round_trip(docs, vocabulary(), ids=True)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("tokens", to_tokens),
]

#: Classifiers, fingerprints and tokenisers aren't expressible in SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
