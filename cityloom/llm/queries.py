"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.session import shared_dir, stored, table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import token_records as tr

    folder = shared_dir(spark, "token-records")
    index = tr.write_records(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=2)
    back = tr.read_records(index, folder, ids=False)
    return tr.with_start(back).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import warc

    folder = shared_dir(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    back = warc.read_archives(index, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op4_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4)


@query
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import imatch

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slots = stored(imatch.lexicon(docs), "imatch-lexicon")
    signed = imatch.fingerprints(docs, slots)
    pairs = imatch.with_next(signed, "doc_id", ["text", "signature"])
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = pairs.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)))
    both = imatch.fingerprints(edited.drop("text", "next_text"), slots, "edited", "edited_signature")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), imatch.as_text(F.col("signature")).alias("fingerprint"), imatch.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        imatch.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), imatch.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import decontaminate

    return decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "coverage", "run", "template")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import language

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    stats = stored(quality.document_statistics(docs, ["doc_id"]), "quality-statistics").withColumn("held_out", held_out)
    model = quality.fit(stored(quality.labelled(stats.filter(~held_out), labels), "quality-labelled"))
    scored = quality.score(stats, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import html_text

    text = html_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return text.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm.url_filter import judged, rule

    rules = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]
    return judged(table(spark, sf_dir, "pages"), rules, ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def tiled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the digest of its id, from some word on overwritten by repetitions of what stands there."""
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import periodic

    return periodic.with_runs(table(spark, sf_dir, "documents"), ["doc_id"], edit=tiled)


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = toxicity.fit(toxicity.labelled_texts(marked.filter(~F.col("held_out")), labels))
    scored = toxicity.score_texts(marked, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.llm import hard_negatives

    key, label = F.col("vec_id"), F.col("label")
    label = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), label=label, anchor=key % 50 == 0, scale=256.0)


ORACLE_SQL["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
