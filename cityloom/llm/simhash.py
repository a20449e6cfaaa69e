"""SimHash near-duplicates by deletion-variant signatures.

A text's words are maximal runs without ASCII white space after A-Z are
lower-cased; each `width`-word shingle (all words, where there are fewer) is
hashed by XXH64, seed 42, and a fingerprint bit is 1 where it is set in over
half of the hashes.  No words: fingerprint zero, linked like any other.

Two 64-bit fingerprints that differ in at most 2s-1 bits agree, up to one bit,
in one of s segments.  Each distinct fingerprint is indexed under every segment
with one bit taken out, so such a pair meets in an equality join on
(segment, bit taken out, remaining bits); the true distance is then verified.
Within a bucket only enough verified links are kept to connect it (a spanning
forest), so a bucket of m fingerprints yields at most m-1 rows.

Null texts count as empty; a null key is kept as a document without a smaller
neighbour; repeated rows share a fingerprint and so a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.llm.workers import held
from cityloom.operators.components import connected_components
from cityloom.session import cut, fresh, maybe_broadcast, stored

SEED = 42
#: Distinct words of at least so many bytes are the features of the long-word fingerprint, if there are so many.
LONG_WORD, MIN_LONG_WORDS = 5, 24
#: Buckets up to this size are compared by shifted vectors, larger ones by search from seeds; both are exact.
SHIFT_LIMIT = 32
#: Words of a shingle for exact checks, and distinct texts of a block that is checked against another at once.
SHINGLE, BLOCK = 5, 128


def bit_table() -> np.ndarray:
    """Bits of each byte value, most significant first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """Hashes of all word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return [h(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist())]


def long_word_hashes(text: str | None) -> list[int]:
    """Hashes of the distinct words of at least LONG_WORD bytes; of 3-word shingles where fewer than MIN_LONG_WORDS are long."""
    kept = {w for w in (text or "").encode().lower().split() if len(w) >= LONG_WORD}
    return [xxhash.xxh64_intdigest(w, SEED) for w in kept] if len(kept) >= MIN_LONG_WORDS else shingle_hashes(text, 3)


def fingerprint(hashes: list[int], table: np.ndarray) -> int:
    """A bit is 1 where it is set in over half of the hashes; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(n, 8)
    counts = np.bincount((octets + np.arange(0, 2048, 256, dtype=np.uint16)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((counts @ table * 2 > n).ravel()).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], *, width: int | None, name: str) -> Iterator[pa.RecordBatch]:
    table = held("simhash", bit_table)
    features = long_word_hashes if width is None else partial(shingle_hashes, width=width)
    for batch in batches:
        got = np.array([fingerprint(features(t.as_py()), table) for t in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*batch.schema.names[:-1], name])


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", width: int | None = 4, out: str = "_fp") -> DataFrame:
    """The columns `keep` and the fingerprint of each row as a signed 64-bit number.

    Features are shingles of `width` words, or, for None, distinct long words.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(partial(_fingerprints, width=width, name=out), schema)


def segments(count: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, length) of each of `count` nearly equal segments."""
    edge = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def variants(fps: DataFrame, distance: int, fp: str = "_fp") -> DataFrame:
    """(bucket, fp): a row for each segment and bit taken out of it."""
    parts = segments(distance // 2 + 1)
    masks = [(((1 << n) - 1) << low) & ~(1 << (low + i)) for low, n in parts for i in range(n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # xxhash64 of (variant number, remaining bits) names the bucket; a shared name is no error, only a check more
    return fps.select(fp, F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("_v", "_m")).select(F.xxhash64("_v", F.col(fp).bitwiseAND(F.col("_m"))).alias("_bucket"), fp)


def _links(batches: Iterator[pa.RecordBatch], *, distance: int) -> Iterator[pa.RecordBatch]:
    """Verified links within the buckets of a sorted partition."""
    bucket, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        b, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        bucket, fp = np.concatenate([bucket, b]), np.concatenate([fp, f])
        last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last bucket may go on
        if last:
            yield _bucket_links(bucket[:last], fp[:last], distance)
            bucket, fp = bucket[last:], fp[last:]
    if len(bucket):
        yield _bucket_links(bucket, fp, distance)


def _bucket_links(bucket: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    size = hi - lo
    src, dst = [], []
    few = np.repeat((size > 1) & (size <= SHIFT_LIMIT), size)
    b, f = bucket[few], fp[few]
    for step in range(1, int(min(SHIFT_LIMIT, size.max()))):
        near = (b[step:] == b[:-step]) & (np.bitwise_count((f[step:] ^ f[:-step]).view(np.uint64)) <= distance)
        src.append(f[:-step][near])
        dst.append(f[step:][near])
    for i in np.flatnonzero(size > SHIFT_LIMIT):
        rest = np.unique(fp[lo[i] : hi[i]])
        while len(rest):  # grow a cluster from a seed; each member is compared with those not yet reached
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                seed = todo.pop()
                near = np.bitwise_count((rest ^ seed).view(np.uint64)) <= distance
                found = rest[near]
                if len(found):
                    src.append(np.full(len(found), seed))
                    dst.append(found)
                    todo.extend(found)
                    rest = rest[~near]
    a = np.concatenate(src) if src else np.empty(0, np.int64)
    c = np.concatenate(dst) if dst else np.empty(0, np.int64)
    pair = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["src", "dst"])


def links(fps: DataFrame, distance: int = 4, fp: str = "_fp") -> DataFrame:
    """(src, dst) fingerprints at most `distance` bits apart: enough of them to connect all that are."""
    spread = variants(fps, distance, fp)
    dealt = spread.repartition(F.col("_bucket")).sortWithinPartitions("_bucket")
    return dealt.mapInArrow(partial(_links, distance=distance), "src bigint, dst bigint").filter("src <> dst")


def classes(prints: DataFrame, least: Column, distance: int) -> DataFrame:
    """(_fp, component, _least): the component of each fingerprint and the least `least` of each component.

    Exact copies are one fingerprint before anything is compared; components are
    found among distinct fingerprints, never among documents.
    """
    nodes = stored(prints.groupBy("_fp").agg(F.min(least).alias("_own")), "simhash-nodes")
    component = cut(connected_components(links(nodes, distance)).withColumnRenamed("node", "_fp"))
    named = nodes.join(component, "_fp")
    # a row a component of several: measured; beyond the limit adaptive execution splits a giant one
    lowest = maybe_broadcast(stored(named.groupBy("component").agg(F.min("_own").alias("_least")), "simhash-least"), 200)
    alone = nodes.join(component, "_fp", "left_anti")
    return named.join(lowest, "component").select("_fp", "component", "_least").union(alone.select("_fp", F.col("_fp").alias("component"), F.col("_own").alias("_least")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, the smallest key reachable over links."""
    prints = stored(fingerprints(df, [key], text, width), "simhash-prints")
    label = classes(prints, F.col(key), distance).select("_fp", F.col("_least").alias("component_id"))
    return prints.join(label, "_fp").select(key, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(group: pa.Table, *, least: float) -> pa.Table:
    """(src, dst) text hashes h of a group: links of Jaccard similarity `least` and more, enough to connect all that have one."""
    h, first = np.unique(group.column("h").to_numpy(), return_index=True)
    texts = group.column("text").take(pa.array(first)).to_pylist()
    sets = [np.unique(np.array(shingle_hashes(t, SHINGLE), np.uint64)) for t in texts]
    size = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(len(h)), size), np.cumsum(size)
    rest, src, dst = np.ones(len(h), bool), [], []
    while rest.any():  # as in large buckets: what is reached is compared with what isn't
        todo = [int(np.argmax(rest))]
        rest[todo[0]] = False
        while todo and rest.any():
            i = todo.pop()
            mine = np.zeros(len(vocabulary), bool)
            mine[ids[ends[i] - size[i] : ends[i]]] = True
            common = np.bincount(owner[mine[ids]], minlength=len(h))
            either = size + size[i] - common
            found = np.flatnonzero(rest & (np.divide(common, either, out=np.ones(len(h)), where=either > 0) >= least))
            src += [h[i]] * len(found)
            dst += h[found].tolist()
            todo += found.tolist()
            rest[found] = False
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def verified_classes(plain: DataFrame, prints: DataFrame, ident: Column, distance: int, least: float) -> DataFrame:
    """(_least): the least `ident` of each component of texts linked by a Jaccard similarity of `least` over SHINGLE-word shingles.

    Only texts whose fingerprints are in one component are compared, there each
    with each: a component of many texts is cut into blocks, of which every two
    meet in a group of their own.
    """
    label = classes(prints, ident, distance).select("_fp", F.col("component").alias("_c"))
    nodes = stored(prints.join(label, "_fp").groupBy("h", "_c").agg(F.min(ident).alias("_own")), "simhash-texts")
    several = nodes.groupBy("_c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nb"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = stored(nodes.join(maybe_broadcast(stored(several, "simhash-several"), 32), "_c").select(F.col("h").alias("_h"), F.col("_own.k").alias("_k"), "_c", "_nb"), "simhash-members")
    # one row of each text: that of its least key
    texts = plain.join(maybe_broadcast(members, 40), (F.col("h") == F.col("_h")) & F.col("key").eqNullSafe(F.col("_k"))).select("h", "text", "_c", "_nb", F.pmod("h", "_nb").cast("int").alias("_b"))
    met = texts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).filter("_nb = 1 OR _o <> _b").select("h", "text", "_c", F.least("_b", "_o").alias("_b1"), F.greatest("_b", "_o").alias("_b2"))

    def similar(group: pa.Table) -> pa.Table:  # applyInArrow reads the annotations, which partial hides
        return _similar(group, least=least)

    found = connected_components(met.groupBy("_c", "_b1", "_b2").applyInArrow(similar, "src bigint, dst bigint"))
    named = nodes.join(found, F.col("h") == F.col("node"), "left").withColumn("component", F.coalesce("component", "h"))
    return named.groupBy("component").agg(F.min("_own").alias("_least")).select("_least")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", width: int | None = 4, distance: int = 4, least: float | None = None) -> DataFrame:
    """The rows of df, all columns, less near-duplicates: of each component the row with the smallest key.

    Rows are told apart by key and text, so that repeated and null keys lose no
    other document; of rows equal in both one stays.  With `least`, fingerprints
    only tell what to compare: texts are linked by their exact similarity.
    """
    h, n, k, kh = fresh(df, "_h", "_n", "_k", "_kh")
    keyed = df.withColumn(h, F.xxhash64(text))
    plain = keyed.select(F.col(key).alias("key"), F.col(h).alias("h"), F.col(text).alias("text"))
    prints = stored(fingerprints(plain, ["key", "h"], "text", width), "simhash-prints")
    ident = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("h").alias("h"))
    found = classes(prints, ident, distance) if least is None else verified_classes(plain, prints, ident, distance, least)
    kept = found.select(F.col("_least.k").alias(k), F.col("_least.h").alias(kh)).distinct()
    rows = keyed.join(kept, F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col(kh)), "left_semi")
    first = F.row_number().over(Window.partitionBy(key, h).orderBy(F.lit(0)))
    return rows.withColumn(n, first).filter(F.col(n) == 1).drop(n, h)
