"""Token ids as length-delimited binary records with a separate offset index.

A shard file holds a 16-byte header (magic, id width, version) and then frames:

    length  u64, bytes of the payload
    check   u32, masked CRC-32 of the length bytes
    payload ids, little-endian, 2 bytes each where the vocabulary allows it, else 4
    check   u32, masked CRC-32 of the payload

Shards are consecutive ranges of the key, rows ascending within them.  The index
is a Parquet table (shard, file, row, key, offset, length, n_tokens), so that a
reader can fetch records in any order without scanning the shards.  A shard's
file is named by the task attempt that wrote it and the index says which: a
repeated attempt, which may see equal keys in another order, changes nothing
that is read.

Null texts count as empty; null keys come first; repeated keys keep separate
records; an empty table gives an index without rows and no shard.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.llm.pieces import PieceStore, chunks
from cityloom.llm.workers import held
from cityloom.sources.files import attempt_output, open_input

MAGIC, VERSION = b"TOKREC\0\0", 1
HEADER = struct.Struct("<8sII")
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
#: Bytes fetched by one read of neighbouring records, and bytes of text in a shard.
READ_BYTES, SHARD_BYTES = 8 << 20, 256 << 20


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset so that checksums of data holding checksums stay useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = LENGTH.pack(len(payload))
    return b"".join((size, CHECK.pack(masked(size)), payload, CHECK.pack(masked(payload))))


def unframe(data: bytes, at: int) -> bytes:
    """Payload of the frame at this place; raises ValueError if a checksum differs."""
    size = data[at : at + 8]
    if len(size) < 8 or CHECK.unpack_from(data, at + 8)[0] != masked(size):
        raise ValueError(f"damaged record length at {at}")
    n = LENGTH.unpack(size)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or CHECK.unpack_from(data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload


class LibraryTokens(PieceStore):
    """The tokenizers library over distinct pieces, many to a call.

    Pieces stand between special tokens in one long text, so that a call's cost is shared.
    Vocabularies without byte-level pre-tokenisation or special token are encoded text by text.
    """

    #: A call of the library costs more than the pair index does, so more is remembered.
    cache_pieces = 1_200_000

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        plain = [t for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.split = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"] and len(plain) == len(spec["added_tokens"]) > 0
        self.specials = {t["content"]: t["id"] for t in plain}
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        super().__init__()

    def encode_pieces(self, heads: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mark, mark_id = next(iter(self.specials.items()))
        pieces = [*heads, *(" " + p for p in rest)]
        got, sizes = [], []
        for lo in range(0, len(pieces), 4000):
            ids = np.array(self.library.encode_batch_fast([mark.join(pieces[lo : lo + 4000]) + mark], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(ids == mark_id)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            got.append(ids[ids != mark_id])
        return np.concatenate(got), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.split:
            return super().encode(texts)
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))


def library(path: str) -> LibraryTokens:
    return held(("tokenizers", path), lambda: LibraryTokens(path))


def shard_uri(folder: str, file: str) -> str:
    return f"{folder}/shards/{file}"


def _write(batches: Iterator[pa.RecordBatch], *, folder: str, vocabulary: str, end_id: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    tok, shard = library(vocabulary), TaskContext.get().partitionId()
    kind = "<u2" if tok.width == 2 and (end_id or 0) < 1 << 16 else "<u4"
    end = np.array([] if end_id is None else [end_id], kind)
    index = []
    with attempt_output(f"{folder}/shards", f"{shard:06d}", ".tokrec") as (file, out):
        out.write(HEADER.pack(MAGIC, np.dtype(kind).itemsize, VERSION))
        at, row = HEADER.size, 0
        batch: pa.RecordBatch | None = first
        while batch is not None:
            for lo, part in chunks(batch.column(1).to_pylist()):
                ids, size = tok.encode(part)
                ids, begin, place, length = ids.astype(kind), 0, [], []
                for n in size.tolist():
                    data = frame(ids[begin : begin + n].tobytes() + end.tobytes())
                    out.write(data)
                    place.append(at)
                    length.append(len(data))
                    begin, at = begin + n, at + len(data)
                index.append(pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), pa.array([file] * len(part), pa.string()), pa.array(range(row, row + len(part)), pa.int64()), batch.column(0).slice(lo, len(part)), pa.array(place, pa.int64()), pa.array(length, pa.int64()), pa.array(size + len(end), pa.int64())], names=names))
                row += len(part)
            batch = next(batches, None)
    yield from index  # only once the file is whole


def write_records(df: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Write all rows as shards below `folder` (a URI all executors share); the index read back.

    One range shuffle by key; each task streams its range into one file.  There
    are as many ranges as the texts' bytes need, at least one a shuffle partition.
    """
    spark = df.sparkSession
    if shards is None:
        size = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    kind = df.schema[key].dataType.simpleString()
    names = ["shard", "file", "row", key, "offset", "length", "n_tokens"]
    schema = f"shard int, file string, row bigint, `{key}` {kind}, offset bigint, length bigint, n_tokens bigint"
    ordered = df.select(key, text).repartitionByRange(shards, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    ordered.mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary, end_id=end_id, names=names), schema).write.parquet(f"{folder}/index")
    return read_index(spark, folder, schema)


def read_index(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/index")


def with_start(index: DataFrame) -> DataFrame:
    """index with `start`, the ids of all records before each: totals by shard are summed first."""
    by_shard = index.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    base = by_shard.select("shard", (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("_base"))  # a row a shard
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row")) - F.col("n_tokens")
    return index.withColumn("_in", inside).join(base, "shard").withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in")


def _read(batches: Iterator[pa.RecordBatch], *, folder: str, ids: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    names = [*columns, *(["ids"] if ids else []), "ids_crc32"]
    file_at, offset_at, length_at = (columns.index(c) for c in ("file", "offset", "length"))
    source, of, width = None, None, 0
    data, base = b"", 0
    try:
        for batch in batches:
            crc, got = [], []
            file, offset, length = (batch.column(i).to_pylist() for i in (file_at, offset_at, length_at))
            for i, (s, o, n) in enumerate(zip(file, offset, length)):
                if s != of:
                    if source is not None:
                        source.close()
                    source, of, data, base = open_input(shard_uri(folder, s)), s, b"", 0
                    magic, width, version = HEADER.unpack(source.read_at(HEADER.size, 0))
                    if magic != MAGIC or version != VERSION:
                        raise ValueError("not a token record file")
                if not base <= o <= o + n <= base + len(data):
                    end, k = o + n, i + 1  # take the records that follow directly, up to READ_BYTES
                    while k < len(file) and file[k] == s and offset[k] == end and end - o < READ_BYTES:
                        end, k = end + length[k], k + 1
                    data, base = source.read_at(end - o, o), o
                x = np.frombuffer(unframe(data, o - base), f"<u{width}").astype("<u4")
                crc.append(zlib.crc32(x.tobytes()))
                if ids:
                    got.append(x.astype(np.int32))
            cols = [pa.array(got, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array(crc, pa.int64())], names=names)
    finally:
        if source is not None:
            source.close()


def read_records(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """index with the ids of each record (if asked for) and ids_crc32, their CRC-32 as u32 little-endian.

    Neighbouring records are fetched by one read; every length and payload checksum is verified.
    """
    fields = [*index.schema.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []), T.StructField("ids_crc32", T.LongType())]
    return index.mapInArrow(partial(_read, folder=folder, ids=ids, columns=index.columns), T.StructType(fields))
