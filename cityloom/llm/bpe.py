"""Byte-level BPE by a pair occurrence index.

All words that a batch needs and the worker hasn't seen are encoded together:
their bytes lie in one symbol array with previous/next links, an index maps
each merge rank to every position where its pair stands, and active ranks are
taken from a heap in ascending order.  Applying a rank touches only its own
positions; the pairs that a merge creates are added to the lists of their
ranks, and stale positions are recognised when their rank comes up.

Null texts count as empty.  Special-token strings inside a text become the
special token, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cityloom.llm.pieces import WORD_PATTERN, Numbers, PieceStore, chunks, ranges
from cityloom.llm.workers import held

def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBpe(PieceStore):
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        back = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int32)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.base = np.int64(size)
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.key, self.key_rank = key[order], order.astype(np.int32)
        self.words = regex.compile(WORD_PATTERN)
        super().__init__()

    # -- merging ---------------------------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair never merges."""
        want = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.key_rank[at], np.int32(-1))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and how many belong to each."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.byte_id[raw]
        word = np.repeat(np.arange(len(words)), length)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(length[length > 0])
        nxt[ends - 1] = -1
        prv[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def occur(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions into the index."""
            rank = self.ranks(sym[at], sym[nxt[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            low = [0, *cuts.tolist()]
            for r, lo, hi in zip(rank[low].tolist(), low, [*low[1:], len(at)]):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        occur(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if not len(at):
                continue
            if a == b:  # a run of equal symbols: pairs are taken from its left end, none overlapping
                at = np.unique(at)
                follows = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            elif len(lists) > 1:
                at = np.unique(at)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.merged[r]
            alive[gone] = False
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            occur(np.unique(np.concatenate([at[has], before[before >= 0]])))
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    # -- pieces ----------------------------------------------------------------------------

    def encode_pieces(self, heads: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.words.findall(p) for p in heads]
        per = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for ws in split for w in ws]
        if rest:  # words end where pieces do, so one search over all of them gives the same words
            more = self.words.findall(" " + " ".join(rest))
            ends = np.cumsum(np.fromiter(map(len, more), np.int64, len(more)))
            edge = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)) + 1), "right")
            per = np.concatenate([per, np.diff(edge, prepend=0)])
            words += more
        ids = Numbers()
        which = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        flat, count = self.merge([w.encode() for w in ids]) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))
        start = np.cumsum(count) - count
        size = np.bincount(np.repeat(np.arange(len(per)), per), weights=count[which], minlength=len(per)).astype(np.int64)
        return flat[ranges(start[which], count[which])], size

    # -- decoding --------------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; byte sequences that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> PairIndexBpe:
    """The worker's codec of this vocabulary file, which must exist on every executor."""
    return held(("bpe", path), lambda: PairIndexBpe(path))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>); null texts get no ids.

    One pass, no shuffle.  An existing column named `out` is replaced.
    """
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for lo, part in chunks(batch.column(at).to_pylist()):
                ids, size = bpe.encode(part)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                rows = batch.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=[*rest, out])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the decoded text of its ids; null ids give an empty text."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.StringType())])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            got = [bpe.decode(x or ()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*rest, out])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of every row: encode, then decode the ids.

    Both directions run in the same pass, so that no ids travel between Python and the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        say = bpe.decimal.__getitem__
        for batch in batches:
            for lo, part in chunks(batch.column(1).to_pylist()):
                flat, size = bpe.encode(part)
                ids_sha, text_sha, at = [], [], 0
                for n in size.tolist():
                    own = flat[at : at + n].tolist()
                    at += n
                    ids_sha.append(hashlib.sha256(",".join(map(say, own)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                cols = [batch.column(0).slice(lo, len(part)), pa.array(size, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
