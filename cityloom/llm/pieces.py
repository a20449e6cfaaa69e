"""Texts as pieces that tokenise independently, each distinct piece encoded once per worker."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex

# The byte-level pre-tokenisation pattern of the public vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces a worker remembers; the memory is emptied beyond it (bounds memory, not results).
CACHE_PIECES = 600_000
#: Characters encoded at once (bounds memory, not results).
BATCH_CHARS = 4_000_000


class Numbers(dict):
    """Numbers strings in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class PieceStore:
    """Encodes texts piece by piece under the byte-level pre-tokenisation.

    Under that pattern no token spans the place before a space that a non-space
    follows, so the parts between such places are encoded on their own.
    """

    specials: dict[str, int] = {}
    cache_pieces = CACHE_PIECES
    cut = regex.compile(r" (?=\S)")
    # White space after a space, or a space at the end: a plain split would cut inside a run.
    run = regex.compile(r" (?:\s|\Z)")

    def __init__(self) -> None:
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.forget()

    def forget(self) -> None:
        self.opening, self.head_at = Numbers(), np.empty(0, np.int64)  # pieces at a text's start
        self.spaced, self.tail_at = Numbers(), np.empty(0, np.int64)  # other pieces, less the space before them
        self.known = self.used = 0
        self.flat = np.empty(1 << 16, np.int32)
        self.start, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32)

    def encode_pieces(self, heads: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of heads, then of " " + each of rest, end to end, and the number of ids of each."""
        raise NotImplementedError

    def learn(self, heads: list[str], rest: list[str]) -> None:
        out, size = self.encode_pieces(heads, rest)
        pieces = len(size)
        self.flat = room(self.flat, self.used, len(out))
        self.start, self.count = room(self.start, self.known, pieces), room(self.count, self.known, pieces)
        self.flat[self.used : self.used + len(out)] = out
        self.start[self.known : self.known + pieces] = self.used + np.cumsum(size) - size
        self.count[self.known : self.known + pieces] = size
        self.used += len(out)
        self.known += pieces

    def pieces(self, text: str) -> list[str]:
        """Parts that tokenise independently: a cut before each space that a non-space follows.

        The space itself is left out; every part but the first had one before it.
        """
        return self.cut.split(text) if self.run.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each."""
        if not any(s in t for s in self.specials for t in texts):
            return self.encode_plain(texts)
        parts = [self.special.split(t) for t in texts]  # plain, special, plain, ...
        flat, size = self.encode_plain([p for ps in parts for p in ps[::2]])
        at, k, out, count = 0, 0, [], []
        for ps in parts:
            total = 0
            for i, p in enumerate(ps):
                if i % 2:
                    got = np.array([self.specials[p]], np.int32)
                else:
                    got = flat[at : at + size[k]]
                    at, k = at + size[k], k + 1
                out.append(got)
                total += len(got)
            count.append(total)
        return np.concatenate(out), np.array(count, np.int64)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.cache_pieces or self.used > 4 * self.cache_pieces:  # texts without spaces are long pieces
            self.forget()
        opened, spaced = len(self.opening), len(self.spaced)
        head, tail, per = [], [], np.zeros(len(texts), np.int64)
        first, later = self.opening.__getitem__, self.spaced.__getitem__
        for i, t in enumerate(texts):
            ps = self.pieces(t)
            head.append(first(ps[0]))
            per[i] = len(ps) - 1
            tail.append(np.fromiter(map(later, islice(ps, 1, None)), np.int32, len(ps) - 1))
        new_heads, new_rest = list(islice(self.opening, opened, None)), list(islice(self.spaced, spaced, None))
        if new_heads or new_rest:
            have = self.known
            self.learn(new_heads, new_rest)
            self.head_at = np.concatenate([self.head_at, np.arange(have, have + len(new_heads))])
            self.tail_at = np.concatenate([self.tail_at, np.arange(have + len(new_heads), self.known)])
        last = np.cumsum(per + 1)
        at = np.empty(int(last[-1]) if len(last) else 0, np.int64)
        lead = last - per - 1
        at[lead] = self.head_at[np.array(head, np.int64)]
        at[np.delete(np.arange(len(at)), lead)] = self.tail_at[np.concatenate(tail)]
        count = self.count[at].astype(np.int64)
        ids = self.flat[ranges(self.start[at], count)]
        edge = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(edge[last], prepend=0)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(a):
        return a
    out = np.empty(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out


def chunks(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of consecutive runs of at most `limit` characters (a longer text stands alone)."""
    lo = size = 0
    out: list[str] = []
    for i, t in enumerate(texts):
        t = t or ""
        if out and size + len(t) > limit:
            yield lo, out
            lo, out, size = i, [], 0
        out.append(t)
        size += len(t)
    if out:
        yield lo, out
