"""Runs: stretches of words that repeat with a period, found by block matching.

Words are maximal runs of bytes without ASCII white space.  A run is a stretch
with smallest period q and at least max(LEAST, 2q) words that neither neighbour
extends.  In such a run the words equal to those q further on fill so long a
stretch that it holds a block of b words starting at a multiple of b, b a power
of two that depends on q alone.  So the aligned blocks of each b are keys of an
Aho-Corasick automaton over integer sequences, which is run over the whole text;
an occurrence at a distance that b stands for is a seed, and a seed is extended
in both directions word by word.  The extension decides: results are exact.

Work stays near n log n for any text: a block has at most 4b seeds; those inside
a run already known, at multiples of its period, are dropped together; and one
stretch of equal words is extended once for each distance.  Blocks with a word
that doesn't recur within reach aren't entered at all.  Blocks of more than
DIRECT words are keys of two numbers, the names of their halves, so that a
repetitive text doesn't lead the automaton through chains as long as a block.

Null and empty texts have no words and no runs.  Repeated rows get equal results,
null keys are keys like others.  Kept columns named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.session import fresh

#: Fewest words of a run.
LEAST = 12
#: Blocks up to so many words are keys word by word, longer ones pairs of their halves' names.
DIRECT = 64
Run = tuple[int, int, int]
#: (key, words) -> words; what a query does to a text before runs are sought.
Edit = Callable[[object, list[bytes]], list[bytes]]

LONGS = ["n_runs", "start", "length", "period", "exponent_milli"]
DIGESTS = ["runs_sha256", "collapsed_sha256"]
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def block_length(period: int, least: int = LEAST) -> int:
    """The longest power of two b such that 2b-1 words surely equal those a period further on."""
    sure = max(least - period, period)
    return 1 << ((sure + 1) // 2).bit_length() - 1


def scales(n: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(block length, least, greatest distance) for all periods that a text of n words can have, by period."""
    out: list[tuple[int, int, int]] = []
    q = 1
    while q <= n // 2:
        b = block_length(q, least)
        # below half of `least` the sure stretch shrinks as periods grow, beyond it is the period itself
        last = least - (2 * b - 1) if least - q > q else 4 * b - 2
        last = max(q, min(last, n // 2, (least - 1) // 2 if least - q > q else n))
        out.append((b, q, last))
        q = last + 1
    return out


def recurrence(ids: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence; a distance beyond the text where there is none."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), len(ids) + 1)
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def agree(a: np.ndarray, x: int, y: int, step: int) -> int:
    """How many words from x and from y > x on are equal, upwards (step 1) or downwards (step -1)."""
    room = len(a) - y if step > 0 else x + 1
    done, chunk = 0, 32
    while done < room:
        m = min(chunk, room - done)
        if step > 0:
            differ = a[x + done : x + done + m] != a[y + done : y + done + m]
        else:
            differ = (a[x - done - m + 1 : x - done + 1] != a[y - done - m + 1 : y - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += m
        chunk *= 4
    return done


class Blocks:
    """Where aligned blocks of one length, given by their starts, occur in the text."""

    def __init__(self, starts: np.ndarray, keys: list[tuple[int, ...]], text: tuple[int, ...], size: int, places: np.ndarray | None = None):
        """`keys` are the blocks as sequences of `size` numbers in `text`; `places` maps places of `text` to words."""
        self.starts = starts
        if not keys:
            return
        kinds: dict[tuple[int, ...], int] = {}
        self.kind = np.fromiter((kinds.setdefault(k, len(kinds)) for k in keys), np.int64, len(keys))
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in kinds.items():
            machine.add_word(key, k)
        machine.make_automaton()
        found = np.array(list(machine.iter(text)), np.int64).reshape(-1, 2)
        at = found[:, 0] - size + 1
        at = at if places is None else places[at]
        order = np.lexsort((at, found[:, 1]))
        self.at, self.which = at[order], found[order, 1]

    def names(self, n: int) -> np.ndarray:
        """For each word the number, from 1, of the block that starts there, if it occurs elsewhere too; else 0."""
        out = np.zeros(n, np.int64)
        if not len(self.starts):
            return out
        often = np.bincount(self.which)[self.which] > 1
        out[self.at[often]] = self.which[often] + 1
        return out

    def later(self, near: int, far: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start, starts of its equals `near` to `far` words on) for the blocks that have such."""
        width = int(self.at.max(initial=0)) + far + int(self.starts.max(initial=0)) + 1
        places, wanted = self.which * width + self.at, self.kind * width + self.starts
        low, high = np.searchsorted(places, wanted + near), np.searchsorted(places, wanted + far, "right")
        for i in np.flatnonzero(high > low).tolist():
            yield int(self.starts[i]), self.at[low[i] : high[i]]


def direct(text: tuple[int, ...], b: int, recurs: np.ndarray) -> Blocks:
    """Aligned blocks of b words that all recur."""
    starts = np.flatnonzero(recurs[: len(text) // b * b].reshape(-1, b).all(1)) * b
    return Blocks(starts, [text[s : s + b] for s in starts.tolist()], text, b)


def doubled(names: np.ndarray, half: int) -> Blocks:
    """Aligned blocks whose halves both recur, as pairs of the halves' names.

    The names half a block apart are neighbours in a text of names, one after the
    other for each remainder of the place: keys of two numbers do for any length.
    """
    n = len(names)
    starts = np.arange(0, n - 2 * half + 1, 2 * half)
    starts = starts[(names[starts] > 0) & (names[starts + half] > 0)]
    rows = -(-n // half) + 1
    places = np.arange(rows * half).reshape(rows, half).T.ravel()
    text = np.concatenate([names, np.zeros(rows * half - n, np.int64)])[places]
    return Blocks(starts, list(zip(names[starts].tolist(), names[starts + half].tolist())), tuple(text.tolist()), 2, places)


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start and period."""
    n = len(ids)
    if n < max(least, 2):
        return []
    gap, text = recurrence(ids), tuple(ids.tolist())
    found: dict[tuple[int, int], int] = {}
    # for each word: the end and the period of the known run over it that ends last
    end, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    named, names = 0, gap
    reach: dict[int, int] = {}
    for b, _, far in (steps := scales(n, least)):
        reach[b] = max(far, reach.get(b, 0)) if b < DIRECT else n // 2
    known: dict[int, Blocks] = {}
    for step, (b, near, far) in enumerate(steps):
        if b in known:
            blocks = known.pop(b)
        elif b > DIRECT and named == b // 2:
            blocks = doubled(names, named)
        else:
            blocks = direct(text, b, gap <= reach[b])
        if b >= DIRECT:
            named, names = b, blocks.names(n)
        if any(b == later for later, _, _ in steps[step + 1 :]):
            known[b] = blocks
        if not len(blocks.starts):
            continue
        stretch: dict[int, int] = {}
        for i, at in blocks.later(near, far):
            if end[i] >= i + b:
                # a block of two periods and more recurs within its run at multiples of the period only
                if b >= 2 * period[i]:
                    at = at[np.searchsorted(at, end[i] - b + 1) :]
                at = at[(at + b > end[i]) | ((at - i) % period[i] != 0)]
            for j in at.tolist():
                d = j - i
                if i < stretch.get(d, 0):
                    continue
                u = i - agree(ids, i - 1, j - 1, -1) if i else 0
                v = i + agree(ids, i, j, 1)
                stretch[d] = v
                e = v + d
                if e - u >= max(least, 2 * d) and d < found.get((u, e), n):
                    found[u, e] = d
                    longer = end[u:e] < e
                    end[u:e][longer] = e
                    period[u:e][longer] = d
    return sorted((u, e - u, d) for (u, e), d in found.items())


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words, without those that lie in a run beyond its first period."""
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return [w for w, k in zip(words, kept.tolist()) if k]


def numbered(words: list[bytes]) -> np.ndarray:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _find(batches: Iterator[pa.RecordBatch], *, names: list[str], least: int, edit: Edit | None, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, raw = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        rows = []
        for key, text in zip(keys.to_pylist() if edit else [None] * len(raw), raw):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            if edit:
                words = edit(key, words)
            runs = find_runs(numbered(words), least)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            lines = "".join("%d,%d,%d\n" % r for r in runs).encode()
            rest = b" ".join(collapsed(words, runs) if runs else words)
            got = [len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None]
            got += [hashlib.sha256(lines).hexdigest(), hashlib.sha256(rest).hexdigest()]
            if texts:
                got += [[dict(zip(("start", "length", "period"), r)) for r in runs], rest.decode()]
            rows.append(got)
        types = [pa.int64()] * len(LONGS) + [pa.string()] * len(DIGESTS)
        if texts:
            types += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=names)


def with_runs(df: DataFrame, keep: list[str], *, key: str = "doc_id", text: str = "text", least: int = LEAST, edit: Edit | None = None, texts: bool = False) -> DataFrame:
    """The columns `keep`, the number of runs, the longest run (ties: smallest start, then period) and digests.

    runs_sha256 is over a line `start,length,period` a run, collapsed_sha256 over
    the words outside repetitions joined by one space.  With `texts` the columns
    runs and collapsed hold the same in full.  `edit` gets the key and the words.
    """
    fields = [T.StructField(c, T.LongType()) for c in LONGS] + [T.StructField(c, T.StringType()) for c in DIGESTS]
    if texts:
        fields += [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    taken = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in taken]
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    k, t = fresh(df.select(*keep), "_key", "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{key}`").alias(k), F.col(f"`{text}`").alias(t))
    return rows.mapInArrow(partial(_find, names=schema.names, least=least, edit=edit, texts=texts), schema)
