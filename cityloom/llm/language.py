"""Language identification by hyperdimensional profiles.

A letter is a random vector of +1 and -1 that its code point seeds.  A trigram
is the product of its letters' vectors, rotated by their distance from its end;
a text is the sum of its trigrams, a language the sum of its texts.  A text is
given the language whose prototype has the largest cosine with it.

Letters are lower-cased; whatever isn't a letter separates words as one blank,
also at either end, and a blank is a letter of its own.  Null texts and texts
without a letter are `und` with score 0, as is every text where nothing was
learned.  Sums are integers, so that the model doesn't depend on how rows are
dealt; repeated rows count as often as they stand there.  Of languages with
equal cosine the first by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.llm.workers import held
from cityloom.session import fresh

DIMENSIONS = 1024
UNDETERMINED = "und"
#: Trigram vectors and letters a worker remembers, and trigrams bundled at once (bound memory, not results).
CACHE_TRIGRAMS, CACHE_LETTERS, CHUNK = 40_000, 8192, 4096
_BITS = 21


class Hypervectors:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        lower = points.copy()
        for c in np.flatnonzero(letter):
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        self.fold = np.where(letter, lower, 0).astype(np.uint32)  # 0: no letter
        self.number = np.full(0x110000, -1, np.int64)
        self.forget_letters()

    def forget_letters(self) -> None:
        self.number[:] = -1
        self.letters = [np.empty((256, self.dimensions), np.int8) for _ in range(3)]
        self.known = 0
        self.learn(np.array([0]))
        self.forget()

    def settle(self) -> None:
        """Between batches: trigram codes made before hold no longer if too many letters are known."""
        if self.known > CACHE_LETTERS:
            self.forget_letters()

    def forget(self) -> None:
        self.trigram, self.row = np.empty(0, np.int64), np.empty(0, np.int64)
        self.vectors, self.used = np.empty((4096, self.dimensions), np.int8), 0

    def learn(self, points: np.ndarray) -> None:
        """Vectors of new code points, each rotated for the three places of a trigram."""
        new = np.stack([np.random.Generator(np.random.PCG64([self.seed, int(p)])).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for p in points])
        while self.known + len(new) > len(self.letters[0]):
            self.letters = [np.concatenate([x, np.empty_like(x)]) for x in self.letters]
        for place in range(3):
            self.letters[place][self.known : self.known + len(new)] = np.roll(new, 2 - place, axis=1)
        self.number[points] = np.arange(self.known, self.known + len(points))
        self.known += len(points)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams and their counts; None if there is no letter."""
        if not text:
            return None
        point = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = point > 0
        if not keep.any():
            return None
        keep[1:] |= keep[:-1]  # of a run of blanks the first stays
        point = np.concatenate([[0], point[keep], [0]])
        if point[1] == 0:
            point = point[1:]
        if point[-2] == 0:
            point = point[:-1]
        n = self.number[point]
        if (n < 0).any():
            self.learn(np.unique(point[n < 0]))
            n = self.number[point]
        code = np.sort((n[:-2] << 2 * _BITS) | (n[1:-1] << _BITS) | n[2:])
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[at], np.diff(at, append=len(code))

    def rows(self, code: np.ndarray) -> np.ndarray:
        """Rows of self.vectors that hold these trigrams (at most CHUNK, distinct and ascending)."""
        at = np.searchsorted(self.trigram, code)
        have = at < len(self.trigram)
        have[have] = self.trigram[at[have]] == code[have]
        if not have.all():
            new = code[~have]
            if self.used + len(new) > CACHE_TRIGRAMS:
                self.forget()
                new = code
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            mask = (1 << _BITS) - 1
            parts = [self.letters[i][(new >> s) & mask] for i, s in ((0, 2 * _BITS), (1, _BITS), (2, 0))]
            self.vectors[self.used : self.used + len(new)] = parts[0] * parts[1] * parts[2]
            trigram = np.concatenate([self.trigram, new])
            row = np.concatenate([self.row, np.arange(self.used, self.used + len(new))])
            order = np.argsort(trigram)
            self.trigram, self.row = trigram[order], row[order]
            self.used += len(new)
            at = np.searchsorted(self.trigram, code)
        return self.row[at]

    def bundle(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sum of trigram vectors times their counts."""
        out = np.zeros(self.dimensions)
        for lo in range(0, len(code), CHUNK):
            rows = self.rows(code[lo : lo + CHUNK])
            out += count[lo : lo + CHUNK].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return np.rint(out)


def space(dimensions: int, seed: int) -> Hypervectors:
    return held(("hypervectors", dimensions, seed), lambda: Hypervectors(dimensions, seed))


def _sums(batches: Iterator[pa.RecordBatch], *, dimensions: int, seed: int) -> Iterator[pa.RecordBatch]:
    hyper, total = space(dimensions, seed), {}
    for batch in batches:
        hyper.settle()
        of: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if (got := hyper.trigrams(text.as_py())) is not None:
                of.setdefault(lang, []).append(got)
        for lang, got in of.items():
            code, which = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
            count = np.bincount(which, weights=np.concatenate([n for _, n in got]))
            whole = np.zeros(dimensions, np.int64)
            for lo in range(0, len(code), CHUNK):
                rows = hyper.rows(code[lo : lo + CHUNK])
                whole += np.rint(count[lo : lo + CHUNK] @ hyper.vectors[rows].astype(np.float64)).astype(np.int64)
            total[lang] = total.get(lang, 0) + whole
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "sums"])


def fit(df: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, list[int]]:
    """Prototype of each language: a vector a partition and language, summed in Spark.

    What reaches the driver is the model (languages x dimensions), however many rows there are.
    """
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text)
    sums = rows.mapInArrow(partial(_sums, dimensions=dimensions, seed=seed), "lang string, sums array<bigint>")
    cells = sums.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    model = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells")).collect()
    return {r["lang"]: [c["v"] for c in r["cells"]] for r in sorted(model, key=lambda r: r["lang"])}


def _predict(batches: Iterator[pa.RecordBatch], *, names: list[str], prototypes: np.ndarray, dimensions: int, seed: int, out: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    hyper = space(dimensions, seed)
    for batch in batches:
        hyper.settle()
        lang, score = [], []
        for text in batch.column(batch.num_columns - 1):
            got = hyper.trigrams(text.as_py())
            if got is None or not len(names):
                lang.append(UNDETERMINED)
                score.append(0.0)
                continue
            v = hyper.bundle(*got)
            cos = prototypes @ v / (np.sqrt(v @ v) or 1.0)
            best = int(np.argmax(cos))
            lang.append(names[best])
            score.append(float(np.clip(cos[best], 0, 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], *out])


def predict(df: DataFrame, model: dict[str, list[int]], text: str = "text", keep: list[str] | None = None, dimensions: int = DIMENSIONS, seed: int = 7, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (default: all), the predicted language and its cosine, from 0 to 1."""
    keep = [c for c in (keep or df.columns) if c not in out]
    matrix = np.array([model[k] for k in model], np.float64).reshape(len(model), dimensions)
    norm = np.sqrt((matrix**2).sum(1, keepdims=True)) if len(model) else matrix
    prototypes = matrix / np.where(norm > 0, norm, 1) if len(model) else matrix
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(*fresh(df, "_text")))
    return rows.mapInArrow(partial(_predict, names=list(model), prototypes=prototypes, dimensions=dimensions, seed=seed, out=out), schema)


def fold_of(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds
