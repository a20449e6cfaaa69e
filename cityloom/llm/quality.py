"""Quality scores: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over standardised statistics of the
whole text.  Normal equations are summed within partitions and then over them;
isotonic regression over fixed bins of the raw score, counted in Spark, turns
the scores into probabilities.

Null texts count as empty and are scored too.  Labels that are null are ignored,
repeated labels of a document averaged.  Without labelled rows every score is
0.5, as is every score where all labels are alike: that of the one label.
Documents with equal statistics have equal scores; repeated rows are scored one
by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.llm.workers import held
from cityloom.session import fresh

STATISTICS = ["log_words", "log_bytes", "word_length", "word_spread", "distinct", "top_word", "upper", "digit", "punct", "symbol", "bar", "bang", "stop", "line_words", "line_repeat", "space", "wide", "short", "repeat", "entropy"]
FEATURES, RIDGE, BINS = 256, 1e-3, 2000
#: About so many labelled documents fit a model, chosen by a hash of their key where there are more; some hundreds for each of the features.
MAX_LABELLED = 100_000
#: Standardised statistics are clipped here, raw scores at these ends.
CLIP, LOW, HIGH = 4.0, -0.5, 1.5


def classes() -> np.ndarray:
    """Byte value -> weight in each character-class count (a 256 x 9 table)."""
    out = np.zeros((256, 9))
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"#$%&*@^~<>=+_{}[]\\/", b"|", b"!?", b".", b" \t\r\n\x0b\x0c"]
    for i, s in enumerate(sets):
        out[list(s), i] = 1
    out[128:, 8] = 1
    return out


def statistics(text: str | None, table: np.ndarray) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    w = len(words)
    if not w:
        return [0.0] * len(STATISTICS)
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, punct, symbol, bar, bang, stop, space, wide = bins @ table
    length = np.fromiter(map(len, words), np.int64, w)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = bins[bins > 0] / n
    repeat = sum(map(bytes.__eq__, words, words[1:])) / w
    return [
        np.log1p(w), np.log1p(n), float(length.mean()), float(length.std()), len(seen) / w, max(seen.values()) / w, upper / n, digit / n, punct / n, symbol / n, bar / w, bang / w, stop / w,
        np.log1p(w / len(lines)), 1 - len(set(lines)) / len(lines), space / n, wide / n, float((length <= 3).mean()), repeat, float(-(share * np.log2(share)).sum()),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = held("quality", classes)
    for batch in batches:
        got = np.array([statistics(t.as_py(), table) for t in batch.column(batch.num_columns - 1)], np.float64).reshape(-1, len(STATISTICS))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*batch.schema.names[:-1], "stats"])


def document_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `stats`, one pass over whole texts; a kept column of that name gives way to it."""
    keep = [c for c in keep if c != "stats"]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(*fresh(df, "_text"))).mapInArrow(_statistics, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.array([LOW, HIGH]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))
    seed: int = 11
    fitted: bool = True

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        d = len(self.mean)
        frequency = rng.standard_normal((d, FEATURES)) / np.sqrt(d) * 1.5
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ frequency + phase), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weight, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal(batches: Iterator[pa.RecordBatch], *, model: Model) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            z, y = model.features(matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            part = np.concatenate([(z.T @ z).ravel(), z.T @ y])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def pool(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic means of bins by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, t in zip(count, total):
        blocks.append([n, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, t2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + t2, blocks[-1][2] + k2]
    return np.concatenate([[t / n] * k for n, t, k in blocks])


def _binned(batches: Iterator[pa.RecordBatch], *, model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.minimum(((model.raw(matrix(batch.column(0))) - LOW) / (HIGH - LOW) * BINS).astype(np.int64), BINS - 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])


def fit(rows: DataFrame) -> Model:
    """Model of `rows` (stats array<double>, y double from 0 to 1), all of them.

    The driver gets column moments, one summed system and the bins: sizes that don't grow with the rows.
    """
    d = len(STATISTICS)
    moments = rows.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)], F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), np.zeros(0), fitted=False)
    mean, scale = np.array([moments[f"m{i}"] for i in range(d)]), np.array([moments[f"s{i}"] for i in range(d)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(0))
    sums = rows.select("stats", "y").mapInArrow(partial(_normal, model=model), "sums binary")
    tree = sums.repartition(16).mapInArrow(_add, "sums binary").coalesce(1).mapInArrow(_add, "sums binary").first()
    size = FEATURES + d + 1
    whole = np.frombuffer(bytes(tree["sums"]))
    gram, right = whole[: size * size].reshape(size, size), whole[size * size :]
    model.weight = np.linalg.solve(gram + RIDGE * moments["n"] / size * np.eye(size), right)
    bins = rows.select("stats", "y").mapInArrow(partial(_binned, model=model), "bin bigint, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).orderBy("bin").collect()
    model.edges = np.array([LOW + (r["bin"] + 0.5) * (HIGH - LOW) / BINS for r in bins])
    # half a row of each class keeps the ends off 0 and 1
    model.values = pool(np.array([r["n"] for r in bins], float), np.array([r["t"] for r in bins], float))
    return model


def _score(batches: Iterator[pa.RecordBatch], *, model: Model, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.score(matrix(batch.column(batch.num_columns - 1))) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], out])


def score(stats: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    schema = T.StructType([*[stats.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    return stats.select(*keep, "stats").mapInArrow(partial(_score, model=model, out=out), schema)


def _score_texts(batches: Iterator[pa.RecordBatch], *, model: Model, at: int, out: str) -> Iterator[pa.RecordBatch]:
    table = held("quality", classes)
    for batch in batches:
        x = np.array([statistics(t.as_py(), table) for t in batch.column(at)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, out])


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df, all columns, and the score of its texts; an existing column named `out` is replaced."""
    rows = df.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    return rows.mapInArrow(partial(_score_texts, model=model, at=rows.columns.index(text), out=out), schema)


def averaged(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, y): the mean label of each labelled document."""
    return labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("y"))


def labelled(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """stats and y of the documents with a label; only statistics are shuffled, never texts."""
    return stats.join(averaged(labels, key, label), key).select("stats", "y")


def labelled_texts(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """stats and y of about `most` labelled documents at most; the others' texts aren't read for it, and none is shuffled."""
    y = averaged(labels, key, label)
    rows = y.count()
    if rows > most:
        y = y.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / rows))
    k, v = fresh(df, "_key", "_y")
    few = F.broadcast(y.select(F.col(key).alias(k), F.col("y").alias(v)))  # bounded by `most`
    told = df.select(key, text).join(few, F.col(key) == F.col(k)).select(F.col(v).alias("y"), text)
    return document_statistics(told, ["y"], text).select("stats", "y")
