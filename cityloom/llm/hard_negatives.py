"""Hard negatives by a pivot table.

Scores are integer inner products.  With M the greatest norm, a row x gets the
further coordinate sqrt(M^2 - |x|^2) and an anchor q the coordinate 0; then the
distance d of both has d^2 = |q|^2 + M^2 - 2 q.x, so that high scores are small
distances.  Every row's distances to some pivots are stored; for any pivot p the
triangle inequality puts d between |d(q,p) - d(x,p)| and d(q,p) + d(x,p), which
brackets the score.  Rows fall into cells by their nearest pivot.  An anchor is
sent only to cells whose bracket reaches its scores, there rows are dropped by
their own brackets, and the survivors' scores are computed.  Pivots come from a
bounded sample; whatever they are, results are exact.

Anchors meet rows in blocks: cells are cut into blocks of at most about
BLOCK_ROWS rows, so that no cell, label or group of equal rows is one task's, and
a block streams its anchors past its rows.  Only the best few of a block for each
anchor are emitted.

Rows with a null label, vector or key and rows with a null or non-finite
component take no part.  Shorter vectors count as filled up with zeros.  Rows are
what the table holds: a repeated row takes part as often as it occurs, each copy
being another row to the others; ties go to the smaller key.  Scores beyond
MAX_SCORE count as that.  Without rows or anchors there are no results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.session import maybe_broadcast, stored

#: Pivots, and rows of the sample that they are chosen from.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a block at most and at least, as far as there are enough; anchors compared with a block at once.
BLOCK_ROWS, LEAST_ROWS, AT_ONCE = 1 << 17, 1 << 11, 64
MAX_SCORE = (1 << 63) // 200
#: Brackets are widened by this part of the greatest norm, far beyond rounding.
SLACK = 1e-6


@dataclass
class Pivots:
    """Pivot vectors with their further coordinate, the greatest norm and the form that vectors are stored in."""

    vectors: np.ndarray
    extra: np.ndarray
    norm: float
    width: int
    form: str

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.norm**2 - 2 * (x @ self.vectors.T + np.outer(extra, self.extra)), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.norm**2 - 2 * q @ self.vectors.T, 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that stands for a score of an anchor."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.norm**2 - 2 * score, 0))

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.form).reshape(len(column), self.width).astype(np.float64)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as far as MAX_SCORE."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    rows = [[max(-MAX_SCORE, min(MAX_SCORE, sum(int(a) * b for a, b in zip(row, other)))) for other in whole] for row in q]
    return np.array(rows, np.int64).reshape(len(q), len(x))


def _dense(vectors: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def choose_pivots(rows: DataFrame) -> Pivots | None:
    """Pivots of `rows` (uid, v array<double>): rows of a sample, each as far as possible from those before."""
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n"), F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m")).first()
    if most["n"] is None:
        return None
    width, norm = most["w"], float(np.sqrt(most["n"])) * (1 + 1e-12)
    sample = _dense([r["v"] for r in rows.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").collect()], width)
    extra = np.sqrt(np.maximum(norm**2 - (sample * sample).sum(1), 0))
    points = np.column_stack([sample, extra])
    picked, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(picked) < PIVOTS and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[picked[-1]]) ** 2).sum(1))
    return Pivots(sample[picked], extra[picked], norm, width, "<i4" if (most["m"] or 0) < 2**31 else "<f8")


def _measured(batches: Iterator[pa.RecordBatch], *, pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _dense(batch.column("v").to_pylist(), pivots.width)
        away, towards = pivots.of_rows(x), pivots.of_anchors(x)
        packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (np.ascontiguousarray(x.astype(pivots.form)), away, towards)]
        cell = pa.array(away.argmin(1) if len(x) else [], pa.int32())
        spread = pa.array(list(away), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cell, *packed, spread], names=[*batch.schema.names[:-1], "cell", "v", "away", "towards", "spread"])


def pivot_table(df: DataFrame, key: str, label: Column, vector: str, anchor: Column, scale: float) -> tuple[DataFrame, Pivots | None]:
    """The rows that take part, stored with their distances to pivots: uid, key, label, anchor, cell, v, away, towards, spread."""
    x = F.transform(vector, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double") if scale else e.cast("double"))
    broken = F.exists(F.col(vector), lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    parts = df.filter(F.col(vector).isNotNull() & ~broken & F.col(key).isNotNull())
    parts = parts.select(F.col(key).cast("bigint").alias("key"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("v")).filter("label is not null")
    # numbers of rows hold once they are stored
    rows = stored(parts.withColumn("uid", F.monotonically_increasing_id()).select("uid", "key", "label", "anchor", "v"), "negatives-rows")
    pivots = choose_pivots(rows)
    if pivots is None:
        return rows, None
    schema = "uid long, key long, label long, anchor boolean, cell int, v binary, away binary, towards binary, spread array<double>"
    return stored(rows.mapInArrow(partial(_measured, pivots=pivots), schema), "negatives-pivots"), pivots


def cells(rows: DataFrame, by: list[str], block_rows: int) -> DataFrame:
    """For each value of `by` and cell the number of rows and blocks and the least and greatest distance to each pivot."""
    k = F.size("spread")
    ends = [e.alias(f"{n}{i}") for i in range(PIVOTS) for n, e in (("l", F.min(F.get("spread", F.lit(i)))), ("h", F.max(F.get("spread", F.lit(i)))))]
    out = rows.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("k"), *ends)
    low, high = (F.slice(F.array(*[f"{n}{i}" for i in range(PIVOTS)]), F.lit(1), F.col("k")) for n in "lh")
    return out.select(*by, "cell", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), low.alias("low"), high.alias("high"))


def _aimed(batches: Iterator[pa.RecordBatch], *, pivots: Pivots, positives: int) -> Iterator[pa.RecordBatch]:
    """Anchors with the cells of their label that may hold one of their best; `limit` is the greatest distance that matters."""
    for batch in batches:
        out, limits = [], []
        q, towards = pivots.matrix(batch.column("v")), np.frombuffer(b"".join(batch.column("towards").to_pylist())).reshape(batch.num_rows, -1)
        for i, group in enumerate(batch.column("cells").to_pylist()):
            low, high = (np.array([c[e] for c in group]) for e in ("low", "high"))
            sure = (towards[i] + high).min(1)
            limit, have = np.inf, 0
            for j in np.argsort(sure):
                have += group[j]["n"]
                if have > positives:  # one may be the anchor
                    limit = sure[j] + SLACK * pivots.norm
                    break
            near = np.maximum(towards[i] - high, low - towards[i]).max(1)
            out.append([{"cell": c["cell"], "blocks": c["blocks"]} for c, d in zip(group, near) if d - SLACK * pivots.norm <= limit])
            limits.append(limit)
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("blocks", pa.int32())]))
        kept = ["uid", "key", "label", "v", "towards"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(limits, pa.float64()), pa.array(out, kind)], names=[*kept, "limit", "cells"])


Finder = Callable[["Block", pa.RecordBatch], Iterator[tuple]]


class Block:
    """The rows of a block, and those of them that an anchor's bracket leaves."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: Pivots):
        self.pivots = pivots
        self.uid, self.key, self.label = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("uid", "key", "label"))
        self.x = np.concatenate([pivots.matrix(b.column("v")) for b in batches])
        self.away = np.concatenate([np.frombuffer(b"".join(b.column("away").to_pylist())).reshape(b.num_rows, -1) for b in batches])

    def survivors(self, towards: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
        """Which rows (columns) may lie between two distances from which anchors (rows)."""
        slack = SLACK * self.pivots.norm
        alive = np.ones((len(towards), len(self.x)), bool)
        for p in range(towards.shape[1]):
            alive &= np.abs(towards[:, p, None] - self.away[None, :, p]) <= farthest[:, None] + slack
            if nearest.any():
                alive &= towards[:, p, None] + self.away[None, :, p] >= nearest[:, None] - slack
        return alive


def _met(batches: Iterator[pa.RecordBatch], *, pivots: Pivots, find: Finder, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other: their rows first, then their anchors, which stream past."""
    at, rows, block = None, [], None
    for batch in batches:
        ids = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bl", "bc", "bs", "role")])
        edges = [0, *(np.flatnonzero((np.diff(ids, axis=0) != 0).any(1)) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if (here := tuple(ids[a, :3].tolist())) != at:
                at, rows, block = here, [], None
            part = batch.slice(a, b - a)
            if ids[a, 3] == 0:
                rows.append(part)
                continue
            if not rows:
                continue
            block = block or Block(rows, pivots)
            for s in range(0, part.num_rows, AT_ONCE):
                got = list(find(block, part.slice(s, AT_ONCE)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=names)


def _best(block: Block, anchors: pa.RecordBatch, *, most: int) -> Iterator[tuple]:
    """(anchor, key, score, uid) of the best `most` rows of the block for each anchor."""
    q = block.pivots.matrix(anchors.column("v"))
    towards = np.frombuffer(b"".join(anchors.column("towards").to_pylist())).reshape(len(q), -1)
    limit = anchors.column("limit").to_numpy(zero_copy_only=False)
    uid = anchors.column("uid").to_numpy(zero_copy_only=False)
    alive = block.survivors(towards, np.zeros(len(q)), limit) & (uid[:, None] != block.uid[None])
    score = inner(q, block.x) if alive.mean() > 0.05 else None
    for i in range(len(q)):
        at = np.flatnonzero(alive[i])
        s = score[i, at] if score is not None else inner(q[i : i + 1], block.x[at])[0]
        if len(at) > 4 * most:  # ties with the last stay in
            enough = s >= np.partition(s, -most)[-most]
            at, s = at[enough], s[enough]
        for j in np.lexsort((block.key[at], -s))[:most]:
            yield uid[i], block.key[at[j]], s[j], block.uid[at[j]]


def _between(block: Block, anchors: pa.RecordBatch, *, most: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, its key, place and key and score of a positive, key and score) of the best `most` rows of another label for each positive."""
    q = block.pivots.matrix(anchors.column("v"))
    towards = np.frombuffer(b"".join(anchors.column("towards").to_pylist())).reshape(len(q), -1)
    uid, key, label = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "key", "label"))
    nearest, farthest = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("nearest", "farthest"))
    alive = block.survivors(towards, nearest, farthest) & (label[:, None] != block.label[None])
    score = inner(q, block.x) if alive.mean() > 0.05 else None
    for i, positives in enumerate(anchors.column("positives").to_pylist()):
        at = np.flatnonzero(alive[i])
        s = score[i, at] if score is not None else inner(q[i : i + 1], block.x[at])[0]
        scores = [p["score"] for p in positives]
        inside = (100 * s >= low * min(scores)) & (100 * s <= high * max(scores))
        at, s = at[inside], s[inside]
        order = np.lexsort((block.key[at], -s))
        at, s = at[order], s[order]
        for place, p in enumerate(positives):
            a = int(np.searchsorted(-100 * s, -high * p["score"]))
            for j in range(a, min(a + most, len(s))):
                if 100 * s[j] >= low * p["score"]:
                    yield uid[i], key[i], place, p["key"], p["score"], block.key[at[j]], s[j]


def _windowed(batches: Iterator[pa.RecordBatch], *, pivots: Pivots, low: int, high: int, where: list[dict]) -> Iterator[pa.RecordBatch]:
    """Anchors with the distances that stand for their negatives' scores and the cells that reach them."""
    ends = [np.array([c[e] for c in where]) for e in ("low", "high")]
    for batch in batches:
        q = pivots.matrix(batch.column("v"))
        towards = np.frombuffer(b"".join(batch.column("towards").to_pylist())).reshape(len(q), -1)
        scores = [[p["score"] for p in ps] for ps in batch.column("positives").to_pylist()]
        farthest = pivots.reach(q, np.array([[low * min(s) / 100 - 1] for s in scores]))[:, 0]
        nearest = pivots.reach(q, np.array([[high * max(s) / 100 + 1] for s in scores]))[:, 0]
        slack, out = SLACK * pivots.norm, []
        for i in range(len(q)):
            near = np.maximum(towards[i] - ends[1], ends[0] - towards[i]).max(1)
            far = (towards[i] + ends[1]).min(1)
            out.append([{"cell": c["cell"], "blocks": c["blocks"]} for c, a, b in zip(where, near, far) if a - slack <= farthest[i] and b + slack >= nearest[i]])
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("blocks", pa.int32())]))
        columns = [*batch.columns, pa.array(nearest, pa.float64()), pa.array(farthest, pa.float64()), pa.array(out, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "nearest", "farthest", "cells"])


ANCHOR = "uid long, key long, label long, v binary, towards binary"
POSITIVES = "positives array<struct<place: int, key: long, score: long>>"
CELLS = "cells array<struct<cell: int, blocks: int>>"


def _meet(rows: DataFrame, anchors: DataFrame, partitions: int) -> DataFrame:
    """Rows and anchors (in `cells`) with bl, bc and bs, the block, and role, 0 for rows: a block's rows, then its anchors, are neighbours."""
    sent = anchors.withColumn("_c", F.explode("cells")).withColumn("bs", F.explode(F.sequence(F.lit(0), F.col("_c.blocks") - 1)))
    sent = sent.withColumn("bc", F.col("_c.cell")).withColumn("role", F.lit(1)).drop("_c", "cells")
    both = rows.withColumn("role", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    both = both.withColumn("bl", F.col("bl").cast("bigint")).withColumn("bc", F.col("bc").cast("bigint")).withColumn("bs", F.col("bs").cast("bigint"))
    return both.repartition(partitions, "bl", "bc", "bs").sortWithinPartitions("bl", "bc", "bs", "role")


def mined(df: DataFrame, *, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x) (scale 0: they are whole already).  An
    anchor's positives are its best other rows of the same label; for each the
    best rows of other labels follow whose score is from `low` to `high` percent
    of the positive's, from rank 1.
    """
    spark = df.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, pivots = pivot_table(df, key, F.col(label) if isinstance(label, str) else label, vector, anchor, scale)
    if pivots is None:
        return spark.createDataFrame([], names)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = int(min(max(rows.count() // (2 * partitions), LEAST_ROWS), BLOCK_ROWS))
    anchors = rows.filter("anchor").select("uid", "key", "label", "v", "towards")
    what = rows.select("uid", "key", "label", "cell", "v", "away")

    by_label = stored(cells(rows, ["label"], block_rows), "negatives-cells")
    groups = by_label.groupBy("label").agg(F.collect_list(F.struct("cell", "n", "blocks", "low", "high")).alias("cells"))
    aimed = anchors.join(groups, "label").select("uid", "key", "label", "v", "towards", "cells")
    aimed = aimed.mapInArrow(partial(_aimed, pivots=pivots, positives=positives), f"{ANCHOR}, limit double, {CELLS}").withColumn("bl", F.col("label"))
    counts = maybe_broadcast(by_label.select("label", "cell", "blocks"), 32)
    dealt = what.join(counts, ["label", "cell"]).withColumn("bs", F.pmod(F.xxhash64("uid"), F.col("blocks"))).withColumn("bl", F.col("label")).withColumnRenamed("cell", "bc").drop("blocks")
    found = _meet(dealt, aimed, partitions).mapInArrow(
        partial(_met, pivots=pivots, find=partial(_best, most=positives), names=["uid", "other", "score", "other_uid"]), "uid long, other long, score long, other_uid long"
    )
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "other", "other_uid")
    first = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    # at most `positives` rows an anchor
    lists = first.filter("score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", F.col("other").alias("key"), "score"))).alias("positives"))
    told = stored(anchors.join(lists, "uid"), "negatives-positives")

    # as many rows as pivots, whatever the table holds
    where = [r.asDict() for r in stored(cells(rows, [], block_rows), "negatives-all-cells").collect()]
    blocks = F.element_at(F.create_map(*[F.lit(x) for c in where for x in (c["cell"], c["blocks"])]), F.col("cell"))
    windowed = told.mapInArrow(partial(_windowed, pivots=pivots, low=low, high=high, where=where), f"{ANCHOR}, {POSITIVES}, nearest double, farthest double, {CELLS}").withColumn("bl", F.lit(0))
    dealt = what.withColumn("bs", F.pmod(F.xxhash64("uid"), blocks)).withColumn("bl", F.lit(0)).withColumnRenamed("cell", "bc")
    columns = ["uid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    hard = _meet(dealt, windowed, partitions).mapInArrow(
        partial(_met, pivots=pivots, find=partial(_between, most=negatives, low=low, high=high), names=columns), ", ".join(f"{c} long" for c in columns)
    )
    ranks = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = hard.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= negatives)
    return out.select(*[c.split()[0] for c in names.split(", ")])
