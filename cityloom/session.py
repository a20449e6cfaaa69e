"""Session helpers: table access, the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this; beyond it the shuffle join runs.
BROADCAST_LIMIT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, list[str]] = {}


def _base(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on one machine a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cityloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI that driver and executors share; remove_shared() deletes it."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_shared(spark: SparkSession) -> int:
    """Delete what this application's queries have stored so far; their results must have been read.  The number of folders."""
    from cityloom.sources.files import remove

    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        remove(p)
    return len(paths)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_base(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back (columnar, prunable)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions (by columns or evenly), for rows that each mean much work: a small file would leave them to a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows; a larger side keeps the shuffle join."""
    rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= limit else df
