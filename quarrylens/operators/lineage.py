"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What cut() has written and nobody has deleted, the innermost scope last.
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the context's checkpoint folder, or on one machine a temporary one that becomes it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not path and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='quarrylens-')}")
    return (path or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: a lost executor costs no recomputation.

    What was shuffled for it is deleted at once; else it stays until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylens/{uuid.uuid4().hex}"
    _written[-1].append(path)
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def register(path: str) -> None:
    """A folder that something else wrote, for clean() and the scope that it belongs to."""
    _written[-1].append(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes what a frame of cut() was read from; any other frame stays as it is."""
    path = getattr(df, "_cut_path", None)
    for paths in _written:
        if path in paths:
            paths.remove(path)
            _delete(df.sparkSession, [path])


@contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes what cut() wrote inside, but for the frames that are put into the list that it gives.

    Only a frame that cut() returned may leave; one that reads other files of the scope would find them gone.
    """
    kept: list[DataFrame] = list(keep)
    _written.append([])
    try:
        yield kept
    finally:
        mine = _written.pop()
        stay = {getattr(df, "_cut_path", None) for df in kept}
        _written[-1] += [p for p in mine if p in stay]
        _delete(spark, [p for p in mine if p not in stay])


def clean(spark: SparkSession) -> None:
    """Deletes all that cut() has written in this process and that is left; frames that read it can no longer be used."""
    for paths in _written:
        _delete(spark, paths)
        paths.clear()
