"""The scratch folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open `passing()` the tables that go at its end.
_open: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a folder of our own in local mode, as in tests; on a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if root is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="driftloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go when it is written: for plans that are not run again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. options: of the Parquet writer."""
    return _written(df, name, -1, options)


def _written(df: DataFrame, name: str, scope: int, options: dict[str, str] | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    with own_shuffles(df.sparkSession):
        df.write.options(**options or {}).parquet(path)
    if len(_open) >= -scope:
        _open[scope].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that materialise() writes within are deleted at the end. Gives a function that writes one that stays."""
    _open.append([])
    try:
        yield lambda df, name: _written(df, name, -2)
    finally:
        for path in _open.pop():
            _delete(spark, path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, written once, to be broadcast if it has at most `rows` rows; else as it is, for a shuffled join."""
    df = materialise(df, "side")
    return F.broadcast(df) if df.count() <= rows else df


def discard(df: DataFrame) -> None:
    """Delete the table that materialise() gave as df, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
