"""Places that every executor can read, for tables that are computed once and used several times."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Removes the shuffle files of a query when it ends; what ``written`` computes is then in its table.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where none is named, on one machine (tests)."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparquill-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, path: str, **options: str) -> None:
    """Writes ``df`` as Parquet, with the writer's options, and frees the shuffles that made it."""
    spark = df.sparkSession
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    written_to(df, path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file, whole or not at all."""
    place, store = _place(spark, path)
    store.create(place, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place, store = _place(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


@contextmanager
def passing(spark: SparkSession) -> Iterator:
    """Removes the tables ``written`` inside the block when it ends, but for those given to the function it yields.

    A kept table belongs to the block around, if there is one. Frames that outlive the block may read
    kept tables only.
    """
    kept = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_path)
        return df

    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield keep
    finally:
        own = _scopes.open.pop()
        for path in own:
            if path not in kept:
                remove(spark, path)
            elif _scopes.open:
                _scopes.open[-1].append(path)
