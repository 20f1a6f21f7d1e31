"""Cutting the lineage of loops in a way that outlives executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from .ship import ship

#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED = "/tmp/checkpoints/netloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths that this process has written, for drop_shared(); within temporary_state(), those written there.
WRITTEN: list[str] = []
_NOTED: ContextVar[list[str]] = ContextVar("netloom_written", default=WRITTEN)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    _NOTED.get().append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _NOTED.get()[-1]


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind; for writes, whose shuffles nothing else reads."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialized(df: DataFrame, kind: str = "state") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later jobs neither recompute it nor need its executors or its shuffles."""
    path = shared_path(df.sparkSession, kind)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that materialized() gave, once nothing that is still to run reads them; others are left alone."""
    for table in tables:
        if table in _PATH_OF:
            drop_shared(table.sparkSession, [_PATH_OF.pop(table)])


def drop_shared(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete paths (all that this process has written, unless given), once no result that reads them is needed any more; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths, n = WRITTEN if paths is None else paths, 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextmanager
def temporary_state(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives keep(df, kind), which writes a table to stay; all else that is written to the shared folder inside is deleted at the end."""
    outer, noted = _NOTED.get(), []
    token = _NOTED.set(noted)

    def keep(df: DataFrame, kind: str) -> DataFrame:
        out = materialized(df, kind)
        outer.append(noted.pop())
        return out

    try:
        yield keep
    finally:
        _NOTED.reset(token)
        drop_shared(spark, noted)
