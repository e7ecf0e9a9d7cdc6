"""Tables in the folder that the driver and all executors share: they cut a lineage, and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def partitions_by_size(df: DataFrame, part: int) -> int:
    """A partition for each ``part`` bytes that the plan expects, by the listed sizes of its files; the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session without a cluster, as in tests, gets one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = os.path.join(tempfile.gettempdir(), "evalloom-checkpoints")
    return d


def _remover(spark: SparkSession) -> Callable[[str], None]:
    """Removes a path; it also works once the context has stopped, while its JVM is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove(path: str) -> None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    return remove


def _at_exit(remove: Callable[[str], None], path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove(path)


_FOLDERS: set[str] = set()
_SCRATCH: list[list[str]] = []  # tables of the open scratch blocks, the innermost last


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a Parquet table in the shared folder and reads it back.

    An application's tables share one folder, which goes when the driver's process ends; ``discard`` removes a table before.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_at_exit, _remover(spark), folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that ``written`` made and that nothing reads any more."""
    _remover(df.sparkSession)(df._table)
    for tables in _SCRATCH:
        if df._table in tables:
            tables.remove(df._table)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that are written within the block go at its end, but for those that are taken from the list."""
    tables: list[str] = []
    _SCRATCH.append(tables)
    try:
        yield tables
    finally:
        _SCRATCH.pop()
        remove = _remover(spark)
        for path in tables:
            remove(path)
