"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open ``discarded`` blocks of this thread, the innermost last.
_scopes: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="freightgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table as read back, and its path.

    This cuts the lineage, fixes values that depend on a task's position (partition ids, running
    numbers), and survives the loss of any executor.
    """
    spark = df.sparkSession
    scopes = _scopes.get()
    path = f"{scopes[-1] if scopes else shared_dir(spark) + '/tables'}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored`` without the path."""
    return stored(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` in this block are deleted at its end: write what is to outlive it before that.

    A query's own tables outlive it otherwise, as its result reads them; whoever runs it in such a block owns
    them. Blocks of different threads do not see each other.
    """
    folder = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete(spark, folder)


class Versions:
    """Rows of a table in versions, the least of which hold: what changed is added, and all is merged when it has doubled."""

    def __init__(self, spark: SparkSession, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.merge, self.paths, self.rows, self.merged = spark, merge, [], 0, 0
        self.spent: list[str] = []  # versions that were merged; the next frontier may still read the last of them

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.paths)

    def add(self, path: str, rows: int, columns: list[str]) -> None:
        self._drop()
        self.columns = columns
        self.paths.append(path)
        self.rows += rows
        if len(self.paths) > 2 and self.rows > 2 * self.merged + 1_000_000:
            self.settle()

    def settle(self) -> DataFrame:
        """One version of all."""
        whole, path = stored(self.merge(self.read().select(self.columns)), "settled")
        self._drop()
        self.spent = self.paths
        self.paths, self.rows = [path], whole.count()
        self.merged = self.rows
        return whole

    def _drop(self) -> None:
        for path in self.spent:
            delete(self.spark, path)
        self.spent = []
