"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in local mode, where driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexitide-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as shuffles have, if its files give fewer: for work that outweighs moving the rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Rows that go to a Python worker at a time while an intermediate table is written. Rows hold whole texts or sets, so
#: the usual ten thousand take much memory on both sides.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Whether the files of a query's shuffles go at its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def temporary():
    """Deletes the intermediate tables that are begun inside, at the end: for results that have been stored elsewhere."""
    before = set(map(id, Scratch.live))
    yield
    for scratch in [s for s in Scratch.live if id(s) not in before]:
        scratch.clear()


class Scratch:
    """Tables under a folder of their own: they cut the lineage and survive lost executors.

    A result may read them whenever it is asked for, so what is not dropped before goes at the end of the process.
    """

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, tag: str, tidy: bool = False):
        """tidy: the shuffles of a table go as soon as it is saved."""
        self.tidy = tidy
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.names: set[str] = set()
        self.live.append(self)
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with setting(self.spark, BATCH, str(min(ROWS, int(self.spark.conf.get(BATCH))))), setting(self.spark, CLEANUP, "true") if self.tidy else nullcontext():
            df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self._conf).delete(p, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        for name in names:
            self._delete(self.path(name))
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Drops all saved tables but those that the result still reads."""
        self.drop(*(self.names - set(names)))

    def clear(self) -> None:
        """Deletes the whole folder; whoever ended the JVM before has to do it by hand."""
        atexit.unregister(self.clear)
        self.live[:] = [s for s in self.live if s is not self]
        try:
            self._delete(self.root)
        except Exception:  # the JVM is gone
            return
