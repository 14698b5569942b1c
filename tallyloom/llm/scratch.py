"""Shared, recoverable scratch tables.

Every intermediate that cuts a lineage is written below the folder that the
cluster names in ``spark.checkpoint.dir``; all executors and the driver reach
it, so a lost executor costs its running tasks only.  Where the setting is
absent a temporary folder is made and set once, but only if the executors run on
this machine; on a cluster that would be a folder of its own on every machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import ship_code


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one of our own if unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    sc.setCheckpointDir(own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may have ended before the interpreter
        pass


class Scratch:
    """A family of scratch tables that go when the ``with`` block ends.

    ``table`` writes a frame as Parquet and reads it again; ``keep`` does the
    same for a result that must outlive the block (it goes at interpreter exit).
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
        self._kept = f"{self.base}-kept"
        self._n = 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        delete(self.spark, self.base)
        if exc[0] is not None:
            delete(self.spark, self._kept)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove the files behind a table that no later step reads."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(self.base.split(":", 1)[-1].lstrip("/")):
                delete(self.spark, folder)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        path = f"{self._kept}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        atexit.register(_delete_at_exit, self.spark, self._kept)
        return self.spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
