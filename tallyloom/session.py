"""Making the package known to Spark's Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_PACKAGE = Path(__file__).resolve().parent.name


def ship_code(spark: SparkSession) -> None:
    """Let workers import this package, once per context.

    A local master's workers share the driver's disk and get its place in
    PYTHONPATH; on a cluster the package travels as an archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tallyloom_shipped", False):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        paths = [str(_ROOT), *filter(None, sc.environment.get("PYTHONPATH", "").split(os.pathsep))]
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    else:
        name = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE}.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted((_ROOT / _PACKAGE).rglob("*.py")):
                z.write(file, file.relative_to(_ROOT))
        sc.addPyFile(name)
    sc._tallyloom_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach: below ``spark.checkpoint.dir``, or a local one where they share a machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + tempfile.gettempdir()
    path = f"{named.rstrip('/')}/tallyloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before the interpreter
        pass
