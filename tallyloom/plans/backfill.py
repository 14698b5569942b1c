"""Import of past days from an index of archived revisions, with a manifest that lets it resume.

The index names, for each day, the revisions of its archive.  Days run one after
another, each as one Spark job over its archive; the manifest gets a row as soon
as a day ends, whatever its end.  A day whose snapshot is there is left alone,
so a run that broke off goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import http.client
import os
import tarfile
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import audit, sinks
from tallyloom.operators.basket_catalogue import CHAINS
from tallyloom.plans import daily
from tallyloom.sources import fetch

VERSION = "archive-import-1"
_ENTRY = "d date, id long, name string, link string, first_seen string, has_warnings boolean"
MANIFEST = (
    "d date, status string, branches long, observations long, duplicate_rows long, conflicts long, url string, revision long, sha256 string, compressed_bytes long, "
    "import_version string, seconds double, rejected array<struct<revision: long, url: string, error: string>>"
)


def index_entries(spark: SparkSession, index: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    """One row per revision of the index."""
    import datetime

    rows = [(datetime.date.fromisoformat(d), e["id"], e["name"], e.get("link"), e.get("firstSeenAt"), bool(e.get("warnings"))) for d, es in index.items() for e in es]
    return spark.createDataFrame(rows, _ENTRY)


def revisions(entries: DataFrame, days: DataFrame) -> dict[str, list[dict]]:
    """The revisions of the given days in the order they are tried: an index of some thousand rows."""
    rows = audit.linked(entries).join(days, "d", "left_semi").withColumn("k", audit.revision_order()).orderBy("d", "k")
    found: dict[str, list[dict]] = {}
    for r in rows.select("d", "id", "name", "link", "first_seen").toLocalIterator():
        found.setdefault(str(r["d"]), []).append(r.asDict())
    return found


def _import_day(spark: SparkSession, day: str, entry: dict, output: str, cache: str, exclusions: dict | None, keep: bool, opener: Callable) -> dict:
    if not fetch.is_safe_name(entry["name"]):
        raise ValueError(f"unsafe archive name {entry['name']!r}")
    path = os.path.join(cache, entry["name"])
    if Path(path).exists():
        with open(path, "rb") as f:
            digest, size = hashlib.file_digest(f, "sha256").hexdigest(), os.path.getsize(path)
    else:
        digest, size = fetch.download(entry["link"], path, opener=opener)
    source = {"url": entry["link"], "revision": entry["id"], "first_seen_at": entry["first_seen"], "sha256": digest, "compressed_bytes": size, "import_version": VERSION}
    counts = daily.run_day(spark, path, day, f"{output}/raw", f"{output}/snapshots", chains=CHAINS, exclusions=exclusions, source=source)
    if not keep:
        os.unlink(path)
    return counts | {"url": entry["link"], "revision": entry["id"], "sha256": digest, "compressed_bytes": size, "import_version": VERSION}


def _existing(spark: SparkSession, output: str, days: DataFrame) -> DataFrame:
    """Days with a finished snapshot."""
    done = []
    for r in days.toLocalIterator():  # one row a day
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output}/snapshots/date={r['d']}/_SUCCESS")
        if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            done.append((r["d"],))
    return spark.createDataFrame(done, "d date")


def backfill(spark: SparkSession, index: Mapping[str, Sequence[Mapping]], start: str, end: str, output: str, cache: str, exclusions: dict | None = None, keep_archives: bool = False, opener: Callable = urllib.request.urlopen) -> DataFrame:
    """Import the days from ``start`` to ``end``; returns the manifest's latest row of each day.

    A day is existing, unavailable (no revision has a link), imported, or failed
    with the errors of all its revisions.  ``cache`` is a folder that the driver
    and the executors share.
    """
    os.makedirs(cache, exist_ok=True)
    days = audit.day_range(spark, start, end)
    entries = index_entries(spark, index)
    states = audit.work_list(days, _existing(spark, output, days), audit.linked(entries).select("d")).orderBy("d").collect()
    tried = revisions(entries, days)
    for row in states:
        day, began = str(row["d"]), time.monotonic()
        record: dict = {"d": row["d"], "status": row["state"]}
        if row["state"] == "to do":
            load = lambda entry, day=day: _checked(_import_day, spark, day, entry, output, cache, exclusions, keep_archives, opener)
            found, rejected = fetch.first_valid(tried[day], load)
            record |= {"status": "imported" if found else "failed", "rejected": rejected or None, "seconds": time.monotonic() - began} | (found or {})
        sinks.append_manifest(spark.createDataFrame([record], MANIFEST), f"{output}/manifest")
    return sinks.read_manifest(spark, f"{output}/manifest").where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


#: What makes a revision unusable: no download, a broken archive, a wrong day or header.  Anything else stops the run.
UNUSABLE = ("BadZipFile", "ReadError", "ZstdError", "ValueError", "EOFError", "zlib.error")


def _checked(load: Callable, *args) -> dict:
    """A revision that can't be used lets the next one be tried; other failures (a full disk, a lost cluster) aren't its fault and go on."""
    try:
        return load(*args)
    except (ValueError, zipfile.BadZipFile, tarfile.TarError, urllib.error.URLError, http.client.HTTPException, ConnectionError, TimeoutError) as e:
        raise ValueError(f"{type(e).__name__}: {str(e)[:500]}") from e
    except PythonException as e:  # raised while a task read the archive
        if not any(name in str(e) for name in UNUSABLE):
            raise
        raise ValueError(f"{type(e).__name__}: {str(e)[:500]}") from e
