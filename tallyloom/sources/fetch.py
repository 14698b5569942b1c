"""Driver-side fetching: retries, digests, revisions, caches.  Nothing here runs on executors."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Mapping
from datetime import date
from pathlib import Path

WEEKDAYS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")


def weekday_name(day: str) -> str:
    return WEEKDAYS[date.fromisoformat(day).weekday()]


def get_json(url: str, attempts: int = 3, wait_s: float = 1.0, opener: Callable = urllib.request.urlopen):
    """GET with linearly growing waits between attempts."""
    for n in range(1, attempts + 1):
        try:
            with opener(url) as r:
                return json.loads(r.read())
        except OSError:
            if n == attempts:
                raise
            time.sleep(wait_s * n)


def download(url: str, path: str, attempts: int = 3, wait_s: float = 1.0, opener: Callable = urllib.request.urlopen) -> tuple[str, int]:
    """Fetch to a file through a partial one; returns SHA-256 and size.  Waits double between attempts."""
    target, part = Path(path), Path(path + ".partial")
    for n in range(attempts):
        try:
            digest, size = hashlib.sha256(), 0
            with opener(url) as r, part.open("wb") as f:
                while chunk := r.read(1 << 20):
                    digest.update(chunk)
                    size += len(chunk)
                    f.write(chunk)
                wanted = r.headers.get("Content-Length") if getattr(r, "headers", None) else None
            if wanted is not None and int(wanted) != size:
                raise OSError(f"{size} of {wanted} bytes came")
            os.replace(part, target)
            return digest.hexdigest(), size
        except OSError:
            part.unlink(missing_ok=True)
            if n == attempts - 1:
                raise
            time.sleep(wait_s * 2**n)
    raise AssertionError("unreachable")


def is_fresh(path: str, max_age_s: float) -> bool:
    p = Path(path)
    return p.exists() and time.time() - p.stat().st_mtime < max_age_s


def cached(url: str, path: str, max_age_s: float, opener: Callable = urllib.request.urlopen, attempts: int = 3, wait_s: float = 1.0) -> bool:
    """Keep a copy of a document at ``path``, fetched anew when older than ``max_age_s``; returns whether it is that fresh.

    Where the source can't be had, an old copy serves on; without any copy the
    error goes on.
    """
    if is_fresh(path, max_age_s):
        return True
    try:
        download(url, path, attempts, wait_s, opener)
        return True
    except OSError:
        if not Path(path).exists():
            raise
        return False


def daily_archive(day: str, folder: str, resources: Mapping[str, str], opener: Callable = urllib.request.urlopen, wait_s: float = 1.0) -> str:
    """Path of a day's archive: one already in the folder that names the day, the last in text order, else that of the weekday's resource."""
    own = sorted(str(p) for p in Path(folder).glob(f"*{day}*") if re.search(r"\.(zip|tar|tar\.zst)$", p.name))
    if own:
        return own[-1]
    path = str(Path(folder) / f"{day}.zip")
    download(resources[weekday_name(day)], path, opener=opener, wait_s=wait_s)
    return path


def is_safe_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name)) and ".." not in name


def first_valid(entries: Iterable[dict], load: Callable[[dict], object]) -> tuple[object | None, list[dict]]:
    """Try revisions, in the order given (``audit.revision_order``), until one validates; the rejected ones come back with their errors."""
    rejected = []
    for entry in entries:
        try:
            return load(entry), rejected
        except ValueError as e:
            rejected.append({"revision": entry["id"], "url": entry["link"], "error": str(e)})
    return None, rejected
