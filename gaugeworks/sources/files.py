"""Finding input files, knowing them again, and putting them away.

Paths with a scheme (other than file:) are in a store that Spark's Hadoop file systems reach; they are listed, read and moved there.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import quote

from pyspark.sql import SparkSession

from gaugeworks.sources.records import format_of

# Names that are still written to, and the bytes that identify a file.
PARTIAL = (".tmp", ".part", ".partial", ".swp", "~")
HEAD = 64 << 10


@dataclass(frozen=True)
class Identity:
    """path, size, time and the first bytes, and one hash of all."""

    path: str
    size: int
    mtime_us: int
    head_sha256: str

    @property
    def hash(self) -> str:
        return hashlib.sha256("\0".join((self.path, str(self.size), str(self.mtime_us), self.head_sha256)).encode()).hexdigest()


def remote(path: str) -> bool:
    """Whether a path names another store than the local disk."""
    return "://" in path and not path.startswith("file:")


def place_of(path: str) -> str:
    """One name for a file, whether it is given or Spark tells it."""
    if remote(path):
        scheme, rest = path.split("://", 1)
        return f"{scheme}://{quote(rest, safe='/%:@+=,')}"
    return os.path.realpath(path.removeprefix("file://").removeprefix("file:"))


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def identity(path: str, spark: SparkSession | None = None) -> Identity:
    if remote(path):
        store, place = _store(spark or SparkSession.active(), path)
        status, stream = store.getFileStatus(place), store.open(place)
        try:
            head = hashlib.sha256(bytes(stream.readNBytes(HEAD))).hexdigest()
        finally:
            stream.close()
        return Identity(place_of(path), status.getLen(), status.getModificationTime() * 1000, head)
    found = os.stat(path)
    with open(path, "rb") as f:
        head = hashlib.sha256(f.read(HEAD)).hexdigest()
    return Identity(os.path.realpath(path), found.st_size, found.st_mtime_ns // 1000, head)


@dataclass
class Discovery:
    """scan() names each ready file once: marked .ready, or unchanged since the last scan and quiet for a while."""

    folder: str
    quiet_s: float = 5.0
    spark: SparkSession | None = None
    seen: dict[str, tuple[int, int]] = field(default_factory=dict)
    told: set[str] = field(default_factory=set)

    def scan(self, now: float | None = None) -> list[str]:
        now = time.time() if now is None else now
        out, before, self.seen = [], self.seen, {}
        for path, name, state, modified in self._files():
            if name.startswith(".") or name.endswith(PARTIAL) or not format_of(name) or path in self.told:
                continue
            self.seen[path] = state
            if name.endswith(".ready") or (before.get(path) == state and now - modified >= self.quiet_s):
                self.told.add(path)
                out.append(path)
        return out

    def _files(self) -> list[tuple[str, str, tuple[int, int], float]]:
        """Path, name, size with time, and seconds of the folder's plain files, by path."""
        if remote(self.folder):
            store, place = _store(self.spark or SparkSession.active(), self.folder)
            found = [(x.getPath().toString(), x.getPath().getName(), (x.getLen(), x.getModificationTime()), x.getModificationTime() / 1000) for x in store.listStatus(place) if x.isFile()]
            return sorted(found)
        plain = [p for p in sorted(Path(self.folder).iterdir()) if not p.is_symlink() and p.is_file()]
        return [(str(p), p.name, ((s := p.stat()).st_size, s.st_mtime_ns), s.st_mtime) for p in plain]


def put_away(path: str, root: str, digest: str, by_date: bool = True, report: dict | None = None) -> str:
    """Move a file below root (by year, month and day) without replacing one; once more with its hash, then an error."""
    if remote(path) or remote(root):
        return _put_away_remote(path, root, digest, by_date, report)
    folder = os.path.join(root, *time.strftime("%Y %m %d", time.gmtime()).split()) if by_date else root
    os.makedirs(folder, exist_ok=True)
    stem, end = os.path.splitext(os.path.basename(path))
    for name in (stem + end, f"{stem}-{digest[:8]}{end}"):
        place = os.path.join(folder, name)
        try:
            os.link(path, place)
        except FileExistsError:
            continue
        except OSError:  # another device, or no links there
            if os.path.exists(place):
                continue
            shutil.copy2(path, place + ".part")
            if os.path.getsize(place + ".part") != os.path.getsize(path):
                raise
            os.rename(place + ".part", place)
        os.unlink(path)
        if report is not None:
            with open(place + ".report.json", "w", encoding="utf-8") as f:
                json.dump(report, f, indent=2, sort_keys=True)
        return place
    raise FileExistsError(f"{path}: its names in {folder} are taken")


def _put_away_remote(path: str, root: str, digest: str, by_date: bool, report: dict | None) -> str:
    """The same by the store's rename, which replaces nothing; from one store to another by a copy of the same length."""
    spark = SparkSession.active()
    folder = "/".join([root.rstrip("/"), *(time.strftime("%Y %m %d", time.gmtime()).split() if by_date else [])])
    (store, source), (target, _) = _store(spark, path), _store(spark, folder)
    target.mkdirs(_store(spark, folder)[1])
    stem, end = os.path.splitext(source.getName())
    for name in (stem + end, f"{stem}-{digest[:8]}{end}"):
        _, place = _store(spark, f"{folder}/{name}")
        if target.exists(place):
            continue
        if not _renamed(store, source, place, path, folder):
            part = _store(spark, f"{folder}/{name}.part")[1]
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, target, part, False, spark._jsc.hadoopConfiguration())
            if target.getFileStatus(part).getLen() != store.getFileStatus(source).getLen() or not target.rename(part, place):
                raise OSError(f"{path}: not copied whole to {folder}")
            store.delete(source, False)
        if report is not None:
            out = target.create(_store(spark, f"{folder}/{name}.report.json")[1], True)
            out.write(json.dumps(report, indent=2, sort_keys=True).encode())
            out.close()
        return f"{folder}/{name}"
    raise FileExistsError(f"{path}: its names in {folder} are taken")


def _renamed(store: Any, source: Any, place: Any, path: str, folder: str) -> bool:
    """Moved within one store; False where the places are in different ones."""
    if path.split("/", 3)[:3] != folder.split("/", 3)[:3]:
        return False
    try:
        return bool(store.rename(source, place))
    except Exception:  # noqa: BLE001  mounts of one name may lie in different stores
        return False


def inside(path: str, root: str) -> bool:
    """Whether a path, links resolved, lies in a folder."""
    return os.path.commonpath([os.path.realpath(path), os.path.realpath(root)]) == os.path.realpath(root)
