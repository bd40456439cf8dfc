"""Source trees as DataFrames: filtered listing, reading, decoding.

Spark's binary file source hides names that begin with a dot or an underscore, which source trees
have. So tasks list folders, level by level, where the tree is mounted: a level's folders are dealt to all tasks, an excluded
one is not entered, and neither folders nor files come to the driver. Files are then dealt by their bytes and read.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.paths import to_posix
from lodeframe.shipping import ship
from lodeframe.sources.scratch import settled

MAX_BYTES = 5_000_000
# fixed values: how binary content is told
SNIFFED, MOST_CONTROL = 2048, 0.3
CONTROL = bytes([*range(9), 11, 12, *range(14, 32), 127])


@dataclass(frozen=True)
class Filter:
    """What of a tree is taken. Patterns are compared in lower case."""

    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    include_dirs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)
    never_index_ext: list[str] = field(default_factory=list)
    assets_template_only: bool = False
    assets_root_dir: str = ""
    assets_template_dir: str = ""

    def keeps_dir(self, name: str) -> bool:
        return not any(_same_or_match(name.lower(), p.lower()) for p in self.exclude_patterns if p)

    def keeps(self, path: Path, relative: str) -> bool:
        low = relative.replace("\\", "/").lower()
        return (
            (not self.include_dirs or any(_within(low, d) for d in self.include_dirs if d))
            and not self._excluded(path)
            and not any(fnmatch.fnmatchcase(low, g.replace("\\", "/").lower()) for g in self.exclude_globs if g)
            and path.suffix.lower() not in {e.lower() for e in self.never_index_ext if e}
            and not (self.assets_template_only and self._asset(relative))
            and self._included(path)
        )

    def _excluded(self, path: Path) -> bool:
        parts, whole = {p.lower() for p in path.parts}, str(path).lower()
        return any(p.lower() in parts or _wild(p) and fnmatch.fnmatchcase(whole, p.lower()) for p in self.exclude_patterns if p)

    def _included(self, path: Path) -> bool:
        name, suffix = path.name.lower(), path.suffix.lower()

        def fits(p: str) -> bool:
            return fnmatch.fnmatchcase(name, p) if _wild(p) else suffix == p if p.startswith(".") else name == p

        return not self.include_patterns or any(fits(p.lower()) for p in self.include_patterns if p)

    def _asset(self, relative: str) -> bool:
        top, kept = (d.replace("\\", "/").strip("/") for d in (self.assets_root_dir, self.assets_template_dir))
        inside = lambda d: relative == d or relative.startswith(d + "/")
        return bool(top) and inside(top) and not inside(kept)


def _wild(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def _same_or_match(value: str, pattern: str) -> bool:
    return value == pattern or _wild(pattern) and fnmatch.fnmatchcase(value, pattern)


def _within(low: str, pattern: str) -> bool:
    p = pattern.replace("\\", "/").strip("/").lower()
    if not _wild(p):
        return low == p or low.startswith(p + "/")
    return Path(low).match(p) if "/" in p else fnmatch.fnmatchcase(low, p)


def entries(top: Path, folder: str, keep: Filter) -> Iterator[tuple[str, str, int, bool]]:
    """(absolute path, relative posix path, bytes, is a folder) of the files taken and the folders to enter in one folder;
    links to folders are not followed. A folder that cannot be listed has nothing."""
    try:
        found = sorted(os.scandir(top / folder), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        path = top / folder / e.name
        try:
            inner = e.is_dir()
            size = 0 if inner else e.stat().st_size
        except OSError:  # reading it says why
            inner, size = False, 0
        if inner:
            if not e.is_symlink() and keep.keeps_dir(e.name):
                yield str(path), f"{folder}/{e.name}".lstrip("/"), 0, True
            continue
        real = path.resolve()
        relative = to_posix((real.relative_to(top) if real.is_relative_to(top) else path).as_posix())
        if keep.keeps(path, relative):
            yield str(path), relative, size, False


def list_tree(spark: SparkSession, root: str | Path, keep: Filter = Filter(), folders_per_task: int = 200) -> DataFrame:
    """full, path and size of each file taken: one job for each level of the tree."""
    ship(spark)
    top = Path(root).resolve()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(entries(top, folder, keep))
                for k in range(0, len(rows), 10_000):
                    part = list(zip(*rows[k : k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.bool_())], names=["full", "path", "size", "folder"])

    level, found, n = spark.createDataFrame([("",)], "path string"), None, 1
    while n:
        tasks = max(1, -(-n // folders_per_task))
        here = settled(level.repartition(tasks).mapInArrow(look, "full string, path string, size bigint, folder boolean"), "level")
        own = here.where("NOT folder").select("full", "path", "size")
        found = own if found is None else found.unionByName(own)
        level = here.where("folder").select("path")
        n = level.count()
    return found


def is_binary(data: bytes) -> bool:
    sample = data[:SNIFFED]
    return b"\0" in sample or len(sample) > 0 and len(sample) - len(sample.translate(None, CONTROL)) > MOST_CONTROL * len(sample)


def decoded(data: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def read_one(path: str, max_bytes: int = MAX_BYTES) -> tuple[str | None, str | None, int | None, datetime | None]:
    """Text or reason to skip, size and time of change."""
    try:
        stat = os.stat(path)
    except OSError:
        return None, "stat_failed", None, None
    when = datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc)
    if stat.st_size > max_bytes:
        return None, "too_large", stat.st_size, when
    try:
        data = Path(path).read_bytes()
    except OSError:
        return None, "read_failed", stat.st_size, when
    return (None, "binary", stat.st_size, when) if is_binary(data) else (decoded(data), None, stat.st_size, when)


FILES = "path string, text string, skip_reason string, size_bytes bigint, mtime timestamp"


def read_tree(spark: SparkSession, root: str | Path, keep: Filter = Filter(), max_bytes: int = MAX_BYTES, bytes_per_task: int = 64 << 20, files_per_task: int = 20_000) -> DataFrame:
    """path (relative), text or skip_reason, size_bytes, mtime for each file of the tree."""
    paths = list_tree(spark, root, keep)
    # a file that is read has at most max_bytes, so that a hash deals bytes evenly
    n, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.least("size", F.lit(max_bytes))), F.lit(0))).first()
    paths = paths.repartition(max(1, -(-size // bytes_per_task), -(-n // files_per_task)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):  # a few files at a time
                part = batch.slice(k, 64)
                got = [read_one(p, max_bytes) for p in part.column(0).to_pylist()]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], names=["path", "text", "skip_reason", "size_bytes", "mtime"])

    return paths.select("full", "path").mapInArrow(read, FILES)


def with_norm(files: DataFrame) -> DataFrame:
    return files.withColumn("path_norm", F.lower(F.replace("path", F.lit("\\"), F.lit("/"))))
