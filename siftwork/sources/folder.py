"""Folder sources: a batch listing with ignore rules, a counted guard, a streaming source of changes, text reading."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import is_blank

# Fixed values.
LOCK_FILES = ["Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum"]
BROAD_FOLDERS = ["/Users", "/System", "/Library", "/Applications", "/Volumes"]
MAX_FILES = 2000
COUNT_SECONDS = 3.0
SUGGESTIONS = 15
# End of fixed values.


def too_broad(path: str) -> bool:
    plain = path.rstrip("/")
    return plain in ("", os.environ.get("HOME", "").rstrip("/"), *BROAD_FOLDERS)


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on relative paths, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+\Z", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out = ""
    i = 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (j := line.find("]", i + 2)) > 0:
            out, i = out + fnmatch.translate(line[i : j + 1])[4:-3], j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S), negated, only


class Ignore:
    """Rules of all ignore files between a root and a path; the last rule that fits decides."""

    def __init__(self, root: str):
        self.root = root
        self.rules: dict[str, list] = {}

    def of(self, folder: str) -> list:
        if folder not in self.rules:
            found = []
            for name in (".gitignore", ".ignore"):
                try:
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                        found += [p for p in map(_pattern, f) if p]
                except OSError:
                    pass
            self.rules[folder] = found
        return self.rules[folder]

    def ignored(self, path: str, is_dir: bool) -> bool:
        relative = os.path.relpath(path, self.root)
        parts = relative.split(os.sep)
        if any(p.startswith(".") for p in parts):
            return True
        hidden = False
        for depth in range(len(parts)):
            base = os.path.join(self.root, *parts[:depth])
            for pattern, negated, only in self.of(base):
                if (not only or is_dir) and pattern.match("/".join(parts[depth:])):
                    hidden = not negated
        return hidden


def walk(root: str, start: str | None = None, deep: bool = True):
    """(path, mtime_ns, size) of regular files that no rule ignores, without lock files, in order of path.

    A walk may start at a folder below the root, whose rules hold too, and may leave out folders.
    """
    root = os.path.realpath(root)
    rules = Ignore(root)
    stack = [start or root]
    while stack:
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name, reverse=True)
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if deep and not rules.ignored(e.path, True):
                    stack.append(e.path)
            elif e.is_file(follow_symlinks=False) and e.name not in LOCK_FILES and not rules.ignored(e.path, False):
                s = e.stat()
                yield e.path, s.st_mtime_ns, s.st_size


def count_files(root: str, cap: int = MAX_FILES, seconds: float = COUNT_SECONDS) -> int:
    """Files under a root, counted up to cap + 1; TimeoutError if that takes too long."""
    n, until = 0, time.monotonic() + seconds
    for _ in walk(root):
        n += 1
        if n > cap:
            break
        if time.monotonic() > until:
            raise TimeoutError(f"{root} takes more than {seconds} seconds to count")
    return n


class FolderSource(DataSource):
    """Format "folder": rows (op, path, mtime_ns). As a stream, new and edited files and deletions ("delete")."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "op string, path string, mtime_ns long"

    def reader(self, schema):
        return _FolderReader(self.options["path"])

    def simpleStreamReader(self, schema):
        return _FolderStream(self.options["path"])


class _FolderReader(DataSourceReader):
    """One input partition for each folder right below the root, and one for the root's own files."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def partitions(self):
        rules = Ignore(self.root)
        below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not rules.ignored(e.path, True)]
        return [InputPartition(None), *map(InputPartition, sorted(below))]

    def read(self, partition):
        for path, mtime, _ in walk(self.root, partition.value, deep=partition.value is not None):
            yield "scan", path, mtime


class _FolderStream(SimpleDataSourceStreamReader):
    """The offset is the listing itself, so that restarts re-read only what changed. Folders are bounded by MAX_FILES."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self):
        return {"files": "{}"}

    def read(self, start):
        old = json.loads(start["files"])
        new = {p: m for p, m, _ in walk(self.root)}
        rows = [("upsert", p, m) for p, m in new.items() if old.get(p) != m] + [("delete", p, old[p]) for p in old if p not in new]
        return iter(rows), {"files": json.dumps(new, sort_keys=True)}

    def readBetweenOffsets(self, start, end):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return iter([("upsert", p, m) for p, m in new.items() if old.get(p) != m] + [("delete", p, old[p]) for p in old if p not in new])

    def commit(self, end):
        pass


def read_texts(files: DataFrame) -> DataFrame:
    """files (path, ...) with `content`, strict UTF-8 text that is not blank, or null and the `problem`."""

    def load(batches):
        import pyarrow as pa

        for b in batches:
            data = []
            for p in b.column("path").to_pylist():
                try:
                    with open(p, "rb") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], [*b.schema.names, "raw"])

    kinds = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    raw = files.mapInArrow(load, f"{kinds}, raw binary")
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.decode("raw", "UTF-8"))
    problem = F.when(F.col("raw").isNull(), "cannot be read").when(text.isNull(), "is not UTF-8 text").when(is_blank(text), "has no text")
    return raw.withColumn("content", F.when(~is_blank(text), text)).withColumn("problem", problem).drop("raw")


def suggestions(partial: str) -> list[str]:
    """Folders that start like `partial`, at most SUGGESTIONS; hidden ones only if asked for."""
    full = os.path.expanduser(partial)
    parent, prefix = os.path.split(full)
    try:
        entries = [e for e in os.scandir(parent or "/") if e.is_dir()]
    except OSError:
        return []
    fits = [e.path for e in entries if e.name.lower().startswith(prefix.lower()) and (prefix.startswith(".") or not e.name.startswith("."))]
    return sorted(fits)[:SUGGESTIONS]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
