"""A versioned chunk table on Parquet, kept as a log: a write adds one small delta, and a manifest names what holds.

A part is a folder's list of segments: a base, then deltas. A delta has rows and a list of paths (`gone`) whose rows in
earlier segments count no more. So a write costs what it changes, not what its folder holds. Deltas above MAX_DELTAS are
merged into one, and with more than MAX_GONE replaced paths into the base. optimize() lays a part out by cells of like
vectors, so that search() reads only cells that can hold one of the k best (see cells.py).

Writers publish by creating the next manifest if it is absent. A writer that comes second reads the new version and
changes that, so that two processes lose nothing. Readers resolve the manifest for each query; what an open plan may
still read is kept until vacuum().
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rank, text
from ..schema import CHUNKS, COLUMNS, TIES, backfill
from . import cells, search

STORED = CHUNKS + ", terms array<long>"
#: Which row of which file a row is.
PLACE = {"_file": "_metadata.file_path", "_row": "_metadata.row_index"}
GONE = "folder string, path string"
#: Deltas of a part before they are merged, replaced paths of them before the base is written anew, attempts to publish.
MAX_DELTAS, MAX_GONE, TRIES = 8, 10_000, 100
#: Replaced paths, by the manifest's counts, that are sent to all tasks; more are joined by Spark's choice.
BROADCAST_GONE = 100_000

Parts = dict[str, list[dict]]
_locks: dict[str, threading.RLock] = {}


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._lock = _locks.setdefault(self.root, threading.RLock())
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Of the last search(): cells and their rows, and how many of them it read.
        self.last_search: dict[str, int] = {}

    # The manifest: {"parts": {folder: [segment, ...]}}; a segment is {"rows", "gone", "n_gone", "cells"}.

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()[9:-5]) for s in self._fs.globStatus(self._path(f"{self.root}/MANIFEST-*.json")) or [])

    def _manifest(self) -> tuple[int, Parts]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/MANIFEST-{numbers[-1]:012d}.json"))
        try:
            parts = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()
        # A version of before the log names one folder of rows without terms.
        return numbers[-1], {f: [{"rows": s, "gone": None, "n_gone": 0, "cells": None, "old": True}] if isinstance(s, str) else s for f, s in parts.items()}

    def _create(self, number: int, parts: Parts) -> bool:
        """Create a manifest whole; False if another process has published this number."""
        temp, name = f"{self.root}/.manifest-{uuid.uuid4().hex}", f"{self.root}/MANIFEST-{number:012d}.json"
        out = self._fs.create(self._path(temp), True)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        if self._fs.getUri().getScheme() != "file":
            return bool(self._fs.rename(self._path(temp), self._path(name)))  # fails where the name exists
        plain = lambda p: self._path(p).toUri().getPath()
        try:
            os.link(plain(temp), plain(name))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(temp), False)
        return True

    def _commit(self, change: Callable[[Parts], Parts | None]) -> bool:
        """Publish change(parts); where another process came first, its version is changed. False if change() gives up."""
        for _ in range(TRIES):
            number, parts = self._manifest()
            new = change({f: list(s) for f, s in parts.items()})
            if new is None:
                return False
            if self._create(number + 1, new):
                return True
        raise RuntimeError("other writers published all versions that were tried")

    # Reading.

    def _files(self, segments: list[dict], chosen: dict[str, list[str]]) -> DataFrame:
        """The rows of segments; of those in `chosen` only the given folders of cells."""
        new = [p for s in segments if not s.get("old") for p in chosen.get(s["rows"], [s["rows"]])]
        old = [s["rows"] for s in segments if s.get("old")]
        # Folders of cells are given by name where few are read, so partitions need no discovery.
        load = self.spark.read.option("recursiveFileLookup", True).schema(STORED)
        placed = lambda df: df.select("*", *[F.col(c).alias(n) for n, c in PLACE.items()])
        out = placed(load.parquet(*new)) if new else None
        if old:
            rows = backfill(placed(self.spark.read.option("mergeSchema", True).parquet(*old)), *PLACE)
            rows = rows.withColumn("terms", text.stored_terms(F.col("content")))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], STORED + ", _file string, _row long") if out is None else out

    def _live(self, parts: Parts, chosen: dict[str, list[str]] | None = None) -> DataFrame:
        """What holds of parts: rows of last segments, and of earlier ones those whose path no later delta names.

        The plan has one scan for each level of segments, however many folders there are.
        """
        chosen = chosen or {}
        out = self._files([s[-1] for s in parts.values() if s], chosen)
        depth = max((len(s) for s in parts.values()), default=0)
        if depth < 2:
            return out
        level = lambda i, df: df.withColumn("_level", F.lit(i))
        below, gone = None, None
        for i in range(depth - 1):
            rows = level(i, self._files([s[i] for s in parts.values() if len(s) > i + 1], chosen))
            lost = level(i + 1, self.spark.read.schema(GONE).parquet(*[s[i + 1]["gone"] for s in parts.values() if len(s) > i + 1]))
            below, gone = (rows, lost) if below is None else (below.unionByName(rows), gone.unionByName(lost))
        latest = gone.groupBy(F.col("folder").alias("_f"), F.col("path").alias("_p")).agg(F.max("_level").alias("_until"))
        if sum(x["n_gone"] for s in parts.values() for x in s) <= BROADCAST_GONE:
            latest = F.broadcast(latest)
        kept = below.join(latest, (F.col("folder") == F.col("_f")) & (F.col("path") == F.col("_p")) & (F.col("_level") < F.col("_until")), "left_anti")
        return out.unionByName(kept.drop("_level"))

    def read(self) -> DataFrame:
        """The current version; never keep it across queries."""
        return self._live(self._manifest()[1]).select(*COLUMNS)

    def row_count(self) -> int:
        return self.read().count()

    def search(self, query: str, vector: list[float], k: int, folder: str | None = None, exclude: str | None = None, weights: rank.RankingWeights = rank.RankingWeights(), as_question: bool | None = None, model: str | None = None) -> DataFrame:
        """search.hybrid_search() over the current version, which reads of parts with cells only those that can matter.

        Scores need no content. The best cells and all rows without cells give a k-th best score; only cells whose bound
        reaches it are read then. The k rows found fetch their contents, by a filter on paths that reaches Parquet.
        """
        if k <= 0:
            return self.spark.createDataFrame([], CHUNKS).withColumn("score", F.lit(0.0)).select(*search.HIT, "chunk_ord")
        parts = self._manifest()[1]
        asked = text.question(query) if as_question is None else as_question
        known = [(bound, s["rows"], cell, n) for p in parts.values() for s in p if s["cells"] for bound, cell, n in cells.bounds(self.spark, s["cells"], query, vector, weights, asked)]
        known.sort(key=lambda x: (-x[0], x[1], x[2]))
        celled = {s["rows"] for p in parts.values() for s in p if s["cells"]}
        first, rows = [], 0
        while len(first) < len(known) and (rows < 4 * k or known[len(first)][0] == float("inf")):
            rows += known[len(first)][3]
            first.append(known[len(first)])

        def best(taken, others: bool) -> list:
            """The k best keys of some cells, and of what has no cells if others."""
            paths = {r: [f"{r}/cell={c}" for _, x, c, _ in taken if x == r] for r in celled}
            use = {f: s if others else [x if x["rows"] in celled else x | {"skip": True} for x in s] for f, s in parts.items()}
            found = search.scoped(self._chosen(use, paths), folder, exclude, model)
            score = search.hybrid_score(found, query, vector, weights, asked)
            return search.top(found.withColumn("score", score), k).select(*PLACE, *TIES, "score").collect()

        hits = best(first, True)
        least = hits[-1].score if len(hits) == k and hits[-1].score is not None else float("-inf")
        rest = [x for x in known[len(first) :] if x[0] >= least]
        if rest:
            hits += best(rest, False)
        hits = sorted(hits, key=lambda r: (r.score is None, -(r.score or 0.0), *(r[c] for c in TIES)))[:k]
        self.last_search = {"cells": len(known), "cells_read": len(first) + len(rest), "rows": sum(x[3] for x in known), "rows_read": sum(x[3] for x in [*first, *rest])}
        taken = {r: [f"{r}/cell={c}" for _, x, c, _ in [*first, *rest] if x == r] for r in celled}
        keys = self.spark.createDataFrame([tuple(r) for r in hits], "_file string, _row long, _path string, _line int, _ord int, score double")
        found = self._chosen(parts, taken).filter(F.col("path").isin(sorted({r.path for r in hits})))
        return search.top(found.join(F.broadcast(keys), [*PLACE]), k).select(*search.HIT, "chunk_ord")  # at most k keys

    def _chosen(self, parts: Parts, paths: dict[str, list[str]]) -> DataFrame:
        """_live() of some cells; segments marked `skip` give no rows, but what they replace still goes."""
        skipped = {s["rows"]: [] for p in parts.values() for s in p if s.get("skip")}
        plain = {f: [x | {"old": False} if x.get("skip") else x for x in s] for f, s in parts.items()}
        return self._live(plain, paths | skipped)

    # Writing.

    def _segment(self, rows: DataFrame, folder: str, gone: DataFrame | None = None) -> dict:
        name = uuid.uuid4().hex
        out = {"rows": f"{self.root}/v-{name}", "gone": None, "n_gone": 0, "cells": None}
        rows = backfill(rows).withColumn("folder", F.lit(folder)).select(*COLUMNS)
        rows.withColumn("terms", text.stored_terms(F.col("content"))).write.parquet(out["rows"])
        return out if gone is None else out | self._lost(gone, folder, name)

    def _lost(self, gone: DataFrame, folder: str, name: str) -> dict:
        path = f"{self.root}/g-{name}"
        gone.select(F.lit(folder).alias("folder"), "path").distinct().write.parquet(path)
        return {"gone": path, "n_gone": self.spark.read.schema(GONE).parquet(path).count()}

    def _append(self, folder: str, segment: dict) -> None:
        """Add a delta, also where others were added meanwhile: the later one counts for its paths."""

        def change(parts: Parts) -> Parts:
            before = parts.get(folder, [])
            return parts | {folder: [*before, segment if before else segment | {"gone": None, "n_gone": 0}]}

        self._commit(change)

    def replace(self, folder: str, paths: DataFrame, rows: DataFrame) -> None:
        """Replace all rows of `paths` in a folder by `rows`; a path without rows is deleted."""
        with self._lock:
            self._append(folder, self._segment(search.last_rows(backfill(rows)), folder, paths))
            self._merge(folder)

    def _merge(self, folder: str) -> None:
        segments = self._manifest()[1].get(folder, [])
        if sum(s["n_gone"] for s in segments) > MAX_GONE:
            self.optimize(folder) if segments[0]["cells"] else self._fold(folder, segments, 0)
        elif len(segments) > MAX_DELTAS + 1:
            self._fold(folder, segments, 1)

    def _fold(self, folder: str, segments: list[dict], start: int, by_cells: dict | None = None) -> bool:
        """Make one segment of those from `start` on; False, and nothing changes, if another process did so first."""
        rows = self._live({folder: segments[start:]}).drop(*PLACE)
        name = uuid.uuid4().hex
        if by_cells is not None:
            top = f"{self.root}/v-{name}"
            cells.lay_out(rows, top, **by_cells)
            made = {"rows": f"{top}/rows", "gone": None, "n_gone": 0, "cells": top}
        else:
            made = self._segment(rows, folder)
        if start:
            lost = self.spark.read.schema(GONE).parquet(*[s["gone"] for s in segments[start:]])
            made |= self._lost(lost, folder, name)

        def change(parts: Parts) -> Parts | None:
            now = parts.get(folder, [])
            return parts | {folder: [*now[:start], made, *now[len(segments) :]]} if now[: len(segments)] == segments else None

        return self._commit(change)

    def optimize(self, folder: str | None = None, per_cell: int = cells.PER_CELL, most: int = cells.MOST) -> None:
        """Write parts anew, by cells of like vectors and without deltas; of all folders if none is given."""
        with self._lock:
            for name, segments in self._manifest()[1].items():
                if folder in (None, name):
                    self._fold(name, segments, 0, {"per_cell": per_cell, "most": most})

    def delete_under(self, folder: str) -> None:
        """Delete what lies under a folder: whole parts where they do, else a delta names the paths."""
        under = folder.rstrip("/") + "/"
        whole = lambda f: (f.rstrip("/") + "/").startswith(under)
        with self._lock:
            for f, segments in self._manifest()[1].items():
                if not whole(f) and under.startswith(f.rstrip("/") + "/"):
                    lost = self._live({f: segments}).filter(text.under(F.col("path"), folder)).select("path")
                    delta = self._segment(self.spark.createDataFrame([], CHUNKS), f, lost)
                    if delta["n_gone"]:
                        self._append(f, delta)
                        self._merge(f)
            self._commit(lambda parts: {f: s for f, s in parts.items() if not whole(f)} if any(map(whole, parts)) else None)

    def import_table(self, folder: str, df: DataFrame) -> None:
        """Take over a table of the chunk schema or an older form of it as one folder."""
        with self._lock:
            made = self._segment(df, folder)
            self._commit(lambda parts: parts | {folder: [made]})

    def vacuum(self, spare_seconds: float = 0) -> None:
        """Remove all manifests but the last, and what it does not name.

        Where other processes may write meanwhile, spare what is younger than their longest write: it may not be published yet.
        """
        with self._lock:
            before = (time.time() - spare_seconds) * 1000
            number, parts = self._manifest()
            keep = "\n".join(str(x) for p in parts.values() for s in p for x in (s["rows"], s["gone"])) + "\n"
            for n in self._numbers():
                if n < number:
                    self._fs.delete(self._path(f"{self.root}/MANIFEST-{n:012d}.json"), False)
            for s in self._fs.globStatus(self._path(f"{self.root}/[vg]-*")) or []:
                if s.getPath().getName() not in keep and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
