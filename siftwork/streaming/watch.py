"""Keeping a chunk table current: listings or streams of changed files to chunks, vectors and replaced rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunkers import chunk_files
from ..functions.embed import embed_udf
from ..operators.search import changed
from ..operators.store import ChunkStore
from ..session import ship
from ..sources import folder as source

MAX_FAILED = 20


def index_batch(store: ChunkStore, embedder, folder: str, changes: DataFrame, listed: DataFrame | None = None) -> dict:
    """Apply changes (op, path, mtime_ns), the last one of each path. Running it again changes nothing.

    Files that are gone, blank, or not UTF-8 lose their rows. What is returned counts the changes, or all of `listed`.
    """
    last = Window.partitionBy("path").orderBy(F.desc("mtime_ns"))
    final = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    texts = source.read_texts(final.filter("op <> 'delete'"))
    chunks = chunk_files(texts.filter("content IS NOT NULL")).join(final.select("path", F.expr("mtime_ns div 1000000000").alias("mtime")), "path")
    made = chunks.withColumn("e", embed_udf(embedder)("content")).select("path", "start_line", "end_line", "chunk_kind", "content", F.coalesce("name", F.lit("")).alias("name"), "e.truncated", "mtime", "e.embedding", F.lit(embedder.model).alias("model"), F.lit(folder).alias("folder"), "chunk_ord")
    store.replace(folder, final.select("path"), made)
    return progress(final if listed is None else listed, store.read().filter(F.col("folder") == folder), texts.filter("problem IS NOT NULL").select("path", "problem"))


def progress(files: DataFrame, chunks: DataFrame, problems: DataFrame | None = None) -> dict:
    """Counts of files, and of those without rows: an exact count, and at most MAX_FAILED paths with what is known of them."""
    wanted = files.filter("op <> 'delete'").select("path").distinct()
    missing = wanted.join(chunks.select("path").distinct(), "path", "left_anti")
    total, failed = wanted.count(), missing.count()
    shown = missing.orderBy("path").limit(MAX_FAILED)
    shown = shown.withColumn("problem", F.lit(None).cast("string")) if problems is None else shown.join(problems, "path", "left").orderBy("path")
    return {"total": total, "indexed": total - failed, "failed_count": failed, "failed": [{"path": r.path, "problem": r.problem} for r in shown.select("path", "problem").collect()], "done": True}


class Watcher:
    """Watched folders of one store. With settings (get, set), they and the model outlive this process."""

    def __init__(self, spark: SparkSession, store: ChunkStore, embedder, checkpoints: str, max_files: int = source.MAX_FILES, settings=None):
        ship(spark)
        source.register(spark)
        self.spark, self.store, self.embedder, self.checkpoints, self.max_files, self.settings = spark, store, embedder, checkpoints, max_files, settings
        self.running: dict[str, object] = {}
        self.state: dict[str, dict] = {}

    def watched(self) -> list[str]:
        """Folders that are watched, of earlier processes too."""
        return sorted({*(self.settings.get("watched_folders") if self.settings else []), *self.state})

    def _remember(self, folder: str, keep: bool) -> None:
        if self.settings:
            self.settings.set("watched_folders", sorted({*self.settings.get("watched_folders"), folder} if keep else {*self.settings.get("watched_folders")} - {folder}))

    def resume(self, every: str = "300 milliseconds") -> dict[str, str]:
        """Follow all watched folders again; what went wrong for those that cannot be."""
        problems = {}
        for folder in self.watched():
            try:
                self.start(folder, every)
            except (OSError, ValueError) as e:
                problems[folder] = str(e)
        return problems

    def _checked(self, folder: str) -> str:
        folder = os.path.realpath(folder)
        if source.too_broad(folder):
            raise ValueError(f"{folder} is too broad to watch")
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        if source.count_files(folder, self.max_files) > self.max_files:
            raise ValueError(f"{folder} has more than {self.max_files} files")
        return folder

    def scan(self, folder: str) -> dict:
        """Index what changed in a folder; files that are gone lose their rows.

        Unchanged are files that have rows of this model and of their time, in whole seconds. So an edit in the
        same second as the one before is not seen, and files without rows (blank ones) are read again.
        """
        folder = self._checked(folder)
        listed = self.spark.read.format("folder").option("path", folder).load()
        known = self.store.read().filter(F.col("folder") == folder).select("path", "mtime", "model").distinct()
        edited = changed(listed.withColumn("mtime", F.expr("mtime_ns div 1000000000")), known.filter(F.col("model") == self.embedder.model)).select(*listed.columns)
        gone = known.select("path").distinct().join(listed, "path", "left_anti").select(F.lit("delete").alias("op"), "path", F.lit(0).cast("long").alias("mtime_ns"))
        changes = edited.unionByName(gone)
        self.state[folder] = index_batch(self.store, self.embedder, folder, changes, listed) if changes.limit(1).count() else progress(listed, known)
        self._remember(folder, True)
        return self.state[folder]

    def start(self, folder: str, every: str = "300 milliseconds", once: bool = False):
        """A streaming query that follows a folder; one for each folder."""
        folder = self._checked(folder)
        if folder in self.running:
            return self.running[folder]

        def apply(df: DataFrame, _: int) -> None:
            self.state[folder] = index_batch(self.store, self.embedder, folder, df)

        writer = self.spark.readStream.format("folder").option("path", folder).load().writeStream.foreachBatch(apply)
        writer = writer.option("checkpointLocation", f"{self.checkpoints}/{folder.strip('/').replace('/', '%2F')}")
        self._remember(folder, True)
        self.running[folder] = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
        return self.running[folder]

    def stop(self, folder: str, purge: bool = True) -> None:
        """Stop the query, wait for it, and only then purge, so that no late batch brings rows back."""
        folder = os.path.realpath(folder)
        query = self.running.pop(folder, None)
        if query is not None:
            query.stop()
            query.awaitTermination()
        self.state.pop(folder, None)
        self._remember(folder, False)
        if purge:
            self.store.delete_under(folder)

    def use_model(self, embedder) -> None:
        """Switch the embedder and index every watched folder anew, also those of earlier processes."""
        self.embedder = embedder
        if self.settings:
            self.settings.set("embedding_model", embedder.model)
        for folder in self.watched():
            self.store.delete_under(folder)
            if os.path.isdir(folder):
                self.scan(folder)
