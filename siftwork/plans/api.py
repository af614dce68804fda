"""The front doors: four tools that return JSON rows, and the application's search with its settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rank, text
from ..functions.embed import embed_udf
from ..operators import search
from ..operators.store import ChunkStore

#: Characters of a content that a result shows, if nothing else is asked for.
MAX_CHARS = 1500


def default_paths(home: str | None = None) -> dict[str, str]:
    """Where the store, the streams' checkpoints and the settings lie unless others are given."""
    top = os.path.join(home or os.path.expanduser("~"), ".siftwork")
    return {"store": f"file://{top}/index", "checkpoints": f"file://{top}/checkpoints", "settings": f"{top}/settings.json"}


class Settings:
    """JSON settings, read and written field by field; a field that cannot be read has its default."""

    DEFAULTS = {"ranking_weights": rank.RankingWeights().__dict__, "embedding_model": "hashing-384", "default_app": None, "watched_folders": []}

    def __init__(self, path: str):
        self.path = path

    def _all(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            return {}

    def get(self, field: str):
        return self._all().get(field, self.DEFAULTS[field])

    def set(self, field: str, value) -> None:
        new = self._all() | {field: value}
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(new, f)
        os.replace(f"{self.path}.new", self.path)

    def weights(self) -> rank.RankingWeights:
        return rank.RankingWeights(**self.get("ranking_weights"))


class Engine:
    """Search over a store. `listing` gives (path, disk_mtime) for staleness; without one nothing is stale."""

    def __init__(self, store: ChunkStore, embedder, settings: Settings | None = None, listing=None):
        self.store, self.embedder, self.settings, self.listing = store, embedder, settings, listing

    def _chunks(self) -> DataFrame:
        return search.scoped(self.store.read(), model=self.embedder.model)

    def _embed(self, column):
        return embed_udf(self.embedder)(column)["embedding"]

    def _scope(self, folder: str | None) -> str | None:
        return None if folder is None else os.path.realpath(os.path.expanduser(folder))

    def _pool(self, query: str, k: int, folder: str | None, exclude: str | None, weights: rank.RankingWeights) -> DataFrame:
        """At most max(k, POOL) ranked rows, computed once and sliced by what follows."""
        vector = self.embedder.embed(query)[0]
        hits = self.store.search(query, vector, max(k, search.POOL), self._scope(folder), self._scope(exclude), weights, model=self.embedder.model)
        spark = hits.sparkSession
        return spark.createDataFrame(hits.collect(), hits.schema)

    def _results(self, hits: DataFrame, k: int, most: int) -> list[dict]:
        first = search.top(hits, k)
        listing = self.listing(first) if self.listing else hits.sparkSession.createDataFrame([], "path string, disk_mtime long")
        shown = search.possibly_stale(first, listing).withColumn("content", text.truncate_content(F.col("content"), most))
        return [r.asDict() for r in search.top(shown, k).select("path", "start_line", "end_line", "chunk_kind", "score", "content", "possibly_stale").collect()]

    def _citations(self, query: str, hits: DataFrame, most: int | None = None) -> list[dict]:
        cited = search.synthesize(hits, self.embedder.embed(query)[0], self._embed)
        if most is not None:
            cited = cited.withColumn("snippet", text.truncate_content(F.col("snippet"), most))
        return [r.asDict() for r in cited.collect()]

    def tool_search(self, query: str, top_k: int = 5, folder: str | None = None, exclude_folder: str | None = None, max_content_chars: int = MAX_CHARS) -> str:
        hits = self._pool(query, top_k, folder, exclude_folder, rank.RankingWeights())
        cited = self._citations(query, hits, max_content_chars) if text.question(query) else []
        return json.dumps({"results": self._results(hits, top_k, max_content_chars), "citations": [{k: v for k, v in c.items() if k != "truncated"} for c in cited]})

    def tool_explain(self, query: str, top_k: int = 3, folder: str | None = None, exclude_folder: str | None = None, max_content_chars: int = MAX_CHARS) -> str:
        """Citations always; never more than three, whatever top_k is."""
        hits = self._pool(query, search.POOL, folder, exclude_folder, rank.RankingWeights())
        return json.dumps({"citations": [{k: v for k, v in c.items() if k != "truncated"} for c in self._citations(query, hits, max_content_chars)[:top_k]]})

    def tool_find_similar(self, path: str, start_line: int, top_k: int = 5, folder: str | None = None, max_content_chars: int = MAX_CHARS) -> str:
        return json.dumps({"results": self._results(search.find_similar(self._chunks(), path, start_line, top_k, self._scope(folder)), top_k, max_content_chars)})

    def tool_check_doc_drift(self, path: str, start_line: int, top_k: int = 5, stale_threshold: float = 0.35, folder: str | None = None, max_content_chars: int = MAX_CHARS) -> str:
        hits = search.drift_hits(self._chunks(), path, start_line, top_k, self._scope(folder))
        return json.dumps({"results": self._results(hits, top_k, max_content_chars), "likely_stale": search.drift_flag(hits, stale_threshold).first()[0]})

    def app_search(self, query: str, top_k: int = 8, folder: str | None = None) -> dict:
        """Exact names first for identifiers, then ranked hits, with the user's weights."""
        hits = self._pool(query, top_k, folder, None, self.settings.weights() if self.settings else rank.RankingWeights())
        chunks = self._chunks()
        exact = search.find_by_name(chunks if text.identifier(query) else chunks.limit(0), query, self._scope(folder))
        both = search.exact_then_hybrid(exact, hits, top_k)
        rows = [r.asDict() for r in both.select("path", "score", "start_line", "end_line", "chunk_kind", "exact_match", "truncated").collect()]
        return {"results": rows, "citations": self._citations(query, hits) if text.question(query) and rows else []}

    def find_line(self, content: str, query: str) -> int:
        """Line, from 1, that is nearest to the query; the first on ties, 1 without any."""
        lines = [(i, x.strip()) for i, x in enumerate(content.split("\n"), 1) if len(x.strip().encode()) > 3]
        target = self.embedder.embed(query)[0]
        score = lambda x: sum(a * b for a, b in zip(self.embedder.embed(x)[0], target))
        return max(lines, key=lambda x: (score(x[1]), -x[0]))[0] if lines else 1

    def find_line_in(self, path: str, query: str) -> int:
        """find_line on the file as it is now; 1 if it cannot be read."""
        try:
            with open(path, encoding="utf-8") as f:
                return self.find_line(f.read(), query)
        except (OSError, ValueError):
            return 1


def preview(path: str, start_line: int, end_line: int) -> str:
    """Lines of the file as it is now, clamped."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    first = min(max(start_line - 1, 0), len(lines))
    return "\n".join(lines[first : max(min(end_line, len(lines)), first)])


def agent_context(query: str, rows: DataFrame) -> DataFrame:
    """One row of text: the query, then a block for each row in rank order. For a few chosen rows."""
    block = text.context_block(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_kind"), F.col("score"), F.col("content"))
    every = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", "start_line", block.alias("b")))).alias("x"))
    return every.select(F.concat(F.lit(f"query: {query}\n\n"), F.array_join(F.col("x.b"), "\n\n")).alias("context"))


def editor_link(template: str, path, line):
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), path), F.lit("{line}"), line.cast("string"))
