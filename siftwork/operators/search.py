"""Ranked search, exact names, similar chunks, drift, citations: plans over a chunk table.

All scores are column expressions; a query's vector is a literal, and top-k is one
TakeOrderedAndProject. Batches of queries meet the chunks as matrix products in each partition, which
passes on its k best rows of each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import rank, text
from ..schema import TIES
from ..session import Scratch, ship

HIT = ["path", "content", "score", "start_line", "end_line", "chunk_kind", "name", "truncated", "mtime"]
POOL, CITED, RELEVANT = 50, 3, 0.3


def scoped(chunks: DataFrame, folder: str | None = None, exclude: str | None = None, model: str | None = None) -> DataFrame:
    if folder is not None:
        chunks = chunks.filter(text.under(F.col("path"), folder))
    if exclude is not None:
        chunks = chunks.filter(~text.under(F.col("path"), exclude))
    return chunks if model is None else chunks.filter(F.col("model") == model)


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), *TIES).limit(k)


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], k: int, folder: str | None = None, exclude: str | None = None, weights: rank.RankingWeights = rank.RankingWeights(), as_question: bool | None = None) -> DataFrame:
    """The k best chunks. For a question the fuzzy branch is not in the plan at all."""
    chunks = scoped(chunks, folder, exclude)
    score = hybrid_score(chunks, query, vector, weights, as_question)
    return top(chunks.withColumn("score", score), k).select(*HIT, "chunk_ord")


def hybrid_score(chunks: DataFrame, query: str, vector: list[float], weights: rank.RankingWeights, as_question: bool | None) -> Column:
    """Score of each row. Where chunks have stored terms, contents are not read for it."""
    asked = text.question(query) if as_question is None else as_question
    fuzzy: Column | None = None
    if not asked:
        ship(chunks.sparkSession)
        # One pass with the similarity, in the same workers: no join, and no shuffle of chunks.
        fuzzy = rank.fuzzy(query)(text.file_name(F.col("path"))) if weights.fuzzy else F.lit(0.0)
    words = rank.stored_overlap(query, F.col("terms")) if "terms" in chunks.columns else rank.overlap(query, F.col("content"))
    return rank.hybrid(rank.similarity(F.col("embedding"), vector), fuzzy, words, weights)


def find_by_name(chunks: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    return scoped(chunks, folder).filter(F.col("name") == name).withColumn("score", F.lit(1.0)).orderBy(*TIES).select(*HIT, "chunk_ord")


def exact_then_hybrid(exact: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Exact rows first, then the other hits by score."""
    # hits are at most a pool of POOL rows
    rest = hits.join(exact.select("path", "start_line"), ["path", "start_line"], "left_anti")
    both = exact.withColumn("exact_match", F.lit(True)).unionByName(rest.withColumn("exact_match", F.lit(False)))
    return both.orderBy(F.desc("exact_match"), F.desc("score"), *TIES).limit(k)


def chunk_embedding(chunks: DataFrame, path: str, start_line: int) -> list[float]:
    """The vector of one chunk; KeyError if there is none."""
    row = chunks.filter((F.col("path") == path) & (F.col("start_line") == start_line)).orderBy("chunk_ord").select("embedding").first()
    if row is None:
        raise KeyError(f"{path}:{start_line} is not in the table")
    return row.embedding


def find_similar(chunks: DataFrame, path: str, start_line: int, k: int, folder: str | None = None, code_only: bool = False) -> DataFrame:
    target = chunk_embedding(chunks, path, start_line)
    others = scoped(chunks, folder).filter(~((F.col("path") == path) & (F.col("start_line") == start_line)))
    if code_only:
        others = others.filter(text.is_code_chunk(F.col("chunk_kind")))
    return top(others.withColumn("score", rank.similarity(F.col("embedding"), target)), k).select(*HIT, "chunk_ord")


def drift_hits(chunks: DataFrame, path: str, start_line: int, k: int = 5, folder: str | None = None) -> DataFrame:
    return find_similar(chunks, path, start_line, k, folder, code_only=True)


def drift_flag(hits: DataFrame, threshold: float = 0.35) -> DataFrame:
    """One row: likely_stale, also true without hits."""
    return hits.agg(F.coalesce(F.max("score") < threshold, F.lit(True)).alias("likely_stale"))


def _nearest(asked: list, k: int, kind: pa.DataType):
    """The k best rows of a partition for each query, by matrix products on Arrow batches."""
    width = max((len(v) for _, v in asked), default=0)
    # A vector of another length scores 0, as in dot().
    sizes = np.array([len(v) for _, v in asked])
    matrix = np.array([[*v, *[0.0] * (width - len(v))] for _, v in asked], np.float64).reshape(len(asked), width)

    def run(batches):
        best: list[pd.DataFrame | None] = [None] * len(asked)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("embedding").fill_null([])
            off = np.asarray(lists.offsets)
            n = np.diff(off)
            flat, off = np.asarray(lists.flatten()).astype(np.float64), off - off[0]
            x = np.zeros((b.num_rows, width))
            fits = n <= width
            row = np.repeat(np.arange(b.num_rows), n)
            place = np.arange(len(flat)) - np.repeat(off[:-1], n)
            keep = fits[row]
            x[row[keep], place[keep]] = flat[keep]
            with np.errstate(all="ignore"):
                score = matrix @ x.T
            score = np.where((sizes[:, None] != n[None, :]) | ~(score > 0), 0.0, score)
            ties = b.select(TIES).to_pandas()
            for q in range(len(asked)):
                least = -1.0 if best[q] is None or len(best[q]) < k else best[q]["score"].iloc[-1]
                at = np.flatnonzero(score[q] >= least)
                if len(at):
                    new = ties.iloc[at].assign(score=score[q][at])
                    both = new if best[q] is None else pd.concat([best[q], new])
                    best[q] = both.sort_values(["score", *TIES], ascending=[False, True, True, True]).head(k)
        for (key, _), rows in zip(asked, best, strict=True):
            if rows is not None:
                arrays = [pa.array([key] * len(rows), kind), *(pa.array(rows[c], t) for c, t in zip([*TIES, "score"], (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["query", *TIES, "score"])

    return run


def batch_top_k(chunks: DataFrame, queries: DataFrame, k: int, wave: int = 1024) -> DataFrame:
    """The k most similar chunks for each row (query_id, vector) of queries.

    Queries go out in waves of at most `wave`, which are what is sent to the tasks; a task keeps k rows
    for each query of what it reads, so that k rows a task and query are shuffled, whatever the table.
    """
    spark = chunks.sparkSession
    ship(spark)
    key = queries.schema["query_id"].dataType
    kind = key.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    waves = max(1, -(-queries.count() // wave))
    if waves > 1:  # written, as the wave of a row may be another one when its plan runs again
        asked = Scratch(spark, "asked").table(asked.withColumn("_wave", F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(2 * waves))), "queries")
    parts = []
    for i in range(2 * waves if waves > 1 else 1):  # a hash deals about half of `wave` queries to each
        rows = (asked.filter(F.col("_wave") == i) if waves > 1 else asked).select("query_id", "vector").collect()
        for low in range(0, len(rows), wave):
            near = _nearest([(r.query_id, r.vector or []) for r in rows[low : low + wave]], k, to_arrow_type(key))
            parts.append(chunks.select(*TIES, "embedding").mapInArrow(near, f"query {kind}, path string, start_line int, chunk_ord int, score double"))
    if not parts:
        return chunks.sparkSession.createDataFrame([], f"query_id {kind}, rank int, path string, start_line int, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by = Window.partitionBy("query").orderBy(F.desc("score"), *TIES)
    out = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", "path", "start_line", "score")


def citable(hits: DataFrame) -> DataFrame:
    """At most CITED rows of a ranked pool that may be cited: prose files or code, near the best score."""
    kept = hits.filter(text.is_prose_file(F.col("path")) | text.is_code_chunk(F.col("chunk_kind")))
    first = top(kept, CITED)
    best = first.agg(F.max("score").alias("_best"))
    return first.join(F.broadcast(best), F.col("score") >= RELEVANT * F.col("_best")).drop("_best")


def best_sentences(hits: DataFrame, query_vector: list[float], embed) -> DataFrame:
    """For prose hits the sentence nearest to the query, first one on ties; none without sentences.

    embed: a column function from text to a vector.
    """
    each = hits.select("*", F.posexplode(text.sentences(F.col("content"))).alias("_i", "snippet"))
    scored = each.withColumn("_s", rank.similarity(embed(F.col("snippet")), query_vector))
    by = Window.partitionBy(*TIES).orderBy(F.desc("_s"), "_i")
    return scored.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_s", "_i")


def synthesize(hits: DataFrame, query_vector: list[float], embed) -> DataFrame:
    """Extractive citations (path, snippet, start_line, end_line, chunk_kind, truncated) of a ranked pool."""
    cited = citable(hits)
    code = cited.filter(text.is_code_chunk(F.col("chunk_kind"))).withColumn("snippet", text.trimmed(F.col("content")))
    prose = best_sentences(cited.filter(~text.is_code_chunk(F.col("chunk_kind"))), query_vector, embed)
    line = (F.col("start_line") + text.line_of(F.col("content"), F.col("snippet")) - 1).cast("int")
    prose = prose.withColumn("start_line", line).withColumn("end_line", line)
    both = code.unionByName(prose.select(*code.columns))
    return both.orderBy(F.desc("score"), *TIES).select("path", "snippet", "start_line", "end_line", "chunk_kind", "truncated")


def possibly_stale(hits: DataFrame, listing: DataFrame) -> DataFrame:
    """hits with possibly_stale: the listing (path, disk_mtime) has a later time than the row."""
    return hits.join(listing, "path", "left").withColumn("possibly_stale", F.coalesce(F.col("disk_mtime") > F.col("mtime"), F.lit(False))).drop("disk_mtime")


def last_rows(new: DataFrame) -> DataFrame:
    """The last row of each (path, start_line)."""
    last = Window.partitionBy("path", "start_line").orderBy(F.desc("chunk_ord"))
    return new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(chunks: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """chunks with the rows of `paths` replaced by `new`, whose last row of each key wins."""
    fresh = last_rows(new)
    return chunks.join(paths.select("path").distinct(), "path", "left_anti").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def purge(chunks: DataFrame, folder: str) -> DataFrame:
    return chunks.filter(~text.under(F.col("path"), folder))


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each path, by time and id."""
    best = F.max(F.struct("mtime", "event_id", "op")).alias("e")
    return events.groupBy("path").agg(best).select("path", "e.mtime", "e.event_id", "e.op")


def changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of listing whose (path, mtime) is not in state."""
    return listing.join(state, ["path", "mtime"], "left_anti")
