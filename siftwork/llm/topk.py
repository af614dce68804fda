"""Exact top-k search by distributed histogram selection.

Queries are taken in waves of bounded size. For a wave every row is scored against every query; each
partition counts the scores that its own k best leave possible into a histogram bin, the counts are
summed over all partitions, and the bin that holds the k-th score becomes the range of the next,
finer histogram, until a bin is one score wide. A last pass keeps the scores above each query's k-th
score, and of those equal to it the smallest ids.

Scores are inner products of vectors scaled by 1024 and floored; they are computed exactly.

Defined cases:
- vectors that are null, or hold null or non-finite components take no part, nor do rows with a null
  vec_id; vectors of another length than a query's have no score with it.
- a score that does not fit a long, or a component that is infinite when scaled, fails the search.
- repeated rows: each is a candidate of its own, and each query row gets its own result. Of its candidates a
  query's own row is left out: one row of its id and of its score with itself. Others of that id are candidates.
- fewer than k candidates: all of them. Empty tables give an empty result. Empty vectors score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, read, ship

K, SCALE, WAVE, BINS = 10, 1024, 4096, 1024
#: Doubles below it hold whole numbers exactly.
EXACT = 1 << 53


def scaled(vectors: list) -> np.ndarray:
    """Scaled components (n, d) of vectors of one length, as doubles of whole numbers."""
    with np.errstate(over="ignore"):
        out = np.floor(np.asarray(vectors, np.float64) * SCALE)
    if not np.isfinite(out).all():
        raise OverflowError("a component is infinite when scaled")
    return out


def _usable(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and scaled vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    ok = ~(np.asarray(ids.is_null()) | np.asarray(vectors.is_null()))
    ids, vectors = ids.filter(pa.array(ok)), vectors.filter(pa.array(ok))
    if not len(ids):
        return {}
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    starts = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        v = x[starts[at][:, None] + np.arange(d)]
        good = np.isfinite(v).all(axis=1)
        if good.any():
            out[d] = np.asarray(ids)[at[good]].astype(np.int64), scaled(v[good])
    return out


_INTEGER = np.frompyfunc(int, 1, 1)


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole inner products (queries, rows); by Python integers where doubles or longs would not be exact."""
    if not q.shape[1]:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = _INTEGER(q) @ _INTEGER(v).T
    if (whole < -(1 << 63)).any() or (whole >= 1 << 63).any():
        raise OverflowError("a score does not fit a long")
    return whole.astype(np.int64)


class Wave:
    """Queries by vector length: numbers in the wave, ids, scaled vectors. `first` is the number of the first one in the search."""

    def __init__(self, ids: list[int], vectors: list, first: int = 0):
        self.ids, self.first = np.array(ids, np.int64), first
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.own = np.zeros(len(ids), np.int64)  # each query's score with itself
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            q = scaled([vectors[i] for i in at]).reshape(len(at), d)
            self.by[d] = at, q
            for i, row in zip(at.tolist(), q, strict=True):
                self.own[i] = inner(row[None], row[None])[0, 0]

    def scores(self, batch: pa.RecordBatch):
        """Blocks (query numbers, candidate ids, scores)."""
        for d, (ids, v) in _usable(batch).items():
            if d in self.by:
                at, q = self.by[d]
                for i in range(0, len(at), 256):
                    for j in range(0, len(ids), 4096):
                        yield at[i : i + 256], ids[j : j + 4096], inner(q[i : i + 256], v[j : j + 4096])


def _count(wave: Wave, low: np.ndarray, width: np.ndarray, k: int):
    """Counts of scores by bin, for those that may be among the k best; bins above the range count as BINS."""

    def run(batches):
        n = len(wave.ids)
        best = np.full((n, k), np.iinfo(np.int64).min)  # the k best scores of this partition so far
        kept: list[dict[int, int]] = [{} for _ in range(n)]
        for b in batches:
            for at, _, s in wave.scores(b):
                for r, q in enumerate(at.tolist()):
                    own = s[r][s[r] >= max(low[q], best[q, 0])]
                    if not len(own):
                        continue
                    top = np.concatenate([best[q], own])
                    best[q] = np.sort(np.partition(top, len(top) - k)[len(top) - k :])
                    which = np.minimum((own.astype(object) - int(low[q])) // int(width[q]), BINS) if width[q] > 1 << 52 else np.minimum((own - low[q]) // width[q], BINS)
                    for x, c in zip(*np.unique(which.astype(np.int64), return_counts=True), strict=True):
                        kept[q][int(x)] = kept[q].get(int(x), 0) + int(c)
        rows = []
        for q, bins in enumerate(kept):
            least = best[q, 0]
            floor = -1 if least < low[q] else min((int(least) - int(low[q])) // int(width[q]), BINS)
            rows += [(q, x, c) for x, c in bins.items() if x >= floor]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["q", "bin", "n"])

    return run


def _range(wave: Wave):
    """Least and greatest score of each query in this partition."""

    def run(batches):
        n = len(wave.ids)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for b in batches:
            for at, _, s in wave.scores(b):
                low[at] = np.minimum(low[at], s.min(axis=1, initial=np.iinfo(np.int64).max))
                high[at] = np.maximum(high[at], s.max(axis=1, initial=np.iinfo(np.int64).min))
        has = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(low[has]), pa.array(high[has])], ["q", "low", "high"])

    return run


def _final(wave: Wave, kth: np.ndarray, k: int):
    """Scores above the k-th, and of those equal to it the k smallest ids of this partition."""

    def run(batches):
        ties: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for at, ids, s in wave.scores(b):
                r, c = np.nonzero(s > kth[at][:, None])
                out.append((at[r], ids[c], s[r, c]))
                equal = s == kth[at][:, None]
                for r in np.flatnonzero(equal.any(axis=1)).tolist():
                    q = int(at[r])
                    ties[q] = np.sort(np.concatenate([ties.get(q, ids[:0]), ids[equal[r]]]))[:k]
            if out:
                yield _hits(wave, *(np.concatenate([x[i] for x in out]) for i in range(3)))
        if ties:
            q = np.repeat(np.array(list(ties), np.int64), [len(x) for x in ties.values()])
            yield _hits(wave, q, np.concatenate(list(ties.values())), kth[q])

    return run


def _hits(wave: Wave, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q + wave.first, pa.int64()), pa.array(wave.ids[q]), pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array((wave.ids[q] == v) & (wave.own[q] == s))], ["query", "query_id", "vec_id", "score", "own"])


def search(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int = K, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each query, ties to smaller ids."""
    ship(spark)
    work = Scratch(spark, "topk")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.expr("forall(embedding, x -> coalesce(abs(x) < double('Infinity') AND NOT isnan(x), false))")
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(good)
    n = asked.count()
    waves = max(1, -(-n // wave))
    # Written, as a row's number may be another one when the plan runs again.
    parts = work.table(asked.withColumn("wave", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(2 * waves))), "queries") if waves > 1 else asked.withColumn("wave", F.lit(0))
    hits, first = [], 0
    for i in range(2 * waves if waves > 1 else 1):  # a wave holds about half of `wave` queries
        got = sorted(parts.filter(F.col("wave") == i).select("vec_id", "embedding").collect())
        for at in range(0, len(got), wave):
            part = got[at : at + wave]
            w = Wave([r.vec_id for r in part], [r.embedding for r in part], first)
            first += len(part)
            hits.append(work.table(_select(rows, w, k + 1), "hits"))  # with the query's own row
    if not hits:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("copy", F.row_number().over(Window.partitionBy("query", "own").orderBy("vec_id"))).filter("NOT own OR copy > 1")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _select(rows: DataFrame, w: Wave, k: int) -> DataFrame:
    n = len(w.ids)
    low, width, above = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
    for r in rows.mapInArrow(_range(w), "q int, low long, high long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r.q], width[r.q] = r.low, max(1, -(-(r.high - r.low + 1) // BINS))
    active = True
    while active:
        counts = rows.mapInArrow(_count(w, low, width, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("total", F.sum("n").over(down)).groupBy("q").agg(F.max(F.when(F.col("total") >= k, F.col("bin"))).alias("bin"))
        active = False
        for r in found.collect():  # a row for each query of the wave
            if r.bin is None:
                continue  # fewer than k candidates: the k-th score is the least
            if width[r.q] > 1:
                low[r.q] += r.bin * width[r.q]
                width[r.q] = -(-int(width[r.q]) // BINS)
                active = True
            else:
                low[r.q] += r.bin
    return rows.mapInArrow(_final(w, low, k), "query long, query_id long, vec_id long, score long, own boolean")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(spark, vectors.filter("vec_id % 100 = 0"), vectors)


ORACLE_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
