"""Centroid clustering with Drake's adaptive bounds.

Every vector keeps its cluster, an upper bound of the distance to its centroid, lower bounds of the distances
to its B next nearest centroids, each with its number, and one lower bound for all others. When centroids
have moved, the bounds move with them, and:
- where the upper bound stays below all lower bounds, the cluster stays, without a distance;
- else the distance to the own centroid is taken, and that is tried again;
- else, if it is below the bound of the others, only listed centroids whose bound it reaches are measured;
- else the order cannot be certified, and all centroids are measured anew.
B starts at a fourth of the centroids; after a round it becomes the greatest number of listed bounds that a
vector needed, but an eighth at least and a fourth at most.

Components are whole numbers, and squared distances are computed exactly: in doubles where they hold whole
numbers, else by Python integers. Bounds are rounded outwards, so they are never wrong, and equal
distances are always measured, so that the smaller number wins. Rounds run as map-only passes over the vectors
with their state, written to the shared folder; sums and counts of clusters are added up in each task, then
over all tasks. The centroids (k of them, whatever the size of the input) are what the driver holds.

Defined cases:
- vectors that are null, of another length, or hold null or non-finite components take no part and have no row.
- rows with a null vec_id are clustered, but never start a centroid. Repeated rows count again; of start
  candidates with equal hashes (repeated ids) the lesser vector comes first.
- fewer than k vectors: as many centroids. Empty clusters keep their centroid. No vectors: an empty result.
- a component, distance or sum of distances that does not fit a long fails the run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2"
#: Doubles below it hold whole numbers exactly.
EXACT = 1 << 53
#: Vectors that are measured at once.
STEP = 4096
STATE = "vec_id long, x array<long>, cluster int, upper double, listed array<int>, lower array<double>, rest double"


def _whole(x: np.ndarray) -> np.ndarray:
    """The numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def small(*parts: np.ndarray) -> bool:
    """Whether squared distances between these whole vectors are exact in doubles."""
    most = max((max(abs(int(p.max())), abs(int(p.min()))) for p in parts if p.size), default=0)
    return 4 * most * most * max(1, parts[0].shape[-1]) < EXACT


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (n, d) and centroids (k, d), or of each vector and its own ones (n, b, d): whole numbers."""
    paired = c.ndim == 3
    if small(x, c):
        if paired:
            diff = x[:, None, :] - c
            return np.einsum("nbd,nbd->nb", diff, diff)
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    diff = _whole(x)[:, None, :] - _whole(c if paired else c[None, :, :])
    return (diff * diff).sum(axis=2)


def roots(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the square roots of whole numbers."""
    r = np.sqrt(d.astype(np.float64))
    # the conversion and the root are off by less than two steps each
    return np.maximum(0.0, down(down(r))), up(up(r))


class State:
    """The bounds of a block of vectors (see the module)."""

    def __init__(self, x: np.ndarray, c: np.ndarray, b: int):
        self.x = x
        n = len(x)
        self.cluster, self.upper, self.rest = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.listed, self.lower = np.zeros((n, b), np.int64), np.zeros((n, b))
        self._scan(np.arange(n), c)

    @classmethod
    def of(cls, x, cluster, upper, listed, lower, rest) -> State:
        self = cls.__new__(cls)
        self.x, self.cluster, self.upper, self.listed, self.lower, self.rest = x, cluster, upper, listed, lower, rest
        return self

    def _scan(self, at: np.ndarray, c: np.ndarray) -> None:
        """Measures all centroids."""
        b = self.listed.shape[1]
        for low in range(0, len(at), STEP):
            part = at[low : low + STEP]
            d = squares(self.x[part], c)
            order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
            near, far = roots(np.take_along_axis(d, order, 1))
            self.cluster[part], self.upper[part] = order[:, 0], far[:, 0]
            self.listed[part], self.lower[part] = order[:, 1 : b + 1], near[:, 1 : b + 1]
            self.rest[part] = near[:, b + 1] if order.shape[1] > b + 1 else np.inf

    def move(self, c: np.ndarray, moved: np.ndarray) -> int:
        """Follows centroids, now c, that moved by `moved` at most; the most listed bounds that a vector needed."""
        b = self.listed.shape[1]
        self.upper = up(self.upper + moved[self.cluster])
        self.lower = down(self.lower - moved[self.listed])
        self.rest = down(self.rest - moved.max(initial=0.0))
        least = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(self.upper >= least)
        for low in range(0, len(open_), STEP):
            part = open_[low : low + STEP]
            self.upper[part] = roots(squares(self.x[part], c[self.cluster[part]][:, None, :])[:, 0])[1]
        open_ = open_[self.upper[open_] >= least[open_]]
        within = self.upper[open_] < self.rest[open_]
        some, every = open_[within], open_[~within]
        needed = 0
        for low in range(0, len(some), STEP):
            needed = max(needed, self._listed(some[low : low + STEP], c))
        self._scan(every, c)
        return b if len(every) else needed

    def _listed(self, at: np.ndarray, c: np.ndarray) -> int:
        """Measures listed centroids whose bound the own distance reaches; the others are farther."""
        asked = self.lower[at] <= self.upper[at][:, None]
        row, col = np.nonzero(asked)
        number = self.listed[at][row, col]
        d = squares(self.x[at][row], c[number][:, None, :])[:, 0]
        own = squares(self.x[at], c[self.cluster[at]][:, None, :])[:, 0]
        near, far = roots(d)
        self.lower[at[row], col] = near
        # The best by (distance, number) of each vector, its own cluster among them.
        rows, numbers, ds = np.concatenate([row, np.arange(len(at))]), np.concatenate([number, self.cluster[at]]), np.concatenate([d, own])
        order = np.lexsort((numbers, ds, rows)) if ds.dtype != object else np.array(sorted(range(len(ds)), key=lambda i: (rows[i], ds[i], numbers[i])), np.int64)
        first = order[np.searchsorted(rows[order], np.arange(len(at)))]
        for k in np.flatnonzero(first < len(row)).tolist():  # a listed one is nearer: it changes places with the own one
            j, i = int(first[k]), int(at[k])
            self.listed[i, col[j]], self.cluster[i] = self.cluster[i], number[j]
            self.lower[i, col[j]], self.upper[i] = roots(own[k : k + 1])[0][0], far[j]
        return int(asked.sum(axis=1).max(initial=0))

    def narrow(self, b: int) -> None:
        """Lists the b nearest by their bounds; the others go to the rest."""
        if b < self.listed.shape[1]:
            order = np.argsort(self.lower, axis=1, kind="stable")
            lower = np.take_along_axis(self.lower, order, 1)
            self.rest = np.minimum(self.rest, lower[:, b])
            self.lower, self.listed = lower[:, :b], np.take_along_axis(self.listed, order, 1)[:, :b]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.ListArray.from_arrays(off, pa.array(x.ravel(), kind))


def _state_of(b: pa.RecordBatch, dim: int) -> State:
    width = len(b.column("listed")[0])
    copied = lambda c: np.array(b.column(c))
    return State.of(_matrix(b.column("x"), dim), copied("cluster").astype(np.int64), copied("upper"), _matrix(b.column("listed"), width).astype(np.int64), _matrix(b.column("lower"), width).copy(), copied("rest"))


def _batch(ids: pa.Array, s: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, _lists(s.x, pa.int64()), pa.array(s.cluster, pa.int32()), pa.array(s.upper), _lists(s.listed, pa.int32()), _lists(s.lower, pa.float64()), pa.array(s.rest)],
        ["vec_id", "x", "cluster", "upper", "listed", "lower", "rest"],
    )


def _begin(c: np.ndarray, b: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _batch(batch.column("vec_id"), State(_matrix(batch.column("x"), c.shape[1]), c, b))

    return run


def _follow(c: np.ndarray, moved: np.ndarray, b: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = _state_of(batch, c.shape[1])
                needed = s.move(c, moved)
                s.narrow(b)
                out = _batch(batch.column("vec_id"), s)
                yield out.append_column("needed", pa.array(np.full(len(s.x), needed), pa.int32()))

    return run


def _sums(k: int, dim: int):
    """(cluster, place, n, total) of a task's vectors; totals are added up in parts that a long holds."""

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            x, cluster = _matrix(batch.column("x"), dim), np.asarray(batch.column("cluster"))
            n += np.bincount(cluster, minlength=k)
            for i in np.unique(cluster).tolist():
                part = x[cluster == i]
                most = max(abs(int(part.max())), abs(int(part.min())))
                total[i] += _whole(part.sum(axis=0)) if most * len(part) < 1 << 62 else _whole(part).sum(axis=0)
        some = np.flatnonzero(n)
        i, j = np.repeat(some, dim), np.tile(np.arange(dim), len(some))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = (i, j, np.repeat(n[some], dim), [int(v) for v in total[some].ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["cluster", "place", "n", "total"])

    return run


def _distances(c: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster = _matrix(batch.column("x"), c.shape[1]), np.asarray(batch.column("cluster"))
            d = [squares(x[low : low + STEP], c[cluster[low : low + STEP]][:, None, :])[:, 0] for low in range(0, len(x), STEP)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array([int(v) for v in np.concatenate(d)], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, at most; 0 where it did not."""
    diff = _whole(new) - _whole(old)
    d = (diff * diff).sum(axis=1)
    return np.where(d == 0, 0.0, roots(d)[1])


def cluster(spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    ship(spark)
    work = Scratch(spark, "clusters")
    whole = F.expr(f"transform(embedding, x -> CAST(floor({scale}D * x) AS LONG))")
    good = F.expr(f"embedding IS NOT NULL AND size(embedding) = {dim} AND forall(embedding, x -> coalesce(abs(x) < double('Infinity') AND NOT isnan(x), false))")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(good)
    kept = work.table(kept.select("vec_id", whole.alias("x")), "vectors")
    start = kept.filter("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r.x for r in start], np.int64).reshape(len(start), dim)
    k = len(c)
    few, b = min(k - 1, -(-k // 8)), min(k - 1, max(1, k // 4))
    state = work.table(kept.mapInArrow(_begin(c, b), STATE), "state")
    work.drop(kept)
    for _ in range(rounds):
        new, counts = c.copy(), state.mapInArrow(_sums(k, dim), "cluster int, place int, n long, total decimal(38,0)")
        for r in counts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            new[r.cluster, r.place] = int(r.total) // r.n
        moved, c = _moved(c, new), new
        before, state = state, work.table(state.mapInArrow(_follow(c, moved, b), STATE + ", needed int"), "state")
        work.drop(before)
        b = min(b, max(few, state.agg(F.max("needed")).first()[0] or 0))
    shas = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    found = work.table(state.mapInArrow(_distances(c), "vec_id long, cluster int, distance long"), "distances")
    work.drop(state)
    # k rows at most, with what holds for a whole cluster
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), shas[i]) for i in range(k)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Plain rounds over all centroids, one after the other."""
    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1)::INT AS i, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CENTROIDS}),
e AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range(1, {DIM + 1})) AS j FROM v)"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'i': i}}) AS a FROM (SELECT r, i, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n}) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""
s{n} AS (SELECT a.i AS i, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS m FROM e JOIN a{n} USING (r) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT i, coalesce(list((s - ((s % m) + m) % m) // m ORDER BY j) FILTER (m IS NOT NULL), any_value(c)) AS c FROM c{n} LEFT JOIN s{n} USING (i) GROUP BY i)""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, a.i AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.i))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON a.i = c{ROUNDS}.i
"""


ORACLE_SQL = _sql()
