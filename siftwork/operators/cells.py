"""Cells of like vectors, and what no row of a cell can exceed, so that a search reads only cells that can hold one of the k best.

Rows are dealt to the nearest of at most MOST pivots, which are vectors of the rows with the smallest hashes of their
keys. Beside the rows lie three small tables: `cells` (pivot, rows, largest distance and angle to the pivot, largest norm),
`words` (each hash of a term with each cell that has it) and `names` (each file name with each cell that has it). A cell's
bound is exact: what it is compared with is the k-th best score of rows that were read, so skipping loses nothing.
Vectors that have another length than the pivots, or values that are null or not finite, lie in cell -1, which is always read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rank, text
from ..schema import TIES
from ..session import ship

#: Rows of a cell that are aimed at, most cells of a part, rows of a written file that are aimed at.
PER_CELL, MOST, PER_FILE = 4096, 1024, 1 << 14
#: Added to a bound for rounding.
SLACK = 1e-6
PLACE = "struct<cell: int, gap: double, angle: double, norm: double>"


def _place(pivots: np.ndarray):
    """A column function from a vector to its cell, and its distance and angle to the cell's pivot."""
    size = pivots.shape[1]
    norms = np.linalg.norm(pivots, axis=1)

    @F.arrow_udf(PLACE)
    def run(vectors: pa.Array) -> pa.Array:
        lists = vectors.fill_null([])
        off = np.asarray(lists.offsets)
        flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
        off = off - off[0]
        fits = np.flatnonzero((np.diff(off) == size) & (size > 0))
        x = flat[off[:-1][fits][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        fits, x = fits[good], x[good]
        n = len(lists)
        cell, gap, angle, norm = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n)
        if len(fits):
            near = (norms**2 - 2 * (x @ pivots.T)).argmin(axis=1)
            own, long = pivots[near], np.linalg.norm(x, axis=1)
            both = long * norms[near]
            cos = np.divide((x * own).sum(axis=1), both, out=np.zeros(len(x)), where=both > 0)
            cell[fits], gap[fits], norm[fits] = near, np.linalg.norm(x - own, axis=1), long
            angle[fits] = np.where(both > 0, np.arccos(np.clip(cos, -1, 1)), np.where(long > 0, np.pi, 0))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(gap), pa.array(angle), pa.array(norm)], ["cell", "gap", "angle", "norm"])

    return run


def lay_out(rows: DataFrame, root: str, per_cell: int = PER_CELL, most: int = MOST) -> None:
    """Write rows (with their terms) by cells under `root`, and the tables of their bounds.

    Files are cut by ranges of (cell, hash of the key), so a cell that holds a third of all rows has as many files as it needs.
    """
    spark = rows.sparkSession
    ship(spark)
    n = rows.count()
    sample = rows.filter(F.size("embedding") > 0).orderBy(F.xxhash64(*TIES), *TIES).limit(min(most, max(1, -(-n // per_cell))))
    found = [r[0] for r in sample.select("embedding").collect()]
    size = max((len(v) for v in found), default=0)
    kept = [v for v in found if len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept = kept or [[0.0] * size]
    pivots = np.array(kept, np.float64).reshape(len(kept), size)
    placed = rows.withColumn("_p", _place(pivots)("embedding")).select(*rows.columns, "_p.cell", F.col("_p.gap").alias("_gap"), F.col("_p.angle").alias("_angle"), F.col("_p.norm").alias("_norm"))
    dealt = placed.repartitionByRange(max(1, -(-n // PER_FILE)), "cell", F.xxhash64(*TIES))
    dealt.write.partitionBy("cell").parquet(f"{root}/rows")
    written = spark.read.schema(dealt.schema).parquet(f"{root}/rows") if n else placed
    stats = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("gap"), F.max("_angle").alias("angle"), F.max("_norm").alias("norm"))
    # One row a cell, at most MOST of them.
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots)], "cell int, pivot array<double>")
    stats.join(F.broadcast(centers), "cell", "left").coalesce(1).write.parquet(f"{root}/cells")
    words = written.select("cell", F.explode("terms").alias("term")).distinct()
    # Sorted as distinct() dealt them, so that they are shuffled once; a term's pairs may lie in several files.
    words.sortWithinPartitions("term").write.parquet(f"{root}/words")
    written.select("cell", text.file_name(F.col("path")).alias("name")).distinct().write.parquet(f"{root}/names")


def bounds(spark: SparkSession, root: str, query: str, vector, weights: rank.RankingWeights, asked: bool) -> list[tuple[float, int, int]]:
    """(bound, cell, rows) of each cell. What reaches the driver has one row a cell: words are met by the query's
    terms, which reach Parquet as a filter, and names are scored once each in the tasks."""
    q = np.asarray(vector, np.float64)
    length = float(np.linalg.norm(q))
    terms = text.terms(query)
    share: dict[int, float] = {}
    if terms and weights.content > 0:
        hits = spark.read.schema("cell int, term long").parquet(f"{root}/words").filter(F.col("term").isin([text.term_hash(F.lit(t)) for t in terms]))
        share = {r.cell: r["count"] / len(terms) for r in hits.groupBy("cell").count().collect()}
    fuzzy: dict[int, float] = {}
    if not asked and weights.fuzzy > 0:
        ship(spark)
        names = spark.read.schema("cell int, name string").parquet(f"{root}/names")
        fuzzy = {r.cell: r.best or 0.0 for r in names.select("cell", rank.fuzzy(query)("name").alias("f")).groupBy("cell").agg(F.max("f").alias("best")).collect()}
    first = weights.semantic + (weights.fuzzy if asked else 0)
    out = []
    for r in spark.read.schema("cell int, n long, gap double, angle double, norm double, pivot array<double>").parquet(f"{root}/cells").collect():
        if r.cell < 0 or not np.isfinite(length):
            near = np.inf
        elif len(r.pivot) != len(q):
            near = 0.0  # vectors of unequal length have no similarity
        else:
            p = np.asarray(r.pivot)
            both = length * np.linalg.norm(p)
            apart = max(0.0, np.arccos(np.clip(q @ p / both, -1, 1)) - r.angle - SLACK) if both > 0 else 0.0
            near = max(0.0, min(q @ p + length * r.gap, length * r.norm * max(0.0, np.cos(min(apart, np.pi / 2)))))
        # No addend is below 0, so one with a weight below 0 adds at most 0; a weight of 0 adds nothing.
        most = (first * near if first > 0 else 0.0) + max(weights.content, 0) * share.get(r.cell, 0.0) + max(weights.fuzzy, 0) * fuzzy.get(r.cell, 0.0)
        out.append((float(most + SLACK * (1 + abs(most))) if np.isfinite(most) else np.inf, r.cell, r.n))
    return sorted(out, key=lambda x: (-x[0], x[1]))
