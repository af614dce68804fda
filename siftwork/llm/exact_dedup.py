"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is its length and the value of a polynomial over its bytes modulo a prime, in
four lanes. It is composed from hashes of chunks: H(AB) = H(A) * B^len(B) + H(B). Texts above
`huge` characters are cut into slices that are hashed in parallel and composed the same way. Rows
of equal fingerprints are then compared chunk by chunk with the row that stays; rows that differ
(a collision) are fingerprinted again with other bases until none is left.

Defined cases:
- null text counts as empty; empty texts are equal to each other.
- texts are equal when identical after replacing each run of [\\x20\\x09-\\x0D] by one space.
- of equal texts the smallest doc_id stays; a null doc_id is larger than any.
- repeated rows of a doc_id: exactly one of them is kept, if the doc_id stays.
- an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import free_name, raw_values
from .bloom import bits_for, build, load, may_hold

CHUNK = 1024
HUGE = 4 << 20
#: Primes below 2**31, so that products fit 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_TABLE = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_RUN = re.compile(b"  +")


def normal(text: bytes) -> bytes:
    text = text.translate(_TABLE)
    return _RUN.sub(b" ", text) if b"  " in text else text


class Polynomial:
    """Hashes of byte strings in four lanes, and their composition. `modulus` weakens it, for tests."""

    def __init__(self, seed: int = 0, modulus: int | None = None):
        draw = random.Random(1000 + seed)
        self.primes = [modulus or p for p in PRIMES]
        self.bases = [draw.randrange(300, p) if p > 300 else draw.randrange(1, p) for p in self.primes]
        self.low = np.array([[pow(b, CHUNK - 1 - i, p) for b, p in zip(self.bases, self.primes, strict=True)] for i in range(CHUNK)], np.float64)
        self.high = np.ones((1, 4), np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        """B^(CHUNK * i) for i below n."""
        if len(self.high) < n:
            rows = [[int(x) for x in r] for r in self.high]
            step = [pow(b, CHUNK, p) for b, p in zip(self.bases, self.primes, strict=True)]
            while len(rows) < max(n, 2 * len(self.high)):
                rows.append([x * s % p for x, s, p in zip(rows[-1], step, self.primes, strict=True)])
            self.high = np.array(rows, np.uint64)
        return self.high[:n]

    def many(self, values: list[bytes]) -> np.ndarray:
        """An array (len(values), 4). Bytes count from 1, and zeros that fill the first chunk count nothing."""
        sizes = np.array([max(1, -(-len(v) // CHUNK)) for v in values], np.int64)
        ends = np.cumsum(sizes)
        grid = np.zeros(int(sizes.sum()) * CHUNK, np.float32)
        for v, e in zip(values, ends.tolist(), strict=True):
            if v:
                grid[e * CHUNK - len(v) : e * CHUNK] = np.frombuffer(v, np.uint8)
                grid[e * CHUNK - len(v) : e * CHUNK] += 1
        mod = np.array(self.primes, np.uint64)
        parts = np.empty((len(grid) // CHUNK, 4), np.uint64)
        grid = grid.reshape(-1, CHUNK)
        for a in range(0, len(grid), 2048):  # exact: 256 * 2**31 * 1024 < 2**53
            parts[a : a + 2048] = (grid[a : a + 2048].astype(np.float64) @ self.low).astype(np.uint64)
        parts %= mod
        weight = self._powers(int(sizes.max()))[np.repeat(ends, sizes) - 1 - np.arange(len(parts))]
        return np.add.reduceat(parts * weight % mod, ends - sizes, axis=0) % mod

    def combine(self, left: tuple, right: tuple) -> tuple:
        """(length, lanes) of the joined string, from those of its two parts."""
        return left[0] + right[0], [(x * pow(b, right[0], p) + y) % p for x, y, b, p in zip(left[1], right[1], self.bases, self.primes, strict=True)]


PRINT = "doc_id long, len long, a long, b long, sha string"


def _packed(h) -> tuple[int, int]:
    return int(h[0]) << 31 | int(h[1]), int(h[2]) << 31 | int(h[3])


def _whole(seed: int, modulus: int | None):
    def run(batches):
        poly = Polynomial(seed, modulus)
        for b in batches:
            values = [normal(x) for x in raw_values(b.column(1))]
            at = 0
            while at < len(values):
                end, size = at, 0
                while end < len(values) and (end == at or size + len(values[end]) < 2 << 20):
                    size += len(values[end]) + CHUNK
                    end += 1
                part = values[at:end]
                h = [_packed(x) for x in poly.many(part).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array([len(x) for x in part], pa.int64()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string())],
                    ["doc_id", "len", "a", "b", "sha"],
                )
                at = end

    return run


def _slices(seed: int, modulus: int | None):
    """Hash of each slice without a space at its start, and whether there is one and one at its end."""

    def run(batches):
        poly = Polynomial(seed, modulus)
        for b in batches:
            values = [normal(x) for x in raw_values(b.column(3))]
            lead, tail = [v[:1] == b" " for v in values], [v[-1:] == b" " for v in values]
            cut = [v[1:] if x else v for v, x in zip(values, lead, strict=True)]
            h = [poly.many([v])[0].tolist() for v in cut]
            arrays = [b.column(0), b.column(1), b.column(2), pa.array(lead), pa.array(tail), pa.array([len(v) for v in cut], pa.int64()), pa.array(h, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sha", "i", "lead", "tail", "len", "h"])

    return run


def _compose(seed: int, modulus: int | None):
    def run(batches):
        poly = Polynomial(seed, modulus)
        space = (1, poly.many([b" "])[0].tolist())
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                whole, ends = (0, [0] * 4), False
                for x in parts:
                    if x["lead"] and not ends:
                        whole = poly.combine(whole, space)
                    if x["len"]:
                        whole = poly.combine(whole, (x["len"], x["h"]))
                        ends = x["tail"]
                    else:
                        ends = ends or x["lead"]
                out.append((whole[0], *_packed(whole[1])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), b.column(1)], ["doc_id", "len", "a", "b", "sha"])

    return run


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")


def fingerprints(docs: DataFrame, seed: int = 0, modulus: int | None = None, huge: int = HUGE) -> DataFrame:
    """(doc_id, len, a, b, sha): length and hash of each normalised text in bytes, and its SHA-256."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    small = rows.filter(F.length("text") <= huge).mapInArrow(_whole(seed, modulus), PRINT)
    large = rows.filter(F.length("text") > huge).withColumn("sha", F.sha2(squeezed(F.col("text")).cast("binary"), 256))
    cut = large.select("doc_id", "sha", F.expr(f"posexplode(transform(sequence(0, (length(text) - 1) div {huge}), i -> substring(text, i * {huge} + 1, {huge}))) AS (i, s)"))
    parts = cut.repartition("doc_id", "sha", "i").mapInArrow(_slices(seed, modulus), "doc_id long, sha string, i int, lead boolean, tail boolean, len long, h array<long>")
    ordered = parts.groupBy("doc_id", "sha", "i").agg(F.first(F.struct("i", "lead", "tail", "len", "h")).alias("x"), F.count(F.lit(1)).alias("n")).groupBy("doc_id", "sha").agg(F.array_sort(F.collect_list("x")).alias("parts"), F.max("n").alias("n"))
    copies = ordered.select("doc_id", "sha", "parts", F.explode(F.expr("sequence(1, n)")).alias("c")).drop("c")
    return small.unionByName(copies.mapInArrow(_compose(seed, modulus), PRINT))


FP = ["len", "a", "b"]


def _chunks(docs: DataFrame, chars: int) -> DataFrame:
    """Rows (doc_id, sha, i, part) of normalised texts; sha tells apart rows of one doc_id."""
    t = docs.select("doc_id", squeezed(text_of("text")).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return t.select("doc_id", "sha", F.expr(f"posexplode(transform(sequence(0, greatest(length(text) - 1, 0) div {chars}), i -> substring(text, i * {chars} + 1, {chars}))) AS (i, part)"))


def _near(ids: bytes):
    """Rows whose doc_id may be among `ids`; null ones too."""

    def run(batches):
        words = load(ids)
        for b in batches:
            col = b.column(0)
            hit = may_hold(words, np.asarray(col.fill_null(0)).astype(np.int64)) | np.asarray(col.is_null())
            yield b.filter(pa.array(hit))

    return run


def exact_groups(spark: SparkSession, docs: DataFrame, modulus: int | None = None, huge: int = HUGE, chars: int = 1 << 16, rounds: int = 16) -> DataFrame:
    """One row for each row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    modulus weakens the first round's fingerprints, for tests of collisions.
    """
    ship(spark)
    work = Scratch(spark, "exact")
    prints = work.table(fingerprints(docs, 0, modulus, huge).groupBy("doc_id", *FP, "sha").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.lit(0)), "prints")
    settled: list[DataFrame] = []
    me = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")
    for seed in range(1, rounds + 1):
        groups = prints.groupBy("seed", *FP).agg(F.min(me).alias("stays"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts"))
        multi = work.table(groups.filter("size > 1"), "groups")
        # Only groups of several (doc_id, text) rows need a comparison.
        members = work.table(prints.join(multi.filter("texts > 1"), ["seed", *FP]).select("seed", *FP, "doc_id", "sha", "stays"), "members")
        ids = build(members.select("doc_id"), "doc_id", bits_for(members.count()))
        near = docs.select("doc_id", "text").mapInArrow(_near(ids), "doc_id long, text string")
        parts = work.table(_chunks(near, chars).dropDuplicates(["doc_id", "sha", "i"]), "chunks")
        of = members.select("seed", *FP, F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"), "stays")
        mine = parts.join(of, parts["doc_id"].eqNullSafe(of["m_id"]) & (parts["sha"] == of["m_sha"])).select("seed", *FP, "doc_id", "sha", "i", "part", "stays")
        stay = mine.filter(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("sha") == F.col("stays.sha"))).select("seed", *FP, "i", F.col("part").alias("kept_part"))
        compared = mine.select("seed", *FP, "doc_id", "sha", "i", "part").join(stay, ["seed", *FP, "i"], "left")
        apart = work.table(compared.filter(~F.col("part").eqNullSafe(F.col("kept_part"))).select("seed", *FP, "doc_id", "sha").distinct(), "apart")
        on = [prints[c].eqNullSafe(apart[c]) for c in ("seed", *FP, "doc_id", "sha")]
        cond = on[0]
        for c in on[1:]:
            cond &= c
        n_apart = apart.count()
        same = prints.join(apart, cond, "left_anti") if n_apart else prints
        again = same.groupBy("seed", *FP).agg(F.min(me).alias("stays"), F.sum("n").alias("size")).filter("size > 1") if n_apart else multi.select("seed", *FP, "stays", "size")
        settled.append(same.join(again, ["seed", *FP], "left"))
        work.drop(parts, members)
        if not n_apart:
            break
        if seed == rounds:
            raise RuntimeError("fingerprints still collide after every round")
        left = prints.join(apart, cond, "left_semi").select(F.col("doc_id").alias("p_id"), F.col("sha").alias("p_sha"), "n")
        fresh = fingerprints(near, seed, None, huge).dropDuplicates(["doc_id", "sha"])
        prints = work.table(fresh.join(left, fresh["doc_id"].eqNullSafe(left["p_id"]) & (fresh["sha"] == left["p_sha"])).select("doc_id", *FP, "sha", "n", F.lit(seed).alias("seed")), "prints")
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    copies = every.select("*", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    alone = F.col("stays").isNull()
    return copies.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("copy") == 1) & (alone | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("sha") == F.col("stays.sha"))))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay."""
    groups = exact_groups(spark, docs, **options)
    kept = groups.filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    repeated = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if not repeated:
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep_id"]), "left_semi")
    sha = free_name(docs.columns, "_sha")
    marked = docs.withColumn(sha, F.sha2(squeezed(text_of("text")).cast("binary"), 256))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_keep_id"]) & (marked[sha] == kept["_keep_sha"]), "left_semi")
    return found.dropDuplicates(["doc_id", sha]).drop(sha)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
