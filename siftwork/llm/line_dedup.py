"""Line dedup: range-partitioned line hashes, first occurrences streamed, keep bitmaps returned.

Lines become rows (hash, document, position) of fixed size. They are range-partitioned by hash and
sorted by document (largest id first) and position, so that a line found everywhere is cut over
several partitions like any other stretch of rows. Each partition streams its rows once. The few
keys that lie on a border between partitions, two at most for each partition, are decided by an
aggregation of their own. What comes out is a compressed bitmap for each document with dropped lines.

Defined cases:
- null or empty text: one empty line, kept. Very long texts and lines are hashed whole.
- a null doc_id is one document, smaller than any other.
- repeated rows of a doc_id are one document: its lines count once, and each row gets its result.
- an empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import raw_values

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _rows(docs: DataFrame, min_length: int) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64(text_of("text")).alias("t"), F.posexplode(F.split(text_of("text"), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "t", "pos")


def _stream(border: dict[str, np.ndarray], min_docs: int):
    """Rows of dropped lines, from rows sorted by (h1, h2, doc_id descending, t, pos)."""

    def run(batches):
        carry: dict | None = None  # the last group: its key, documents so far, last document, rows that wait for one more document
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2 = (np.asarray(b.column(i)).astype(np.int64) for i in (0, 1))
            null = np.asarray(b.column(2).is_null())
            doc = np.asarray(b.column(2).fill_null(0)).astype(np.int64)
            t, pos = np.asarray(b.column(3)).astype(np.int64), np.asarray(b.column(4)).astype(np.int64)
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            same = carry is not None and carry["key"] == (h1[0], h2[0])
            other = np.ones(n, bool)
            other[1:] = (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | new[1:]
            if same:
                other[0] = carry["doc"] != (doc[0], null[0])
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            seen = np.cumsum(other)
            before = np.where(starts > 0, seen[starts - 1], 0)
            nth = seen - before[group]  # 1 for the first document of the key
            if same:
                nth[group == 0] += carry["docs"]
            ends = np.append(starts[1:], n) - 1
            total = nth[ends]
            drop = (nth >= 2) & (total[group] >= min_docs)
            out = [(doc[drop], null[drop], t[drop], pos[drop])]
            if same and total[0] >= min_docs:
                out += carry["wait"]
            last = group == group[-1]
            wait = last & (nth >= 2) & ~drop
            held = carry["wait"] if same and group[-1] == 0 and total[-1] < min_docs else []
            if wait.any():
                held = [*held, (doc[wait], null[wait], t[wait], pos[wait])]
            carry = {"key": (h1[-1], h2[-1]), "docs": int(nth[-1]), "doc": (doc[-1], null[-1]), "wait": held}
            yield _dropped(out)

    def inside(batches):
        """As run, but keys on borders follow what was found for them over all partitions."""
        for b in batches:
            h1, h2 = (np.asarray(b.column(i)).astype(np.int64) for i in (0, 1))
            at = np.searchsorted(border["h1"], h1)
            hit = np.zeros(len(h1), bool)
            where = np.zeros(len(h1), np.int64)
            for step in range(border["most"]):  # first halves may be equal
                i = np.minimum(at + step, max(0, len(border["h1"]) - 1))
                ok = (border["h1"][i] == h1) & (border["h2"][i] == h2) if len(border["h1"]) else hit
                where[ok] = i[ok]
                hit |= ok
            if hit.any():
                part = b.filter(pa.array(hit))
                w = where[hit]
                null = np.asarray(part.column(2).is_null())
                doc = np.asarray(part.column(2).fill_null(0)).astype(np.int64)
                drop = border["many"][w] & (null | (doc != border["doc"][w]))
                yield None, _dropped([(doc[drop], null[drop], np.asarray(part.column(3))[drop], np.asarray(part.column(4)).astype(np.int64)[drop])])
            yield b.filter(pa.array(~hit)), None

    def both(batches):
        rest = []

        def others():
            for b, found in inside(batches):
                if found is not None:
                    rest.append(found)
                else:
                    yield b

        for out in run(others()):
            yield from rest
            rest.clear()
            yield out
        yield from rest

    return both


def _dropped(parts: list) -> pa.RecordBatch:
    doc, null, t, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(t, pa.int64()), pa.array(pos.astype(np.int32), pa.int32())], ["doc_id", "t", "pos"])


def _pack(batches):
    for b in batches:
        packed = []
        for places in b.column(2):
            at = np.asarray(places.values)
            bits = np.ones(-(-(int(at.max()) + 1) // 8) * 8, np.uint8)  # whole bytes of ones: lines after the last stay
            bits[at] = 0
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), b.column(3)], ["doc_id", "t", "keep", "last"])


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, t, keep, last) for each document that loses lines.

    t is the xxhash64 of the text, keep a zlib-compressed bitmap of lines 0 to `last` (1: stays);
    lines after `last` stay. Lines whose key has at least min_length code points and is found in at
    least min_docs documents go, but in the largest doc_id that holds it.
    """
    ship(spark)
    work = Scratch(spark, "lines")
    lines = work.table(_rows(docs, min_length), "lines")
    order = ["h1", "h2", F.desc_nulls_last("doc_id"), "t", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    edges = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b"))
    counts: dict[tuple, int] = {}
    for r in edges.collect():  # two keys for each partition at most
        for key in {(r.a.h1, r.a.h2), (r.b.h1, r.b.h2)}:
            counts[key] = counts.get(key, 0) + 1
    keys = sorted(k for k, n in counts.items() if n > 1)
    found = {}
    if keys:
        listed = F.broadcast(spark.createDataFrame(keys, "h1 long, h2 long"))
        pairs = ranged.join(listed, ["h1", "h2"]).select("h1", "h2", "doc_id").distinct()
        found = {(r.h1, r.h2): (r.most, r.n) for r in pairs.groupBy("h1", "h2").agg(F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    h1 = np.array([k[0] for k in keys], np.int64)
    border = {
        "h1": h1, "h2": np.array([k[1] for k in keys], np.int64), "most": int(max(np.unique(h1, return_counts=True)[1], default=0)),
        "many": np.array([found[k][1] >= min_docs for k in keys], bool), "doc": np.array([found[k][0] or 0 for k in keys], np.int64),
    }
    dropped = ranged.mapInArrow(_stream(border, min_docs), "doc_id long, t long, pos int")
    places = dropped.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("places"), F.max("pos").alias("last"))
    return places.mapInArrow(_pack, "doc_id long, t long, keep binary, last int")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with columns keep and last of their bitmaps; null where no line goes."""
    left = docs.withColumn("_t", F.xxhash64(text_of("text")))
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("t").alias("_bt"), F.col("keep").alias("_keep"), F.col("last").alias("_last"))
    return left.join(right, left["_t"].eqNullSafe(right["_bt"]) & left["doc_id"].eqNullSafe(right["_id"]), "left").drop("_id", "_bt", "_t")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the kept lines joined again."""
    if keep is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _digests(batches):
    for b in batches:
        rows = [kept_lines(x, k) for x, k in zip(raw_values(b.column(1)), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def dedup_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with the text of its kept lines: (doc_id, text); all rows, null texts as empty ones."""
    ship(spark)

    def texts(batches):
        for b in batches:
            out = [kept_lines(x, k)[2].decode() for x, k in zip(raw_values(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    joined = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(spark, docs, **options))
    return joined.select("doc_id", "text", "_keep").mapInArrow(texts, "doc_id long, text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = apply_bitmaps(docs, keep_bitmaps(spark, docs))
    return joined.select("doc_id", "text", "_keep").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line,
  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.most AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
