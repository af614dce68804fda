"""Byte-level BPE by DuckDB recursive queries in each partition; ordered aggregation decodes.

In a Python worker, the distinct words (matches of the splitting pattern) of a batch become rows
(word, position, token). A recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of minimum rank until no word has a pair left. A word that is itself a token
needs no query, as in tiktoken. Decoding joins (text, position, id) rows to the vocabulary and
aggregates bytes in order of position.

If every token's bytes become two tokens by merges of lower ranks than its own, as in trained
vocabularies (each is tried out, once), a step contracts all pairs of a word's minimum rank m, from the
left. That is the same: something could only come between them if one made a new pair of a rank below m,
of tokens x and t, say. But all pairs below m are contracted by now, and so xt would be one token already.
So a long word takes as many steps as it has ranks. For other vocabularies, a step contracts the leftmost
pair alone.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole, in slices
for memory; repeated rows each get their result; an empty table gives an empty result; strings of
special tokens are ordinary text; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import read, ship
from .arrow import sliced
from .units import STEP, Units, flat

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: One row for each token of each word. A step takes every word's pairs of minimum rank, from the left and
#: without overlap: of a run of such pairs, whose neighbours share a token, the first, third, and so on ({which}).
_STEP = """
SELECT * FROM (
  WITH t AS MATERIALIZED (SELECT w, p, id, row_number() OVER () AS i, lead(w) OVER () = w AS more, lead(id) OVER () AS nid FROM ({rows} ORDER BY w, p)),
  q AS MATERIALIZED (SELECT t.w, t.p, t.id, t.i, m.rank FROM t LEFT JOIN merges m ON t.more AND m.l = t.id AND m.r = t.nid),
  g AS (SELECT w, min(rank) AS best FROM q WHERE rank IS NOT NULL GROUP BY w),
  r AS (SELECT q.i, g.w, row_number() OVER (PARTITION BY g.w ORDER BY q.i) AS k FROM q JOIN g ON q.w = g.w AND q.rank = g.best),
  f AS (SELECT i FROM (SELECT i, row_number() OVER (PARTITION BY w, i - k ORDER BY i) AS n, k FROM r) WHERE {which})
  SELECT q.w, q.p, CASE WHEN x.i IS NOT NULL THEN q.rank::INT ELSE q.id END AS id, g.best IS NULL AS done
  FROM q LEFT JOIN g ON q.w = g.w LEFT JOIN f x ON x.i = q.i LEFT JOIN f y ON y.i + 1 = q.i WHERE y.i IS NULL)
"""
_ENCODE = """
WITH RECURSIVE s AS (
  {first}
  UNION ALL
  {next}
)
SELECT w, p, id FROM s WHERE done ORDER BY w, p
"""
_DECODE = "SELECT t.d, string_agg(v.s, '' ORDER BY t.p) AS s FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.d"


def _query(which: str) -> str:
    first, then = (_STEP.format(rows=rows, which=which) for rows in ("SELECT w, p, id FROM bytes", "SELECT w, p, id FROM s WHERE NOT done"))
    return _ENCODE.format(first=first, next=then)


def _trained(ranks: dict[bytes, int]) -> bool:
    """Whether the bytes of every token become two tokens by merges of lower ranks."""
    for token, own in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least >= own:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(token) > 1 and len(parts) != 2:
            return False
    return True


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encodes and decodes with a rank file; holds one DuckDB connection and a bounded word cache."""

    def __init__(self, data: bytes, pattern: str, together: bool | None = None):
        """together: whether a step may contract all pairs of minimum rank; None tries out the vocabulary."""
        self.ranks = parse_ranks(data)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.con.execute("SET enable_progress_bar = false")
        ranks = self.ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, m = zip(*pairs, strict=True)
        merges = pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(m, pa.int64())})
        # A byte is a character from U+0100 on, so that pieces of characters can be aggregated as strings.
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "s": ["".join(chr(256 + b) for b in t) for t in ranks]})
        self.con.register("m_", merges)
        self.con.register("v_", vocab)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m_; CREATE TABLE vocab AS SELECT * FROM v_")
        self.together = _trained(ranks) if together is None else together
        self.query = _query("n % 2 = 1" if self.together else "k = 1")
        self.units = Units(pattern, lambda words: flat(self.words([w.encode() for w in words])))

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [self.ranks.get(w) for w in words]
        todo = [i for i, x in enumerate(out) if x is None and words[i]]
        out = [(x,) if x is not None else () for x in out]
        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and size < 250_000:
                size += len(words[todo[end]])
                end += 1
            part = todo[at:end]
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            sizes = np.array([len(words[i]) for i in part], np.int64)
            w = np.repeat(np.arange(len(part)), sizes)
            p = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.con.register("bytes", pa.table({"w": w.astype(np.int32), "p": p.astype(np.int32), "id": self.byte_ids[data]}))
            got = self.con.execute(self.query).fetchnumpy()
            self.con.unregister("bytes")
            ids = np.asarray(got["id"]).tolist()
            cut = np.searchsorted(np.asarray(got["w"]), np.arange(len(part) + 1)).tolist()
            for i, x, y in zip(part, cut[:-1], cut[1:], strict=True):
                out[i] = ids[x:y]
            at = end
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and the offsets of each."""
        return self.units.ids(column)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        n = len(offsets) - 1
        out = [b""] * n
        sizes = np.diff(offsets)
        self.con.register("tokens", pa.table({"d": np.repeat(np.arange(n), sizes), "p": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        got = self.con.execute(_DECODE).fetchall()
        self.con.unregister("tokens")
        for d, s in got:
            out[d] = s.encode("utf-16-le")[::2]
        return out


_coders: dict[tuple, ByteBPE] = {}


def _coder(data: bytes, pattern: str, together: bool | None = None) -> ByteBPE:
    """The coder of this worker process; its caches stay from task to task."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(data, pattern, together)
    return _coders[key]


def _run(data: bytes, pattern: str, digest: bool):
    together = _coder(data, pattern).together  # tried out here, once, not by each worker

    def run(batches):
        bpe = _coder(data, pattern, together)
        names = [b.decode() for b in (b"%d" % i for i in range(max(bpe.ranks.values()) + 1))]
        for b in batches:
            for part in sliced(b, "text", STEP):
                ids, off = bpe.encode(part.column("text"))
                off = off.tolist()
                each = [ids[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
                sizes = pa.array([len(x) for x in each], pa.int64())
                if digest:
                    said = [hashlib.sha256(",".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in each]
                    back = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, np.array(off))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    values = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs. `ranks` is the content of a rank file, of fixed size."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run(ranks, pattern, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, bytes) for each row of (doc_id, ids); null ids decode to no bytes."""
    ship(encoded.sparkSession)

    def run(batches):
        bpe = _coder(ranks, pattern)
        for b in batches:
            lists = [np.asarray(x or [], np.int64) for x in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.decode(np.concatenate([*lists, np.empty(0, np.int64)]), off), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    ship(spark)
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = f.read()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_run(ranks, public_tokenizers.PATTERN, True), SCHEMA)
