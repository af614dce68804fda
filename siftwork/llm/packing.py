"""Best-fit packing of token sequences by hierarchical residual packing.

The pieces of documents (a few numbers each, no text) are written once and dealt by a hash over few
partitions of a full window or more, so that each sees all lengths however the files lie. Each partition
packs its pieces best-fit decreasing, in windows of bounded size, and closes nearly full bins. Its underfull bins (the emptiest KEEP_OPEN at most; the others close too) go up a tree as
items: a node packs the open bins of FAN_IN nodes below, and so on to the root. A node gets at most
FAN_IN * KEEP_OPEN bins whatever the size of the input, and the number of levels is logarithmic.

Defined cases:
- null or empty text: the document is its end token alone.
- only documents longer than a sequence are cut: into whole sequences, after a shorter first piece.
- repeated rows and null doc_ids are packed like any others; an empty table gives an empty result.
- pieces of equal rows have one hash and so one partition, which takes them window by window.
- a text that holds the string of a special token is encoded as the tokenizers library does by default.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import sliced
from .fragments import ranges
from .units import PLAIN, STEP, Units, flat

CAPACITY, END = 2048, 0
FAN_IN, KEEP_OPEN, WINDOW, SLACK = 8, 24, 1 << 16, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, node long, sequence_id long, offset long, open boolean"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "node", "sequence_id", "offset", "open"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing; each item goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    mask = 0  # bit r: a bin with r tokens left exists
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        above = mask >> size
        if above:
            rest = size + (above & -above).bit_length() - 1
            at = by_rest[rest].pop()
            if not by_rest[rest]:
                mask ^= 1 << rest
        else:
            rest, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        rest -= size
        if rest:
            by_rest.setdefault(rest, []).append(at)
            mask |= 1 << rest
    return bins


def _placed(items: list[list[tuple]], level: int, node: int, count: int, capacity: int, last: bool) -> tuple[list[tuple], int]:
    """Rows of packed items (lists of piece rows), and the number of bins so far in this node."""
    sizes = [sum(r[3] for r in item) for item in items]
    bins = best_fit(sizes, capacity)
    rest = [capacity - sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -rest[k])
    opened = set() if last else {k for k in order[:KEEP_OPEN] if rest[k] > SLACK << level}
    out = []
    for k, b in enumerate(bins):
        number = (level + 1) << 56 | node << 28 | count
        count += 1
        offset = 0
        for i in b:
            for r in items[i]:
                out.append((*r[:5], node, number, offset, k in opened))
                offset += r[3]
    return out, count


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], NAMES)


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Starts and ends: one piece, or whole sequences after a first one that may be shorter."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


#: A match that ends where the next one of its kind begins, whatever stands between them in a text.
_WORD = regex.compile(r" \p{L}+")
#: Words that the library encodes in one call.
JOINED = 256


class Tokenizer:
    """Ids by the tokenizers library, each distinct match of its splitting pattern encoded once.

    New words that begin with a space are joined to few strings, which the library splits at the same
    places; the bytes of each token tell where its word ends.
    """

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(vocabulary)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = len(token)  # a character of a byte-level token is a byte
        self.joins = pattern == PLAIN
        self.units = Units(pattern, self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.array([self.joins and _WORD.fullmatch(w) is not None for w in words])
        some = [w for w, x in zip(words, joined.tolist(), strict=True) if x]
        texts = ["".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
        texts += [w for w, x in zip(words, joined.tolist(), strict=True) if not x]
        ids, sizes = flat([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        if not some:
            return ids, sizes
        n = int(sizes[: -(-len(some) // JOINED)].sum())
        ends = np.searchsorted(np.cumsum(self.bytes[ids[:n]]), np.cumsum([len(w.encode()) for w in some])) + 1
        count = np.empty(len(words), np.int64)
        count[joined] = np.diff(ends, prepend=0)
        count[~joined] = sizes[-(-len(some) // JOINED) :]
        first = np.empty(len(words), np.int64)
        first[joined] = ends - count[joined]
        first[~joined] = n + np.cumsum(count[~joined]) - count[~joined]
        return ids[ranges(first, count)], count

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        odd = np.zeros(len(column), bool)
        for x in self.special:
            odd |= np.asarray(pc.match_substring(column, x).fill_null(False))
        flat, off = self.units.ids(pc.if_else(pa.array(odd), "", column) if odd.any() else column)
        out = np.split(flat, off[1:-1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_tokenizers: dict[int, Tokenizer] = {}


def _tokenizer(vocabulary: str, pattern: str) -> Tokenizer:
    """The tokenizer of this worker process; its cache stays from task to task."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(vocabulary, pattern)
    return _tokenizers[key]


def _pieces(vocabulary: str, pattern: str, capacity: int):
    def run(batches):
        tokens = _tokenizer(vocabulary, pattern)
        for b in batches:
            for part in sliced(b, "text", STEP):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.ids(part.column("text")), strict=True):
                    ids = np.append(ids, END).astype("<u4")
                    for k, (x, y) in enumerate(pieces(ids, capacity)):
                        rows.append((doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS[:5])], NAMES[:5])

    return run


def _local(capacity: int):
    """Packs windows of WINDOW pieces; the last one has what is left, up to twice as many."""

    def run(batches):
        node, count, waiting = TaskContext.get().partitionId(), 0, []
        for b in batches:
            waiting += [[r] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            while len(waiting) >= 2 * WINDOW:
                rows, count = _placed(waiting[:WINDOW], 0, node, count, capacity, False)
                waiting = waiting[WINDOW:]
                yield _batch(rows)
        if waiting:
            rows, count = _placed(waiting, 0, node, count, capacity, False)
            yield _batch(rows)

    return run


def _merge(level: int, capacity: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py() // FAN_IN
        bins: dict[int, list[tuple]] = {}
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "piece", "start", "length", "ids_crc32")), strict=True), key=lambda r: r[:2])
        for number, _, *row in rows:
            bins.setdefault(number, []).append(tuple(row))
        out, _ = _placed(list(bins.values()), level, node, 0, capacity, last)
        return pa.Table.from_batches([_batch(out)])

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: PIECES, sequence_id and offset. `vocabulary` is the text of a tokenizer file."""
    ship(spark)
    work = Scratch(spark, "packing")
    cut = work.table(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary, pattern, capacity), PIECES), "pieces")
    # The order within a partition comes from a hash, too, so that windows do not depend on where rows lay.
    dealt = cut.repartition(max(1, cut.count() // WINDOW), *cut.columns).sortWithinPartitions(F.xxhash64(*cut.columns), *cut.columns)
    level = work.table(dealt.mapInArrow(_local(capacity), PACKED), "level")
    work.drop(cut)
    tables, depth = [level], 0
    while True:
        waiting = level.filter("open")
        most = waiting.agg(F.max("node")).first()[0]
        if most is None:
            break
        depth += 1
        level = work.table(waiting.groupBy(F.expr(f"node div {FAN_IN}")).applyInArrow(_merge(depth, capacity, most < FAN_IN), PACKED), "level")
        tables.append(level)
    out = tables[0].filter("NOT open")
    for t in tables[1:]:
        out = out.unionByName(t.filter("NOT open"))
    return out.drop("node", "open")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    return pack_documents(spark, read(spark, sf_dir, "documents"), vocabulary)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """pack() with a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        return pack(spark, docs, f.read(), public_tokenizers.PATTERN)
