"""Spelling variant grouping by a positional q-gram inverted index with a count filter.

1. Words are maximal runs of letters, counted in each task on slices of text and then summed.
2. A word is padded with Q - 1 marks on both sides, so it has length + Q - 1 positional q-grams. One edit
   spoils at most Q of them: near words share at least (greater length - 1) of them, at equal places,
   or, behind an inserted code point, at places that differ by one.
3. The global order of q-grams is rarest first, by counts of a sketch of fixed size. Of a word's q-grams in
   that order, the first Q + 1 are posted: near words have a posted q-gram in common, as one edit leaves one of
   them (the order counts equal q-grams by place, and edits keep that order).
4. Postings are dealt by q-gram to cells. In a cell a list is what has one place and one length; words meet the
   lists of their own length at their place, and those of one letter more at their place or the next one.
5. The lists of all words of a cell are merged at once, sorted, in NumPy (a heap would take the entries one by
   one, with the same result). For each merged pair the overlap is completed from the q-grams that are
   not posted; pairs at the bound or above stay, and are verified letter by letter.
6. A word's form is its near word of largest n, if that is at least twice its own n; roots follow by pointers
   to pointers, in at most six rounds, since n doubles with each step.

Cells whose q-gram is frequent are cut into blocks: a word is posted in one row of blocks and meets lists in one
column of blocks, so that no task has more than two shares of a cell.

Defined cases:
- null texts have no words; a null doc_id counts as an empty string before the colon.
- repeated rows count again. Texts are read whole; a text longer than a slice is cut between runs, and a
  run that is longer than a slice is taken alone.
- an empty table gives an empty result. Other columns are not read.
- bytes that are no valid UTF-8 belong to no run.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import mix, sliced, texts
from .fragments import ranges
from .words import hashes

#: Code points of the shortest words, their least count, and the share of runs that lose a code point.
LEAST_LENGTH, LEAST_COUNT, DROP = 5, 3, 97
#: Code points of a q-gram, and how many of a word's q-grams are posted.
Q = 5
POSTED = Q + 1
#: Bytes of text whose runs are counted at once.
SLICE = 1 << 20
#: Counters of the sketch of q-gram counts (of four bytes each), which is sent to all tasks.
COUNTERS = 1 << 18
#: Words of a cell's block, by the sketch; pairs that are compared at once; rows of a task.
BLOCK, PAIRS, ROWS = 1 << 15, 1 << 17, 1 << 16

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First byte of the code points U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_SHORT = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_CRC = _crc_table()


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, their code points, and the text of each."""
    if not len(data):
        return (np.empty(0, np.int64),) * 4
    lead = data == _LEAD
    lead[:-1] &= (data[1:] & 0xC0) == 0x80
    lead[-1] = False
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True  # a run ends with its text
    start, stop = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | border[1:-1]
    stop[:-1] &= ~letter[1:] | border[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return s, e, e - s - (leads[e] - leads[s]), np.searchsorted(off, s, "right") - 1


def _crc(low: np.ndarray, s: np.ndarray, e: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes after a prefix of which `start` is the crc32."""
    size = e - s
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_SHORT) :]
    state, at, left = (start[order] ^ np.uint32(0xFFFFFFFF)), s[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # runs of more than k bytes
        state[:n] = _CRC[(state[:n] ^ low[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(low[s[i] : e[i]].tobytes(), int(start[i]))
    return out.astype(np.int64)


def _strings(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off), pa.py_buffer(flat.tobytes())).cast(pa.string())


def count_slice(data: np.ndarray, off: np.ndarray, prefix: np.ndarray, least: int = LEAST_LENGTH) -> pa.RecordBatch:
    """(word, n) of the runs of texts; `prefix` is the crc32 of what stands before a run of each text."""
    s, e, points, doc = _runs(data, off)
    low = _LOW[data]
    crc = _crc(low, s, e, prefix[doc]) if len(s) else np.empty(0, np.int64)
    cut = crc % DROP == 0
    whole = np.flatnonzero(~cut & (points >= least))
    _, first, which = np.unique(hashes(data, s[whole], e[whole]), return_index=True, return_inverse=True)
    n = np.bincount(which, minlength=len(first))
    at = whole[first]
    words = _strings(low[ranges(s[at], e[at] - s[at])], e[at] - s[at])
    shorter: Counter[str] = Counter()
    for i in np.flatnonzero(cut & (points > least)).tolist():
        run = low[s[i] : e[i]].tobytes().decode()
        k = int(crc[i]) % len(run)
        shorter[run[:k] + run[k + 1 :]] += 1
    return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(list(shorter), pa.string())]), pa.array(np.concatenate([n, np.array(list(shorter.values()), np.int64)]), pa.int64())], ["word", "n"])


def stretches(data: np.ndarray, limit: int):
    """One text in stretches of about `limit` bytes that end between runs, or hold one longer run."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        if end < len(data):
            part = data[at:end]
            other = np.flatnonzero(~_LETTER[part] & (part < 0x80))  # plain bytes other than letters
            if len(other):
                end = at + int(other[-1]) + 1
            else:
                while end < len(data):
                    part = data[end : end + limit]
                    other = np.flatnonzero(~_LETTER[part] & (part < 0x80))
                    end += int(other[0]) + 1 if len(other) else len(part)
                    if len(other):
                        break
        yield data[at:end]
        at = end


def _counted(batches):
    for b in batches:
        for part in sliced(b, "text", SLICE):
            ids = part.column("doc_id").to_pylist()
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
            data, off = texts(part.column("text"))
            if len(data) <= SLICE:
                yield count_slice(data, off, prefix)
            else:
                for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    for piece in stretches(data[a:z], SLICE):
                        yield count_slice(piece, np.array([0, len(piece)]), prefix[k : k + 1])


def words_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(word, n) of all documents."""
    ship(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# Positional q-grams. Words are code points in UTF-32, padded with 1 before and 2 behind.


class Grams:
    """All q-grams of words, one after the other: hashes; and where those of each word begin."""

    def __init__(self, words: list[str], q: int = Q):
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.count = self.size + q - 1
        padded = self.count + q - 1
        first = np.cumsum(padded) - padded
        flat = np.zeros(int(padded.sum()), np.uint32)
        flat[ranges(first, np.full(len(words), q - 1))] = 1
        flat[ranges(first + q - 1 + self.size, np.full(len(words), q - 1))] = 2
        flat[ranges(first + q - 1, self.size)] = raw
        h = np.zeros(max(0, len(flat) - q + 1), np.uint64)
        for k in range(q):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - q + 1 + k])
        self.hash = h[ranges(first, self.count)]
        self.first = np.cumsum(self.count) - self.count
        self.word = np.repeat(np.arange(len(words)), self.count)
        self.place = np.arange(len(self.hash)) - self.first[self.word]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def _sketched(batches):
    """(counter, n): how many q-grams of this task's words fall on each counter."""
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        if b.num_rows:
            total += np.bincount(_cell(Grams(b.column("word").to_pylist()).hash), minlength=COUNTERS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["counter", "n"])


POSTINGS = "cell long, block int, role int, place int, word string, n long"


def _post(sketch: bytes, block: int):
    """Rows (cell, block, role, place, word, n) of the rarest q-grams; role 1 is posted, 2 meets lists, 3 both."""

    def run(batches):
        counts = np.frombuffer(zlib.decompress(sketch), np.uint32).astype(np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            g = Grams(b.column("word").to_pylist())
            much = counts[_cell(g.hash)]
            order = np.lexsort((g.place, g.hash, much, g.word))
            chosen = order[ranges(g.first, np.minimum(POSTED, g.count))]
            word, cell = g.word[chosen], g.hash[chosen]
            side = np.maximum(1, -(-much[chosen] // block))
            home = (mix(cell ^ mix(word_hash(g)[word])) % side.astype(np.uint64)).astype(np.int64)
            rows = [(np.arange(len(chosen))[side == 1], np.zeros(int((side == 1).sum()), np.int64), 3)]
            for i in np.unique(side[side > 1]).tolist():
                at = np.flatnonzero(side == i)
                for j in range(i):
                    same = home[at] == j
                    rows += [(at[same], (home[at] * i + j)[same], 3), (at[~same], (home[at] * i + j)[~same], 1), (at[~same], (j * i + home[at])[~same], 2)]
            for at, number, role in rows:
                if len(at):
                    of = pa.array(word[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at].view(np.int64)), pa.array(number, pa.int32()), pa.array(np.full(len(at), role), pa.int32()), pa.array(g.place[chosen][at], pa.int32()), b.column("word").take(of), b.column("n").take(of)],
                        ["cell", "block", "role", "place", "word", "n"],
                    )

    return run


def word_hash(g: Grams) -> np.ndarray:
    """A hash of each word, from its q-grams and their places."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g.hash + g.place.astype(np.uint64)), dtype=np.uint64)])
    return total[g.first + g.count] - total[g.first]


def _met(batches):
    """Near pairs (a, a_n, b, b_n) of rows sorted by (cell, block); whole blocks are taken at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        cell, block = np.asarray(b.column("cell")), np.asarray(b.column("block"))
        new = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        if held and (held[-1].column("cell")[-1].as_py(), held[-1].column("block")[-1].as_py()) != (int(cell[0]), int(block[0])):
            new = np.append(0, new)
        at = 0
        for border in new.tolist():
            if size + border - at >= ROWS:
                yield from _pairs(pa.Table.from_batches([*held, b.slice(at, border - at)]))
                held, size, at = [], 0, border
        held.append(b.slice(at))
        size += b.num_rows - at
    if held:
        yield from _pairs(pa.Table.from_batches(held))


def _pairs(rows: pa.Table):
    words, n = rows.column("word").to_pylist(), np.asarray(rows.column("n"))
    cell, block, role, place = (np.asarray(rows.column(c)) for c in ("cell", "block", "role", "place"))
    g = Grams(words)
    where = mix(cell.astype(np.int64).view(np.uint64) ^ mix(block.astype(np.uint64) + np.uint64(1)))

    def lists(at: np.ndarray, more: int) -> np.ndarray:
        """Keys of the lists of a place."""
        return mix(where[at] + (place[at] + more + 1).astype(np.uint64))

    by_length = {int(k): np.flatnonzero(g.size == k) for k in np.unique(g.size)}
    matrix = {}  # of q-grams, and of code points, a row for each word of a length; the lengths before go
    for length in sorted(by_length):
        at = by_length[length]
        matrix = {k: v for k, v in matrix.items() if k >= length - 1}
        points = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(at), length)
        matrix[length] = g.hash[g.first[at][:, None] + np.arange(length + Q - 1)], points
        posted = np.flatnonzero(role[at] != 2)
        keys = lists(at[posted], 0)
        order = np.argsort(keys)
        keys, posted = keys[order], posted[order]
        for shorter, more in ((0, 0), (1, 0), (1, 1)):
            other = by_length.get(length - shorter)
            if other is None:
                continue
            asks = np.flatnonzero(role[other] != 1)
            wanted = lists(other[asks], more)
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            count = high - low
            ends = np.cumsum(count)
            for a, z in _spans(ends, PAIRS):
                left = np.repeat(asks[a:z], count[a:z])
                right = posted[ranges(low[a:z], count[a:z])]
                if not shorter:  # of two words in both roles, one order is enough
                    once = (left < right) | (role[at[left]] != 3) | (role[at[right]] != 3)
                    left, right = left[once], right[once]
                left, right = _near(matrix[length - shorter], matrix[length], left, right, shorter == 1)
                if len(left):
                    i, j = other[left], at[right]
                    yield pa.RecordBatch.from_arrays([pa.array([words[x] for x in i.tolist()], pa.string()), pa.array(n[i]), pa.array([words[x] for x in j.tolist()], pa.string()), pa.array(n[j])], ["a", "a_n", "b", "b_n"])


def _spans(ends: np.ndarray, most: int):
    """Ranges of entries with about `most` pairs, from their running sum."""
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        if int(ends[end - 1]) > base:
            yield at, end
        at = end


def _near(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of `one`, rows of `two`, which are a code point longer if told so) at one edit."""
    length = two[1].shape[1]
    x, y = one[0][left], two[0][right]
    same = (x == y[:, :-1]) | (x == y[:, 1:]) if longer else x == y
    enough = np.flatnonzero(same.sum(axis=1) >= length - 1)
    left, right = left[enough], right[enough]
    a, b = one[1][left], two[1][right]
    if longer:
        front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
        back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        ok = front + back >= length - 1
    else:
        ok = (a != b).sum(axis=1) == 1
    return left[ok], right[ok]


def near_pairs(work: Scratch, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct rows (a, a_n, b, b_n) of words (word, n) that differ by one code point, each pair once or in both orders."""
    n = words.count()
    counts = np.zeros(COUNTERS, np.int64)
    for r in words.select("word").mapInArrow(_sketched, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        counts[r.counter] = r.n
    sketch = zlib.compress(np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)
    posted = words.mapInArrow(_post(sketch, block), POSTINGS)
    dealt = posted.repartition(max(8, POSTED * n // ROWS), "cell", "block").sortWithinPartitions("cell", "block")
    return work.table(dealt.mapInArrow(_met, "a string, a_n long, b string, b_n long").distinct(), "pairs")


def variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for each word of the documents."""
    work = Scratch(spark, "spelling")
    words = work.table(words_of(spark, docs), "words")
    pairs = near_pairs(work, words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))).distinct()
    best = both.groupBy(F.col("a").alias("word"), F.col("a_n").alias("n")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("x"))
    fits = -F.col("x.less") >= 2 * F.col("n")
    near = work.table(best.select("word", "n_near", F.when(fits, F.col("x.b")).alias("form"), F.when(fits, -F.col("x.less")).alias("form_n")), "near")
    roots = work.table(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    # n doubles with each step, so a chain has fewer than 64 of them.
    for _ in range(6):
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(up, "root", "left")
        if not moved.filter("next IS NOT NULL").limit(1).count():
            break
        roots = work.table(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, read(spark, sf_dir, "documents"))


#: Near words by deletion neighbourhoods: words that are equal without a code point of each, or of one.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
u AS (SELECT d, r, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT r, n, list_reduce([4294967295::UBIGINT] || flatten(list_transform(flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
    lambda x: [x::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT])),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1::UBIGINT) * 3988292384::UBIGINT)) AS c FROM u),
h AS (SELECT r, n, xor(c, 4294967295::UBIGINT) AS h FROM b),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
y AS MATERIALIZED (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM x),
p AS MATERIALIZED (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM y a JOIN y b ON a.k = b.k AND a.l = b.l AND a.i = b.i AND a.word <> b.word
  UNION SELECT y.word, y.n, w.word, w.n FROM y JOIN w ON y.k = w.word UNION SELECT w.word, w.n, y.word, y.n FROM y JOIN w ON y.k = w.word),
q AS (SELECT a, an, count(*) AS n_near, max(bn) AS most FROM p GROUP BY ALL),
f AS MATERIALIZED (SELECT q.a AS word, q.n_near, CASE WHEN most >= 2 * q.an THEN (SELECT min(p.b) FROM p WHERE p.a = q.a AND p.bn = q.most) END AS form, CASE WHEN most >= 2 * q.an THEN most END AS form_n FROM q),
z(word, root) AS (SELECT word, word FROM w UNION SELECT z.word, f.form FROM z JOIN f ON z.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT z.word, z.root FROM z LEFT JOIN f ON z.root = f.word WHERE f.form IS NULL)
SELECT w.word, w.n, f.form, f.form_n, coalesce(f.n_near, 0) AS n_near, last.root FROM w LEFT JOIN f USING (word) JOIN last USING (word)
"""
