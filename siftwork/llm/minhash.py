"""Near-duplicate detection by b-bit MinHash, returned as components of linked documents.

1. Each set of word shingles gets K minima under K hash functions. BAND minima together make a band's key; two sets
   with an equal key in a band are candidates. At the least similarity p that links, all BANDS bands fail with
   probability (1 - p ** BAND) ** BANDS, which is 1e-11 for p = 0.8.
2. Of each minimum only its low BITS bits (of a mix of it) are kept, packed side by side. Two sets agree in a share
   s + (1 - s) / 2 ** BITS of them, where s is their similarity: so s is estimated from a count of bits,
   corrected for chance agreement. Candidates whose estimate is SIGMAS standard deviations below p go.
3. The others are confirmed on their full sets, by the vertical counts of the n-gram join (jaccard.py).
4. Sets with an equal band key form a group, of one row a set. First each set meets one hub, the most central
   set of its groups: stars, not all pairs, so that large groups of near copies cost linear work. Then sets
   outside a group's largest component meet the nearest of GUIDES sets of that one, one pair each. At last hubs
   of each group that still has two components, from others than its largest one, meet all its members and
   leave it, until no such group is left: so every pair of sets of different components has met. These meetings compare
   packed bits and parity maps within a task (hubs go to each salt of a large group).

Hashes of shingles and ids of classes (documents with equal sets) have 64 bits.

Defined cases:
- null, empty and blank texts have empty sets, link with nothing and are their own component.
- with fewer words than the width the whole sequence is the one shingle.
- repeated rows are copies, and so linked. Null doc_ids never name a component while it has another id; a
  component of null ids alone has a null id. A row stays where its doc_id is its component's, nulls too.
- texts of any length are read whole, in stretches of bounded size; minima are taken in blocks of shingles.
- an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import mix, sliced, texts
from .bloom import bits_for, build, load, may_hold
from .components import components
from .fragments import parity
from .jaccard import STAR, _digest, _grams, _links, _offsets
from .words import SLICE, sets

WIDTH, PERCENT = 5, 80
#: Minima of a band, bands, and bits kept of each minimum.
BAND, BANDS, BITS = 5, 64, 4
K = BAND * BANDS
#: Standard deviations that an estimate may lie below the least similarity.
SIGMAS = 5.5
#: Shingles hashed at once.
BLOCK = 1 << 15
#: Turns in which sets meet the nearest of some sets of the group's largest component, and how many these are.
GUIDED, GUIDES = 1, 64
#: Bits of the largest parity map; smaller sets have two to four bits a shingle.
MAP_BITS = 1 << 13
#: Hubs of a large group in later turns, which leave it when they have met the whole group.
HUBS = 2048

_DRAW = random.Random(13)
_FACTOR = np.array([_DRAW.getrandbits(64) | 1 for _ in range(K)], np.uint64)
_SHIFT = np.array([_DRAW.getrandbits(64) for _ in range(K)], np.uint64)
_LOW = (1 << BITS) - 1
#: The lowest bit of each packed minimum in a word of 64 bits.
_ONES = np.uint64(sum(1 << i for i in range(0, 64, BITS)))

SETS = "doc_id long, n long, cid long, check long, sigs array<long>, bits binary"


def minima(every: list[np.ndarray]) -> np.ndarray:
    """The K least hashes of each set (all ones for an empty set)."""
    n = np.array([len(x) for x in every], np.int64)
    flat = np.concatenate([*every, np.empty(0, np.uint64)])
    of = np.repeat(np.arange(len(every)), n)
    out = np.full((K, len(every)), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(flat), BLOCK):
        x, row = flat[low : low + BLOCK], of[low : low + BLOCK]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        docs = row[starts]
        for k in range(K):
            out[k, docs] = np.minimum(out[k, docs], np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], starts))
    return np.ascontiguousarray(out.T)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of each set."""
    parts = least.reshape(len(least), BANDS, BAND)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for i in range(BAND):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, a row of bytes for each set."""
    each = 8 // BITS
    low = (mix(least.ravel()).reshape(least.shape) & np.uint64(_LOW)).astype(np.uint8).reshape(len(least), K // each, each)
    return (low << (np.arange(each, dtype=np.uint8) * np.uint8(BITS))).sum(axis=2, dtype=np.uint8)


def unequal(x: np.ndarray) -> np.ndarray:
    """How many packed minima differ, from words that are the exclusive or of two sets' words."""
    shift = 1
    while shift < BITS:  # each minimum's bits on its lowest one
        x = x | (x >> np.uint64(shift))
        shift *= 2
    return np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.int64)


def estimate(different: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing minima, corrected for minima that agree by chance."""
    chance = 1.0 / (1 << BITS)
    return (1.0 - different / K - chance) / (1.0 - chance)


def most_different(percent: int) -> int:
    """Minima that may differ while the estimate lies within SIGMAS standard deviations of the least similarity."""
    p, chance = percent / 100, 1.0 / (1 << BITS)
    agree = p + (1 - p) * chance
    return int(np.ceil(K * (1 - agree) + SIGMAS * (K * agree * (1 - agree)) ** 0.5))


def _maps(batches):
    """Parity maps (cid, map) of sets."""
    for b in batches:
        keys = b.column("keys")
        off, flat = np.asarray(keys.offsets), np.asarray(keys.flatten()).view(np.uint64)
        off = (off - off[0]).tolist()
        maps = [parity(flat[x:y], min(MAP_BITS, 64 << max(0, (2 * (y - x) - 1) // 64).bit_length())) for x, y in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(maps, pa.binary())], ["cid", "map"])


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` words: maps cut to that many by exclusive or, which is what a map of so many bits would be."""
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in maps])


def apart(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the maps of pairs (left[i], right[j]) differ: at most as many as shingles that one set has only."""
    width = np.minimum(np.array([len(x) for x in left], np.int64)[i], np.array([len(x) for x in right], np.int64)[j])
    out = np.empty(len(i), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        a, x = np.unique(i[at], return_inverse=True)
        b, y = np.unique(j[at], return_inverse=True)
        a, b = _folded(left[a], w), _folded(right[b], w)
        for low in range(0, len(at), BLOCK):
            part = slice(low, low + BLOCK)
            out[at[part]] = np.bitwise_count(a[x[part]] ^ b[y[part]]).sum(axis=1, dtype=np.int64)
    return out


def _shown(width: int):
    def run(batches):
        for b in batches:
            for part in sliced(b, "text", SLICE):
                every = list(sets(part, width))
                ids = [_digest(x) for x in every]
                n = np.array([len(x) for x in every], np.int64)
                some = [x for x in every if len(x)]
                least = minima(some)
                keys = pa.ListArray.from_arrays(_offsets(np.where(n > 0, BANDS, 0)), pa.array(band_keys(least).ravel().view(np.int64)))
                bits = iter([row.tobytes() for row in packed(least)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), keys, pa.array([next(bits) if k else None for k in n.tolist()], pa.binary())],
                    ["doc_id", "n", "cid", "check", "sigs", "bits"],
                )

    return run


def _repeated(known: bytes):
    """Rows (sig, cid, n) of keys that the filter holds."""

    def run(batches):
        words = load(known)
        for b in batches:
            lists = b.column("sigs")
            flat = np.asarray(lists.flatten())
            hit = np.flatnonzero(may_hold(words, flat))
            of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column("cid").take(of), b.column("n").take(of)], ["sig", "cid", "n"])

    return run


def _words(column: pa.Array) -> np.ndarray:
    data, off = texts(column)
    return data.reshape(len(off) - 1, -1).view(np.uint64) if len(off) > 1 else np.empty((0, K * BITS // 64), np.uint64)


def _likely(percent: int):
    """Pairs whose estimate is not too low."""
    most = most_different(percent)

    def run(batches):
        for b in batches:
            ok = unequal(_words(b.column("hub_bits")) ^ _words(b.column("bits"))) <= most
            yield b.filter(pa.array(ok)).select(["hub", "cid", "hub_n", "n", "hub_comp", "comp"])

    return run


def _near(percent: int):
    """Pairs of hubs (side 0) with each other, in salt 0, and with members (side 1), of rows sorted by (sig, salt, side).

    A pair stays if it may link: other components, fitting sizes, an estimate that is not too low, and parity maps
    that differ in no more bits than linked sets do in shingles.
    """
    names, most = ("cid", "n", "comp", "w"), most_different(percent)

    def met(h: list[np.ndarray], x: list[np.ndarray], within: bool) -> list[np.ndarray]:
        i, j = np.nonzero((h[2][:, None] != x[2]) & (100 * np.minimum(h[1][:, None], x[1]) >= percent * np.maximum(h[1][:, None], x[1])))
        if within:
            i, j = i[i < j], j[i < j]
        keep = np.concatenate([unequal(h[4][i[a : a + BLOCK]] ^ x[4][j[a : a + BLOCK]]) <= most for a in range(0, len(i), BLOCK)] or [np.empty(0, bool)])
        i, j = i[keep], j[keep]
        keep = apart(h[5], x[5], i, j) <= (h[1][i] + x[1][j]) * (100 - percent) // (100 + percent)
        i, j = i[keep], j[keep]
        first = (h[3][i] > x[3][j]) | (h[3][i] == x[3][j]) & (h[0][i] > x[0][j])  # the more central one is the hub
        return [c for k in range(3) for c in (np.where(first, h[k][i], x[k][j]), np.where(first, x[k][j], h[k][i]))]

    def run(batches):
        key, hubs = None, None
        for b in batches:
            if not b.num_rows:
                continue
            sig, salt, side = (np.asarray(b.column(c)) for c in ("sig", "salt", "side"))
            new = np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))
            starts = np.flatnonzero(new | np.append(False, side[1:] != side[:-1])).tolist()
            data, at = texts(b.column("map"))
            maps = np.empty(b.num_rows, object)  # filled one by one: of arrays of one length NumPy would make a table
            for i, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                maps[i] = data[low:high].view(np.uint64)
            columns = [*(np.asarray(b.column(c)) for c in names), _words(b.column("bits")), maps]
            found = []
            for a, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                rows, here = [c[a:e] for c in columns], (int(sig[a]), int(salt[a]))
                if here != key:
                    key, hubs = here, None
                if side[a] == 0:
                    if salt[a] == 0:
                        found.append(met(rows, rows, True))
                        if hubs is not None:  # of the batch before
                            found.append(met(hubs, rows, False))
                    hubs = rows if hubs is None else [np.concatenate(c) for c in zip(hubs, rows, strict=True)]
                elif hubs is not None:
                    for low in range(0, e - a, STAR):
                        found.append(met(hubs, [c[low : low + STAR] for c in rows], False))
            out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["hub", "cid", "hub_n", "n", "hub_comp", "comp"])

    return run


def _nearest(percent: int):
    """For each member (side 1) the hub (side 0) of its group whose bits differ least, if that pair may link."""
    names, most = ("cid", "n", "comp"), most_different(percent)

    def run(batches):
        key, hubs = None, None
        for b in batches:
            if not b.num_rows:
                continue
            sig, salt, side = (np.asarray(b.column(c)) for c in ("sig", "salt", "side"))
            new = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])
            starts = np.flatnonzero(np.append(True, new)).tolist()
            columns = [*(np.asarray(b.column(c)) for c in names), _words(b.column("bits"))]
            found = [[np.empty(0, np.int64)] * 6]
            for a, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                rows, here = [c[a:e] for c in columns], (int(sig[a]), int(salt[a]))
                if here != key:
                    key, hubs = here, None
                if side[a] == 0:
                    hubs = rows if hubs is None else [np.concatenate(c) for c in zip(hubs, rows, strict=True)]
                    continue
                for low in range(0, e - a if hubs is not None else 0, STAR):
                    x = [c[low : low + STAR] for c in rows]
                    different = unequal(hubs[3][:, None] ^ x[3])
                    different[100 * np.minimum(hubs[1][:, None], x[1]) < percent * np.maximum(hubs[1][:, None], x[1])] = K + 1
                    best = different.argmin(axis=0)
                    ok = np.flatnonzero(different[best, np.arange(len(best))] <= most)
                    found.append([c for k in range(3) for c in (hubs[k][best[ok]], x[k][ok])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["hub", "cid", "hub_n", "n", "hub_comp", "comp"])

    return run


PAIRS = "hub long, cid long, hub_n long, n long, hub_comp long, comp long"


def _first_pairs(live: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """For each set the most central of the hubs of its groups (one each), if that is of another component and may link."""
    chosen = live.groupBy("sig").agg(F.max(F.struct("w", "cid", "n", "comp")).alias("h"))
    met = live.join(chosen, "sig").filter(f"h.comp <> comp AND 100 * least(h.n, n) >= {percent} * greatest(h.n, n)")
    best = met.groupBy("cid", "n", "comp").agg(F.max("h").alias("h"))
    pairs = best.select(F.col("h.cid").alias("hub"), "cid", F.col("h.n").alias("hub_n"), "n", F.col("h.comp").alias("hub_comp"), "comp")
    hubs = bits.select(F.col("cid").alias("hub"), F.col("bits").alias("hub_bits"))
    return pairs.join(bits.drop("map"), "cid").join(hubs, "hub").select("hub", "cid", "hub_n", "n", "hub_comp", "comp", "hub_bits", "bits").mapInArrow(_likely(percent), PAIRS)


def _outside(live: DataFrame) -> DataFrame:
    """live with `g`, the largest component of the group, and `x`, how many sets are of others."""
    parts = live.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = parts.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("g"), F.sum("c").alias("all"))
    return live.join(most.select("sig", F.col("g.comp").alias("g"), (F.col("all") - F.col("g.c")).alias("x")), "sig")


def _second_pairs(live: DataFrame, bits: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each set outside its group's largest component one pair a group: with the nearest of GUIDES sets of that one."""
    marked = _outside(live)
    bucket = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(GUIDES)).cast("int")
    guides = marked.filter("comp = g").groupBy("sig", bucket.alias("bucket")).agg(F.max(F.struct("w", "cid", "n", "comp")).alias("h"), F.max("x").alias("x"))
    salts = F.ceil(F.col("x") / (8 * STAR)).cast("int")
    rows = guides.select("sig", "h.cid", "h.n", "h.comp", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"))
    rows = rows.unionByName(marked.filter("comp <> g").select("sig", "cid", "n", "comp", F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), F.lit(1).alias("side")))
    dealt = rows.join(bits.drop("map"), "cid").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "side")
    return dealt.mapInArrow(_nearest(percent), PAIRS).distinct()


def _later_pairs(live: DataFrame, bits: DataFrame, turn: int, percent: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hubs (sig, cid), and pairs that may link. In groups of at most `hubs` sets all are hubs.

    In larger ones hubs are of other components than the group's largest one: when all of these have met
    the whole group, every pair of different components has.
    """
    small, large = live.filter(F.col("m") <= hubs), live.filter(F.col("m") > hubs)
    others = _outside(large).filter("comp <> g")
    bucket = F.when(F.col("x") > hubs, F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(hubs))).otherwise(F.col("cid"))
    chosen = others.groupBy("sig", bucket.alias("bucket")).agg(F.max(F.struct("w", "cid")).alias("h")).select("sig", F.col("h.cid").alias("cid"))
    led = large.join(chosen.withColumn("led", F.lit(True)), ["sig", "cid"], "left")
    salts = F.ceil(F.col("m") / (8 * STAR)).cast("int")
    names = ["sig", "cid", "n", "comp", "w"]
    rows = small.select(*names, F.lit(0).alias("salt"), F.lit(0).alias("side"))
    rows = rows.unionByName(led.filter("led").select(*names, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side")))
    rows = rows.unionByName(led.filter("led IS NULL").select(*names, F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), F.lit(1).alias("side")))
    dealt = rows.join(bits, "cid").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "side")
    return small.select("sig", "cid").unionByName(chosen), dealt.mapInArrow(_near(percent), PAIRS).distinct()


def _groups(work: Scratch, shown: DataFrame) -> DataFrame:
    """Rows (sig, cid, n, w) of band keys that several sets have; w tells how central a set is."""
    every = shown.select(F.explode("sigs").alias("sig"))
    repeated = work.table(every.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("sig"), "repeated")
    known = build(repeated, "sig", bits_for(repeated.count()))
    rows = work.table(shown.filter("n > 0").select("cid", "n", "sigs").mapInArrow(_repeated(known), "sig long, cid long, n long").distinct(), "rows")
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = rows.join(counts, "sig")
    central = shared.groupBy("cid").agg(F.sum("m").alias("w"))
    out = work.table(shared.select("sig", "cid", "n").join(central, "cid"), "groups")
    work.drop(rows, repeated)
    return out


def minhash_components(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hubs: int = HUBS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: links are 100 * intersection >= percent * union."""
    ship(spark)
    work = Scratch(spark, "minhash")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shown = work.table(plain.mapInArrow(_shown(width), SETS), "sets")
    whole = work.table(shown.filter("n > 0").groupBy("cid", "check", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    rows = _groups(work, shown).withColumn("comp", F.col("cid"))
    ids = work.table(whole.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "least"), "ids")
    size = bits_for(ids.count())
    keys = plain.mapInArrow(_grams(width, build(ids.select("least"), "least", size), build(ids.select("cid"), "cid", size)), "cid long, keys array<long>")
    keys = work.table(keys.dropDuplicates(["cid"]), "keys")
    bits = shown.filter("n > 0").join(ids.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min("bits").alias("bits"))
    bits = work.table(bits.join(keys.mapInArrow(_maps, "cid long, map binary"), "cid"), "bits")
    work.drop(ids)
    roots = tested = None
    turn = 0
    while True:
        signs = rows.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).filter("c0 <> c1")
        live = work.table(rows.join(signs.select("sig", "m"), "sig"), "live")
        work.drop(rows)
        if not live.limit(1).count():
            break
        if 0 < turn <= GUIDED:
            pairs = work.table(_second_pairs(live, bits, turn, percent).join(tested, ["hub", "cid"], "left_anti"), "pairs")
        elif turn:
            chosen, pairs = _later_pairs(live, bits, turn, percent, hubs)
            pairs = work.table(pairs.join(tested, ["hub", "cid"], "left_anti"), "pairs")
            live = live.join(chosen, ["sig", "cid"], "left_anti")
        else:
            pairs = work.table(_first_pairs(live, bits, percent), "pairs")
        tested = pairs.select("hub", "cid") if tested is None else tested.unionByName(pairs.select("hub", "cid"))
        found = components(work, work.table(_links(pairs, keys, percent), "links"))
        up = found.select(F.col("node").alias("comp"), "root")
        rows = work.table(live.join(up, "comp", "left").select("sig", "cid", "n", "w", F.coalesce("root", "comp").alias("comp")), "rows")
        if roots is None:
            roots = found
        else:
            old = roots.withColumnRenamed("root", "comp").join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))
            roots = work.table(old.unionByName(found.join(roots.select("node"), "node", "left_anti")), "roots")
        turn += 1
    work.drop(keys, bits)
    linked = whole.select("cid", "least", "copies", F.col("cid").alias("root"), F.lit(False).alias("far"))
    if roots is not None:
        linked = whole.join(roots, whole["cid"] == roots["node"], "left").select("cid", "least", "copies", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("far"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    names = work.table(linked.filter("far OR copies > 1").join(named, "root").select("cid", "component_id", F.lit(True).alias("found")), "names")
    out = shown.select("doc_id", "n", "cid").join(names, "cid", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(spark, read(spark, sf_dir, "documents"), width=2)


#: All pairs that share a shingle are counted, so it is exact, and quick where few shingles are frequent.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT list_sort(s) AS k, any_value(s) AS s, min(r) AS c FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT c, len(s) AS n, unnest(s) AS sh FROM g),
p AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS o FROM x a JOIN x b ON a.sh = b.sh AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (an + bn - o)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
m AS (SELECT s.r, s.doc_id, len(s.s) AS n, g.c FROM s LEFT JOIN g ON list_sort(s.s) = g.k),
z(c, d) AS (SELECT c, c FROM g UNION SELECT z.c, t.b FROM z JOIN t ON z.d = t.a),
q AS (SELECT z.c, min(m.doc_id) AS id FROM z JOIN m ON m.c = z.d GROUP BY z.c)
SELECT m.doc_id, m.n AS n_shingles, coalesce(q.id, m.doc_id) AS component_id, m.doc_id IS NOT DISTINCT FROM coalesce(q.id, m.doc_id) AS kept FROM m LEFT JOIN q ON m.c = q.c
"""
