"""N-gram Jaccard join by vertical partitioning, returned as components of linked documents.

1. The global n-gram order is cut into fragments (fragments.py). Every set is shown as hashes of its segments;
   two sets that link share enough equal segments, `need` of them at least.
2. Segments are counted over all documents. Of a set's segments, the need - 1 most common ones are left out
   (of those that a pair shares, its rarest stays in both), and sets with fewer shared ones than `need` go.
   So a passage that many documents hold makes no group by itself.
3. Sets with an equal segment form a group, of one row a set. First each set meets one hub, the most central
   set of its groups (with the most and most common shared segments): stars, not all pairs, so that large groups
   of near copies cost linear work. Then hubs of each group that still has two components meet all its
   members and leave it, until no such group is left: every pair of sets of different components that
   shares a segment has met. These meetings compare small parity maps of the sets within a task (hubs go to
   each salt of a large group) and give out only pairs that may link, few of which do not.
4. Pairs are tested by vertical partitioning: rows (fragment, hub, set, segment) are dealt by fragment and
   hub (large stars by salts, too), a task counts the partial overlaps within a fragment, and these
   are summed for each pair.

Hashes of n-grams and ids of classes (documents with equal sets) have 64 bits.

Defined cases:
- null, empty and blank texts have empty sets, link with nothing and are their own component.
- with fewer words than the width the whole sequence is the one shingle.
- repeated rows are copies, and so linked. Null doc_ids never name a component while it has another
  id; a component of null ids alone has a null id.
- texts of any length are read whole, in stretches of bounded size.
- an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import free_name, mix, sliced, texts
from .bloom import bits_for, build, load, may_hold
from .components import components
from .fragments import Parts, cuts, differ, map_bits, parity, partial, ranges
from .words import SLICE, sets

WIDTH, PERCENT = 5, 80
#: n-grams of a segment (on average, at most) in the count of overlaps; members of a star that one task counts.
SEGMENT, STAR = 128, 512
#: Hubs of a group in rounds after the first one.
HUBS = (4, 1024)

SETS = "doc_id long, n long, cid long, check long, parts array<struct<own: boolean, need: int, sigs: array<long>>>"
_PART = pa.struct([("own", pa.bool_()), ("need", pa.int32()), ("sigs", pa.list_(pa.int64()))])


def _digest(x: np.ndarray) -> tuple[int, int]:
    return int(mix(x).sum(dtype=np.uint64).view(np.int64)), int(mix(x ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64).view(np.int64))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _shown(width: int, percent: int):
    """Each document's class and the segments that it shows."""

    def run(batches):
        for b in batches:
            for part in sliced(b, "text", SLICE):
                every = list(sets(part, width))
                ids = [_digest(x) for x in every]
                p = Parts(every, percent)
                sigs = pa.ListArray.from_arrays(_offsets(p.size), pa.array(p.sigs))
                parts = pa.StructArray.from_arrays([pa.array(p.own), pa.array(p.need, pa.int32()), sigs], fields=list(_PART))
                column = pa.ListArray.from_arrays(_offsets(np.bincount(p.doc, minlength=len(every))), parts)
                marks = [c for c in part.schema.names if c == "mark"]
                arrays = [part.column("doc_id"), pa.array([len(x) for x in every], pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), column]
                yield pa.RecordBatch.from_arrays([*arrays, *(part.column(c) for c in marks)], ["doc_id", "n", "cid", "check", "parts", *marks])

    return run


def _repeated(packed: bytes):
    """Rows (sig, cid, n, part, own, need) of signatures that the filter holds, of parts with as many as they need."""

    def run(batches):
        words = load(packed)
        for b in batches:
            parts = b.column("parts")
            fields = parts.flatten()
            sigs = fields.field("sigs")
            flat = np.asarray(sigs.flatten())
            hit = np.flatnonzero(may_hold(words, flat))
            sizes, counts = np.diff(np.asarray(sigs.offsets)), np.diff(np.asarray(parts.offsets))
            part = np.repeat(np.arange(len(sizes)), sizes)[hit]
            enough = np.bincount(part, minlength=len(sizes)) >= np.asarray(fields.field("need"))
            hit, part = hit[enough[part]], part[enough[part]]
            row = np.repeat(np.arange(b.num_rows), counts)
            number = ranges(np.zeros(len(counts), np.int64), counts)
            of = pa.array(row[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[hit]), b.column("cid").take(of), b.column("n").take(of), pa.array(number[part], pa.int32()), fields.field("own").take(pa.array(part)), fields.field("need").take(pa.array(part))],
                ["sig", "cid", "n", "part", "own", "need"],
            )

    return run


def _grams(width: int, wanted: bytes, kinds: bytes):
    """The whole sets of documents whose doc_id (or null) and class the filters hold; a few others pass too."""

    def run(batches):
        words, known = load(wanted), load(kinds)
        for b in batches:
            col = b.column("doc_id")
            hit = may_hold(words, np.asarray(col.fill_null(0)).astype(np.int64)) | np.asarray(col.is_null())
            for part in sliced(b.filter(pa.array(hit)), "text", SLICE):
                every = [(_digest(x)[0], x) for x in sets(part, width) if len(x)]
                held = may_hold(known, np.array([c for c, _ in every], np.int64))
                every = [x for x, ok in zip(every, held, strict=True) if ok]
                if every:
                    keys = pa.ListArray.from_arrays(_offsets(np.array([len(x) for _, x in every])), pa.array(np.concatenate([x for _, x in every]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in every], pa.int64()), keys], ["cid", "keys"])

    return run


def _cut(batches):
    """Segments of the sets of a star, cut by the size of its hub: (fragment, hub, salt, side, cid, segment)."""
    for b in batches:
        keys = b.column("keys")
        off, flat = np.asarray(keys.offsets), np.asarray(keys.flatten()).view(np.uint64)
        off = off - off[0]
        rows, fragments, segments = [], [], []
        for i, size in enumerate(b.column("hub_n").to_pylist()):
            x, bits = flat[off[i] : off[i + 1]], cuts(size, SEGMENT)
            # np.uint64 shifts by 64 are undefined, so one fragment is cut apart.
            at = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
            found, first = np.unique(at, return_index=True)
            rows.append(np.full(len(found), i))
            fragments.append(found)
            segments.append(np.diff(np.append(first, len(x))))
        if rows:
            of = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(fragments), pa.int64()), *(b.column(c).take(of) for c in ("hub", "salt", "side", "cid")), pa.ListArray.from_arrays(_offsets(np.concatenate(segments)), pa.array(flat.view(np.int64)))],
                ["fragment", "hub", "salt", "side", "cid", "segment"],
            )


def _counted(batches):
    """Partial overlaps (hub, cid, partial) of rows sorted by (fragment, hub, salt, side): the hub's row comes first."""
    names = ("fragment", "hub", "salt")
    key, segment = None, np.empty(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(c)) for c in names]
        starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        lists = b.column("segment")
        off, flat = np.asarray(lists.offsets), np.asarray(lists.flatten()).view(np.uint64)
        off = off - off[0]
        side = np.asarray(b.column("side"))
        out = np.zeros(b.num_rows, np.int64)
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            here = tuple(int(c[a]) for c in columns)
            if here != key:
                key, segment = here, np.empty(0, np.uint64)
            if side[a] == 0:
                segment = flat[off[a] : off[a + 1]].copy()
                a += 1
            if a < e and len(segment):
                out[a:e] = partial(segment, flat[off[a] : off[e]], np.diff(off[a : e + 1]))
        some = pa.array(np.flatnonzero(out))
        yield pa.RecordBatch.from_arrays([b.column("hub").take(some), b.column("cid").take(some), pa.array(out[out > 0])], ["hub", "cid", "partial"])


def _links(pairs: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from pairs (hub, cid, hub_n, n, hub_comp, comp)."""
    stars = pairs.groupBy("hub", "hub_n").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    members = pairs.join(stars.select("hub", "salts"), "hub").select("hub", "hub_n", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "cid")
    hubs = stars.select("hub", "hub_n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("hub").alias("cid"))
    cut = members.unionByName(hubs).join(keys, "cid").select("hub", "hub_n", "salt", "side", "cid", "keys").mapInArrow(_cut, "fragment long, hub long, salt int, side int, cid long, segment array<long>")
    order = ("fragment", "hub", "salt")
    counted = cut.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_counted, "hub long, cid long, partial long")
    overlaps = counted.groupBy("hub", "cid").agg(F.sum("partial").alias("o"))
    return pairs.join(overlaps, ["hub", "cid"]).filter(f"100 * o >= {percent} * (hub_n + n - o)").select(F.col("hub_comp").alias("a"), F.col("comp").alias("b"))


def _maps(percent: int):
    """Parity maps (cid, own, map) of sets, for pairs of their own band's scheme and of the next one."""

    def run(batches):
        for b in batches:
            keys, n = b.column("keys"), []
            off, flat = np.asarray(keys.offsets), np.asarray(keys.flatten()).view(np.uint64)
            off = off - off[0]
            n = np.diff(off)
            for own in (True, False):
                bits = map_bits(percent, n, np.full(len(n), own))
                maps = [parity(flat[x:y], k) for x, y, k in zip(off[:-1].tolist(), off[1:].tolist(), bits.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([own] * len(n), pa.bool_()), pa.array(maps, pa.binary())], ["cid", "own", "map"])

    return run


def _near(percent: int):
    """Pairs of hubs (side 0) with each other, in salt 0, and with members (side 1), of rows sorted by (sig, salt, side).

    A pair stays if it may link: other components, fitting sizes, and parity maps that differ little enough.
    """
    names = ("cid", "n", "comp", "own", "w")

    def met(hubs: list[np.ndarray], others: list[np.ndarray], within: bool) -> list[np.ndarray]:
        h, x = [[np.asarray(c) for c in side] for side in (hubs, others)]
        total = h[1][:, None] + x[1]
        ok = (h[2][:, None] != x[2]) & (h[3][:, None] | x[3]) & (100 * np.minimum(h[1][:, None], x[1]) >= percent * np.maximum(h[1][:, None], x[1]))
        if within:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if ok.any():
            ok &= differ(h[5], x[5]) <= total * (100 - percent) // (100 + percent)
        i, j = np.nonzero(ok)
        first = (h[4][i] > x[4][j]) | (h[4][i] == x[4][j]) & (h[0][i] > x[0][j])  # the more central one is the hub
        both = [(np.where(first, h[k][i], x[k][j]), np.where(first, x[k][j], h[k][i])) for k in range(3)]
        return [c for pair in both for c in pair]

    def run(batches):
        key, hubs = None, None
        for b in batches:
            if not b.num_rows:
                continue
            sig, salt, side = (np.asarray(b.column(c)) for c in ("sig", "salt", "side"))
            new = np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))
            starts = np.flatnonzero(new | np.append(False, side[1:] != side[:-1])).tolist()
            columns = [np.asarray(b.column(c)) for c in names]
            maps, at = texts(b.column("map"))
            found = []
            for a, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                rows = [*(c[a:e] for c in columns), maps[at[a] : at[e]].reshape(e - a, -1).view(np.uint64)]
                here = (int(sig[a]), int(salt[a]))
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


def _first_pairs(live: DataFrame, percent: int) -> DataFrame:
    """For each set the most central of the hubs of its groups (one each), if that is of another component and fits."""
    me = F.struct("w", "cid", "n", "comp", "own")
    chosen = live.groupBy("sig").agg(F.max(me).alias("h"))
    met = live.join(chosen, "sig").filter(f"h.comp <> comp AND (h.own OR own) AND 100 * least(h.n, n) >= {percent} * greatest(h.n, n)")
    best = met.groupBy("cid", "n", "comp").agg(F.max("h").alias("h"))
    return best.select(F.col("h.cid").alias("hub"), "cid", F.col("h.n").alias("hub_n"), "n", F.col("h.comp").alias("hub_comp"), "comp")


def _later_pairs(live: DataFrame, maps: DataFrame, hubs: int, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hubs (sig, cid), and pairs that may link. In groups of at most `hubs` sets all are hubs."""
    small = live.filter(F.col("m") <= hubs)
    large = live.filter(F.col("m") > hubs)
    bucket = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(hubs)).cast("int")
    chosen = large.groupBy("sig", bucket.alias("bucket")).agg(F.max(F.struct("w", "cid")).alias("h")).select("sig", F.col("h.cid").alias("cid"))
    led = large.join(chosen.withColumn("led", F.lit(True)), ["sig", "cid"], "left")
    salts = F.ceil(F.col("m") / (8 * STAR)).cast("int")
    names = ["sig", "cid", "n", "comp", "own", "w"]
    rows = small.select(*names, F.lit(0).alias("salt"), F.lit(0).alias("side"))
    rows = rows.unionByName(led.filter("led").select(*names, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side")))
    rows = rows.unionByName(led.filter("led IS NULL").select(*names, F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), F.lit(1).alias("side")))
    dealt = rows.join(maps, ["cid", "own"]).repartition("sig", "salt").sortWithinPartitions("sig", "salt", "side")
    pairs = dealt.mapInArrow(_near(percent), "hub long, cid long, hub_n long, n long, hub_comp long, comp long")
    return small.select("sig", "cid").unionByName(chosen), pairs.distinct()


def _groups(work: Scratch, shown: DataFrame) -> DataFrame:
    """Rows (sig, cid, n, own, w) of groups; w tells how central a set is."""
    every = shown.select(F.explode(F.flatten("parts.sigs")).alias("sig"))
    repeated = work.table(every.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("sig"), "repeated")
    known = build(repeated, "sig", bits_for(repeated.count()))
    rows = shown.select("cid", "n", "parts").mapInArrow(_repeated(known), "sig long, cid long, n long, part int, own boolean, need int").distinct()
    rows = work.table(rows, "rows")
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any")).filter("m > 1 AND any").select("sig", "m")
    own = rows.join(counts, "sig").groupBy("cid", "n", "part", "own", "need").agg(F.sort_array(F.collect_list(F.struct("m", "sig"))).alias("list")).filter("size(list) >= need")
    own = own.select("cid", "n", "own", F.expr("aggregate(list, 0L, (a, x) -> a + x.m)").alias("w"), F.explode(F.expr("slice(list, 1, size(list) - need + 1)")).alias("x"))
    out = work.table(own.select("x.sig", "cid", "n", "own", "w"), "groups")
    work.drop(rows, repeated)
    return out


def _linked(spark: SparkSession, docs: DataFrame, width: int, percent: int, mark: Column | None = None) -> tuple[Scratch, DataFrame, DataFrame]:
    """The scratch storage; rows (doc_id, n, cid, ...); classes with the `root` of their component.

    With a `mark`, which tells apart rows of one doc_id, rows have it too, and classes have their `first`
    row: the smallest doc_id (null last), then the smallest mark.
    """
    ship(spark)
    work = Scratch(spark, "jaccard")
    marks = [] if mark is None else [mark.alias("mark")]
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first") for _ in marks]
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), *marks)
    shown = work.table(marked.mapInArrow(_shown(width, percent), SETS + (", mark string" if marks else "")), "sets")
    whole = work.table(shown.filter("n > 0").groupBy("cid", "check", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *first), "classes")
    rows = _groups(work, shown).withColumn("comp", F.col("cid"))
    ids = work.table(whole.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "least"), "ids")
    size = bits_for(ids.count())
    keys = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_grams(width, build(ids.select("least"), "least", size), build(ids.select("cid"), "cid", size)), "cid long, keys array<long>")
    keys = work.table(keys.dropDuplicates(["cid"]), "keys")
    work.drop(ids)
    maps = work.table(keys.mapInArrow(_maps(percent), "cid long, own boolean, map binary"), "maps")
    roots = tested = None
    turn = 0
    while True:
        sign = rows.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("own").alias("any"), F.count(F.lit(1)).alias("m")).filter("c0 <> c1 AND any")
        live = work.table(rows.join(sign.select("sig", "m"), "sig"), "live")
        work.drop(rows)
        if not live.limit(1).count():
            break
        if turn:
            chosen, pairs = _later_pairs(live, maps, HUBS[min(turn, len(HUBS)) - 1], turn, percent)
            pairs = work.table(pairs.join(tested, ["hub", "cid"], "left_anti"), "pairs")
            live = live.join(chosen, ["sig", "cid"], "left_anti")
        else:
            pairs = work.table(_first_pairs(live, percent), "pairs")
        tested = pairs.select("hub", "cid") if tested is None else tested.unionByName(pairs.select("hub", "cid"))
        found = components(work, work.table(_links(pairs, keys, percent), "links"))
        up = found.select(F.col("node").alias("comp"), "root")
        rows = work.table(live.join(up, "comp", "left").select("sig", "cid", "n", "own", "w", F.coalesce("root", "comp").alias("comp")), "rows")
        if roots is None:
            roots = found
        else:
            old = roots.withColumnRenamed("root", "comp").join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))
            roots = work.table(old.unionByName(found.join(roots.select("node"), "node", "left_anti")), "roots")
        turn += 1
    work.drop(keys, maps)
    if roots is None:
        return work, shown, whole.select("*", F.col("cid").alias("root"), F.lit(False).alias("far"))
    linked = whole.join(roots, whole["cid"] == roots["node"], "left").select("cid", "least", "copies", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("far"), *(["first"] if marks else []))
    return work, shown, linked


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: links are 100 * intersection >= percent * union."""
    work, shown, linked = _linked(spark, docs, width, percent)
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    names = work.table(linked.filter("far OR copies > 1").join(named, "root").select("cid", "component_id", F.lit(True).alias("found")), "names")
    out = shown.select("doc_id", "n", "cid").join(names, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the smallest doc_id (null last), then the smallest hash of a text; all columns stay.

    Rows are told apart by (doc_id, hash), so ids may be null or repeated; of rows equal in both any one stays.
    """
    sha = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    work, shown, linked = _linked(spark, docs, width, percent, sha)
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    named = linked.filter("far OR copies > 1").select("cid", "root").join(firsts, "root").select("cid", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    members = shown.filter("n > 0").select("doc_id", "cid", "mark").join(named, "cid").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("stays"))
    # A component's rows that stay are equal in (doc_id, hash); `copies` tells whether there are several.
    counted = work.table(members.groupBy("_id", "_mark", "stays").agg(F.count(F.lit(1)).alias("copies")), "members")
    own = free_name(docs.columns, "_sha")
    marked = docs.withColumn(own, F.coalesce(sha, F.lit("")))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left[own] == right["_mark"]), how)

    kept = joined(marked, counted.filter("NOT stays").select("_id", "_mark"), "left_anti")
    several = counted.filter("stays AND copies > 1").select("_id", "_mark")
    if several.limit(1).count():
        kept = joined(kept, several, "left_anti").unionByName(joined(kept, several, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents"), width=3, percent=90)


#: Exact for tables where few shingles are frequent: pairs come from all shared shingles.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT list_sort(s) AS k, any_value(s) AS s, min(r) AS c FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT c, len(s) AS n, unnest(s) AS sh FROM g),
p AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS o FROM x a JOIN x b ON a.sh = b.sh AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * o >= 90 * (an + bn - o)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
m AS (SELECT s.r, s.doc_id, len(s.s) AS n, g.c FROM s LEFT JOIN g ON list_sort(s.s) = g.k),
z(c, d) AS (SELECT c, c FROM g UNION SELECT z.c, t.b FROM z JOIN t ON z.d = t.a),
q AS (SELECT z.c, min(m.doc_id) AS id FROM z JOIN m ON m.c = z.d GROUP BY z.c)
SELECT m.doc_id, m.n AS n_shingles, coalesce(q.id, m.doc_id) AS component_id FROM m LEFT JOIN q ON m.c = q.c
"""
