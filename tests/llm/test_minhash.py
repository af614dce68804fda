"""b-bit MinHash against brute force, its estimates, and its misses."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import minhash
from test_jaccard import brute, family

DOCS = "doc_id long, text string, n long, cid string, kept int"


def check(spark, rows, width, percent, parts=3, **options):
    df = spark.createDataFrame([(d, t, 1, "x", 1) for d, t in rows], DOCS).repartition(parts)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.minhash_components(spark, df, width, percent, **options).collect()}
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize("width, percent, hubs", [(2, 80, 3), (5, 80, minhash.HUBS)])
def test_families(spark, monkeypatch, width, percent, hubs):
    """Families of near copies at all distances, a passage that many hold, short texts, copies; small hubs and stars."""
    monkeypatch.setattr(minhash, "STAR", 4)
    r = random.Random(width)
    passage = " " + " ".join("".join(r.choice("xyz") for _ in range(6)) for _ in range(40))
    texts = [*family(r, 120, range(9), 90), *family(r, 40, range(5), 30, passage), *family(r, 30, [40], 45, passage)]
    for k in range(40):
        texts += family(r, r.randrange(1, 4), [0, 1, 2], r.randrange(4, 25))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(i + 5000, rows[i * 3][1].upper()) for i in range(30)]
    r.shuffle(rows)
    check(spark, rows, width, percent, hubs=hubs)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "a b c d"), (7, "a b c d"), (8, "a b c d e"), (9, "É b"), (10, "É B"), (0, "x " * 3000)]
    check(spark, rows, 2, 80)
    check(spark, [], 2, 80)
    check(spark, [(1, None), (2, " ")], 2, 80)
    nulls = spark.createDataFrame([(None, "p q r"), (None, "p q r"), (3, "s t u"), (None, "s t u"), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in minhash.minhash_components(spark, nulls, 2).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None, True)] * 2 + [(3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True)], key=str)


def test_long_text_is_read_whole(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(200_000)]
    other = long[:100_000] + [word() for _ in range(100_000)]
    end = long[:-10_000] + [word() for _ in range(10_000)]
    rows = [(1, " ".join(long)), (2, " ".join(end)), (3, " ".join(other))]
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_estimates_are_corrected_and_near():
    """The estimate is near the similarity at all sizes, and pairs at the limit pass both the bands and the estimate."""
    r = np.random.default_rng(6)
    passed = 0
    for n in [5, 20, 100, 1000] * 30:
        same = int(round(n * 0.8))
        x = r.integers(0, 2**63, n * 2 - same, dtype=np.uint64)
        pair = [x[:n], np.concatenate([x[:same], x[n:]])]
        s = same / (2 * n - same)
        least = minhash.minima(pair)
        bits = np.stack([np.frombuffer(row.tobytes(), np.uint64) for row in minhash.packed(least)])
        different = int(minhash.unequal(bits[0] ^ bits[1]))
        assert abs(float(minhash.estimate(np.array(different))) - s) < 0.2
        full = [x[:n], np.concatenate([x[: n * 9 // 10], x[n : n + n // 9 - n // 10]])]
        if 100 * (n * 9 // 10) >= 80 * (n + n // 9 - n // 10):
            least = minhash.minima(full)
            keys, bits = minhash.band_keys(least), np.stack([np.frombuffer(row.tobytes(), np.uint64) for row in minhash.packed(least)])
            assert (keys[0] == keys[1]).any() and minhash.unequal(bits[0] ^ bits[1]) <= minhash.most_different(80)
            passed += 1
    assert passed
    assert (1 - 0.8**minhash.BAND) ** minhash.BANDS < 1e-10


def test_maps_of_any_widths_refuse_no_link():
    """Maps differ in at most as many bits as sets do in shingles, and mostly in so many that near misses are refused."""
    r = np.random.default_rng(8)
    sets = []
    for n in (1, 3, 30, 31, 33, 64, 65, 400, 6000):
        x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        sets += [x[:n], x[: n + n // 9], np.concatenate([x[: n * 4 // 5], x[n : n + n // 5]]), x[n:]]
    keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
    (out,) = minhash._maps([pa.RecordBatch.from_arrays([pa.array(range(len(sets))), keys], ["cid", "keys"])])
    maps = np.empty(len(sets), object)
    for i, m in enumerate(out.column("map").to_pylist()):
        maps[i] = np.frombuffer(m, np.uint64)
    i, j = (a.ravel() for a in np.indices((len(sets), len(sets))))
    differ = minhash.apart(maps, maps, i, j)
    exact = np.array([len(set(sets[a].tolist()) ^ set(sets[b].tolist())) for a, b in zip(i, j, strict=True)])
    assert (differ <= exact).all() and (differ[i == j] == 0).all()
    n = np.array([len(s) for s in sets])
    limit = (n[i] + n[j]) // 9
    fit = 100 * np.minimum(n[i], n[j]) >= 80 * np.maximum(n[i], n[j])  # other pairs meet no map
    over = fit & (exact > 1.3 * limit) & (np.minimum(n[i], n[j]) > 25) & (np.maximum(n[i], n[j]) < 1000)
    assert over.any() and (differ[over] > limit[over]).mean() > 0.9


def test_meetings_of_sets_of_one_size(spark):
    """Sets of equal sizes in one group, most below the limit to each other: all meet, few pairs are left to confirm."""
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in r.sample(range(150), 13):
            words[at] = "".join(r.choice("abcdefgh") for _ in range(6))
        texts.append(" ".join(words))
    check(spark, list(enumerate(texts)), 2, 80, hubs=8)
