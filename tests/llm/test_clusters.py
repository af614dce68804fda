"""Centroid clustering against plain rounds in Python integers, and its bounds."""

import hashlib
import random

import numpy as np
import pytest

from siftwork.llm import clusters

VECTORS = "vec_id long, embedding array<double>, cluster int, distance long"


def plain(rows, k, rounds, dim, scale=clusters.SCALE):
    good = [(i, tuple(int(np.floor(scale * float(v))) for v in x)) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in good if i is not None)[:k]
    c = [list(x) for _, x in start]
    if not c:
        return []
    d2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min((d2(x, y), n) for n, y in enumerate(c))
    for _ in range(rounds):
        groups: dict = {}
        for _, x in good:
            groups.setdefault(nearest(x)[1], []).append(x)
        for n, xs in groups.items():
            c[n] = [sum(v) // len(xs) for v in zip(*xs, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in good]
    total = sum(d for *_, d in found)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, n, d, sum(e for _, m, e in found if m == n), total, sha[n]) for i, n, d in found]


def check(spark, rows, k=8, rounds=4, dim=3, parts=3, **options):
    df = spark.createDataFrame([(i, x, 9, 9) for i, x in rows], VECTORS).repartition(parts)
    got = clusters.cluster(spark, df, k, rounds, dim, **options)
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain(rows, k, rounds, dim), key=order)


@pytest.mark.parametrize("k", [1, 9])
def test_equals_plain_rounds(spark, k):
    r = random.Random(k)
    middles = [[r.uniform(-2, 2) for _ in range(3)] for _ in range(7)]
    rows = [(i, [v + r.gauss(0, 0.3) for v in r.choice(middles)]) for i in range(400)]
    check(spark, rows, k, 6)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4), 0.0]) for i in range(64)]  # equal vectors and equal distances
    odd = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [])]
    check(spark, grid + grid[:9] + odd + [(None, [0.0, 0.0, 0.0]), (None, [3.0, 3.0, 3.0]), (7, [9.0, 9.0, 9.0])], 12, 5)
    check(spark, [(i, [1.0, 1.0, 1.0]) for i in range(40)], 5, 2)  # all equal: one cluster, the others empty
    check(spark, grid[:3], 40, 2)  # fewer vectors than centroids
    check(spark, [], 4, 2)
    check(spark, [(None, [1.0, 1.0, 1.0])], 4, 2)  # nothing that could start a centroid
    check(spark, odd, 4, 2)


def test_large_components_are_exact_or_fail(spark):
    r = random.Random(5)
    check(spark, [(i, [float(r.randrange(-(2**19), 2**19)) for _ in range(3)]) for i in range(60)], 6, 3)
    with pytest.raises(Exception, match="int too large|too big|does not fit|Overflow|out of bounds|out of range"):
        check(spark, [(1, [1e12, 0.0, 0.0]), (2, [-1e12, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])], 1, 1)


def test_bounds_hold_and_save_distances(monkeypatch):
    """Bounds are never above the distance (lower ones) or below it (upper ones), and few vectors need all centroids."""
    r = np.random.default_rng(2)
    middles = r.normal(0, 400, (10, 16))
    x = np.concatenate([np.floor(m + r.normal(0, 60, (80, 16))) for m in middles]).astype(np.int64)
    c = x[r.choice(len(x), 24, replace=False)].copy()
    state, scanned = clusters.State(x, c, 6), []
    scan = clusters.State._scan
    monkeypatch.setattr(clusters.State, "_scan", lambda self, at, c: (scanned.append(len(at)), scan(self, at, c))[1])
    for turn in range(6):
        new = np.array([x[state.cluster == i].sum(axis=0) // max(1, (state.cluster == i).sum()) if (state.cluster == i).any() else c[i] for i in range(len(c))])
        moved, c = clusters._moved(c, new), new
        state.move(c, moved)
        state.narrow(6 if turn < 3 else 3)
        d = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2).astype(np.float64))
        assert (state.cluster == d.argmin(axis=1)).all()
        at = np.arange(len(x))
        assert (state.upper >= d[at, state.cluster] - 1e-9).all()
        assert (state.lower <= np.take_along_axis(d, state.listed, 1) + 1e-9).all()
        rest = d.copy()
        rest[at, state.cluster] = np.inf
        np.put_along_axis(rest, state.listed, np.inf, 1)
        assert (state.rest <= rest.min(axis=1) + 1e-9).all()
    assert sum(scanned) < 6 * len(x) / 3
