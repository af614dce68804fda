"""The quality classifier against a plain NumPy discriminant, and its defined cases."""

import random
import zlib

import numpy as np
import pytest

from siftwork.llm import quality, words

LABELS = "doc_id long, quality int, toxic int"


def plain_scores(x, labels, shrinkage):
    """log N(x; mean, cov) + log prior by solve and slogdet, on the rows whose label may be learned."""
    known = {(d, y) for d, y in labels if d is not None and y in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2}
    each = [np.array([x[d] for d, y in sorted(known) if y == c and d in x]) for c in (0, 1)]
    cov = [np.cov(e.T, bias=True) for e in each]
    scale = np.sqrt(np.maximum(np.diag(cov[1]), 1e-4))
    every = np.array(list(x.values()))
    logs = []
    for e, v in zip(each, cov, strict=True):
        v = v / np.outer(scale, scale)
        v = (1 - shrinkage) * v + (shrinkage * np.trace(v) / len(v) + 1e-6) * np.eye(len(v))
        z = (every - e.mean(axis=0)) / scale
        logs.append(np.log(len(e) / sum(map(len, each))) - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * (z * np.linalg.solve(v, z.T).T).sum(axis=1))
    return dict(zip(x, 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30))), strict=True))


def corpus(r, n):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8)))
    out = []
    for i in range(n):
        good = i % 2
        text = " ".join((word().upper() if not good and r.random() < 0.3 else word()) + r.choice([".", "", "", "," if good else "!!"]) for _ in range(r.randint(0, 80)))
        out.append((i, None if i == 4 else text, good))
    return out


def test_equals_plain_discriminant(spark):
    rows = corpus(random.Random(8), 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = [(i, y) for i, _, y in rows if i % 3] + [(3, None), (6, 7), (9, 0), (9, 1), (None, 1), (5000, 1)]
    labels += labels[:20]  # repeated rows count once
    got = {r.doc_id: r for r in quality.classify(spark, docs, spark.createDataFrame([(i, y, 0) for i, y in labels], LABELS)).collect()}
    data = {i: (t or "").encode() for i, t, _ in rows}
    x = {i: quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for i, b in data.items()}
    want = plain_scores(x, labels, quality.SHRINKAGE)
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], abs=1e-6)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == (1 if r.score >= 0.7 else 0)


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    for rows, share in (([], 1.0), ([(1, None, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, 1, 0)], 1.0)):
        got = quality.classify(spark, docs, spark.createDataFrame(rows, LABELS)).collect()
        assert [r.score for r in got] == [share] * 4
    assert quality.classify(spark, docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_tie_is_accepted(spark, monkeypatch):
    """A score of exactly 0.7 counts as good, one just below it does not."""
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], LABELS)
    for share, good in ((0.7, 1), (np.nextafter(0.7, 0), 0)):
        monkeypatch.setattr(quality, "fit", lambda *_, share=share: quality.Model(share))
        assert [r.predicted for r in quality.classify(spark, docs, labels).collect()] == [good] * 2
        assert quality.accepted(spark, docs, labels).count() == 2 * good


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(2)
    text = (" ".join("".join(r.choice("aBé9!.") for _ in range(r.choice([1, 5, 400]))) for _ in range(600)) + " " + "Q" * 4000 + "! end\n").encode()
    data = np.frombuffer(text, np.uint8)
    both = np.array([0, len(data) // 2, len(data)])
    want = quality.statistics(data, both[[0, 2]]), quality.statistics(data, both)
    monkeypatch.setattr(words, "SLICE", 1000)
    monkeypatch.setattr(quality, "SLICE", 1000)
    assert np.allclose(quality.statistics(data, both[[0, 2]]), want[0])
    assert np.allclose(quality.statistics(data, both), want[1])
