"""The Jaccard join against brute force where groups are large: hubs, salts, rounds, long texts, empty tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import fragments, jaccard, words

DOCS = "doc_id long, text string"


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    kinds = {s: i for i, s in enumerate(dict.fromkeys(shingles(t, width) for _, t in rows))}
    every = list(kinds)
    parent = list(range(len(every)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(every):
        for j in range(i):
            if a and every[j] and 100 * len(a & every[j]) >= percent * len(a | every[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for d, t in rows:
        k = find(kinds[shingles(t, width)])
        least[k] = min(least.get(k, d), d)
    return {(d, len(shingles(t, width)), least[find(kinds[shingles(t, width)])] if shingles(t, width) else d) for d, t in rows}


def family(r, size, edits, words_each, common=""):
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    base = [word() for _ in range(words_each)]
    for _ in range(size):
        w = list(base)
        for _ in range(r.choice(edits)):
            at, what = r.randrange(len(w)), r.random()
            w[at : at + 1] = [word()] if what < 0.6 else [] if what < 0.8 else [w[at], word()]
        yield " ".join(w) + common


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_families(spark, monkeypatch, width, percent):
    """A family of 400 near copies at all distances, small ones, short texts, and a passage that all hold."""
    monkeypatch.setattr(jaccard, "HUBS", (2, 48))
    monkeypatch.setattr(jaccard, "STAR", 4)
    r = random.Random(width)
    passage = " " + " ".join("".join(r.choice("xyz") for _ in range(6)) for _ in range(30))
    texts = [*family(r, 400, range(12), 120), *family(r, 60, range(6), 40, passage)]
    for k in range(60):
        texts += family(r, r.randint(1, 4), range(4), r.randint(1, 90), passage if k % 2 else "")
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {tuple(x) for x in jaccard.jaccard_components(spark, spark.createDataFrame(rows, DOCS).repartition(5), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_empty_and_blank(spark):
    assert jaccard.jaccard_components(spark, spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (None, None)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark, spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_what_they_need(percent):
    """Of any two linked sets, `need` shown segments are equal, whatever their sizes."""
    r = np.random.default_rng(percent)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > r.random() * 0.3], r.integers(0, 2**63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        p = fragments.Parts([x, y], percent)
        parts = [(d, o, k, set(s.tolist())) for d, o, k, s in zip(p.doc, p.own, p.need, np.split(p.sigs, np.cumsum(p.size)[:-1]), strict=True)]
        assert any(len(a[3] & b[3]) >= max(a[2], b[2]) for a in parts if a[0] == 0 for b in parts if b[0] == 1 and (a[1] or b[1]))
        bits = fragments.map_bits(percent, np.array([len(x)]), np.array([True]))[0]
        maps = np.frombuffer(fragments.parity(x, bits) + fragments.parity(y, bits), np.uint64).reshape(2, -1)
        assert fragments.differ(maps[:1], maps[1:])[0, 0] <= len(x) + len(y) - 2 * both


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(3)
    text = " ".join("".join(r.choice("aBé") for _ in range(r.choice([1, 5, 300]))) for _ in range(800)) + "  " + "q" * 5000 + "\n end"
    batch = pa.record_batch([pa.array([text, "a b c", None])], names=["text"])
    want = [x.tolist() for x in words.sets(batch, 3)]
    monkeypatch.setattr(words, "SLICE", 1000)
    assert [x.tolist() for x in words.sets(batch, 3)] == want
    assert len(want[0]) == len(shingles(text, 3))
