"""Spelling variants against plain Python, and the index where cells are cut into blocks."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwork.llm import spelling
from siftwork.session import Scratch

DOCS = "doc_id long, text string, word string, n int"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, []
    by = {w: [v for v in words if v != w and near(v, w)] for w in words}
    for w, c in words.items():
        best = min(((-words[v], v) for v in by[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * c else None
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, c, form[w], form[w] and words[form[w]], len(by[w]), root))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS).repartition(parts)
    assert sorted(map(tuple, spelling.variants(spark, df).collect())) == sorted(plain(rows))


def edited(r, word, letters):
    at, what = r.randrange(len(word) + 1), r.random()
    return word[:at] + (r.choice(letters) if what < 0.7 else "") + word[at + (what >= 0.35) :]


@pytest.mark.parametrize("letters", ["ab", "abcdeÀéÿ"])
def test_equals_plain(spark, letters):
    r = random.Random(letters)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(4, 12))) for _ in range(30)]
    words = base + [edited(r, r.choice(base), letters) for _ in range(200)]
    words += [edited(r, w, letters) for w in words[30:130]]
    rows = [(i, r.choice([" ", "-", "Ā", "7\n"]).join(r.choice(words) for _ in range(60))) for i in range(120)]
    check(spark, rows + rows[:5])


def test_chains_case_nulls_and_long_runs(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    rows = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))) for i in range(3)]
    rows += [(None, "ÉTUDE étude Étude ×÷abc " * 3), (None, None), (5, ""), (6, " \n\t"), (7, "Āā 中文words中words wOrds"), (8, "aaaaa aaaaaa aaaaaaa aaaab baaaa " * 4)]
    rows += [(9, "q" * 5000 + " " + "q" * 4999 + " "), (10, ("q" * 5000 + " ") * 3 + ("q" * 4999 + " ") * 3)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None), (None, "")])


def test_texts_longer_than_a_slice(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(3, 9))) for _ in range(80)]
    text = " ".join(r.choice(words) for _ in range(3000)) + "x" * 300 + "é" * 200 + " " + " ".join(words)
    data = np.frombuffer(text.encode(), np.uint8)
    for limit in (40, 64, 1000):
        parts = list(spelling.stretches(data, limit))
        assert b"".join(p.tobytes() for p in parts) == text.encode() and max(map(len, parts)) < limit + 800
        total = Counter()
        for p in parts:
            got = spelling.count_slice(p, np.array([0, len(p)]), np.array([zlib.crc32(b"4:")], np.uint32))
            for w, n in zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True):
                total[w] += n
        assert sorted((w, c) for w, c in total.items() if c >= 3) == sorted((w, c) for w, c, *_ in plain([(4, text)]))


@pytest.mark.parametrize("block", [1, 40])
def test_blocks_of_cells_lose_no_pair(spark, monkeypatch, block):
    """However finely cells are cut, each near pair is found."""
    r = random.Random(8)
    words = list({"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(90)})
    df = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long").repartition(2)
    got = {frozenset((p.a, p.b)) for p in spelling.near_pairs(Scratch(spark, "test"), df, block).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
