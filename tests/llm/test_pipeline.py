"""The corpus pipeline, stage by stage and whole, against plain Python on a small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_jaccard import shingles  # the folder of a test is on the path
from test_quality import plain_scores

from siftwork.llm import packing, quality

P = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _sha string, _keep_id long"


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(160):
        good = i % 4 > 0
        text = " ".join((word() if good or r.random() < 0.6 else word().upper()) + ("." if r.random() < 0.1 else "" if good or r.random() < 0.5 else "!!") for _ in range(r.randint(20, 90)))
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(good)))
    base = [t for i, t in rows if i % 4 > 0]
    for i in range(200, 260):  # exact copies up to blanks, and near copies
        t = r.choice(base[:12]).split()
        if i % 2:
            t[r.randrange(len(t))] = word()
        rows.append((i, "  ".join(t)))
    near = base[20].split()
    rows += [(None, base[13]), (None, " ".join(near[:-1] + ["zz"])), (None, base[20]), (None, " ".join(near[:-1] + ["zz"])), (300, base[14]), (300, base[15] + " x"), (300, base[14]), (301, None), (302, ""), (303, " \n"), (None, None)]
    r.shuffle(rows)
    return rows, labels


def first(rows):
    """The row that stays of several: the smallest doc_id, null last, then the smallest hash of its text."""
    import hashlib

    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))


def unique(rows):
    groups: dict = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or ""), []).append(row)
    return [first(g) for g in groups.values()]


def far_apart(rows):
    every = [shingles(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(every):
        for j in range(i):
            if a and every[j] and 100 * len(a & every[j]) >= 80 * len(a | every[j]):
                parent[find(i)] = find(j)
    groups: dict = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return [first(g) for g in groups.values()]


def test_every_stage_and_the_whole(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in rows], COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # Scores are by text; ids only tell which rows are learned from.
    vector = lambda t: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    learned = {i: vector(t) for i, t in rows if i is not None and i < 200}
    probes = {("t", t): vector(t) for _, t in rows}
    known = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    score = plain_scores(learned | probes, known, quality.SHRINKAGE)
    good = [row for row in rows if score[("t", row[1])] >= quality.ACCEPT]
    assert 0 < len(good) < len(rows)
    apart = unique(good)
    kept = far_apart(apart)
    assert len(kept) < len(apart) < len(good)

    work = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, apart, kept), strict=True):
        work = stage(spark, work, str(tmp_path))
        assert work.columns == docs.columns
        work = work.cache()
        assert Counter((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in work.collect()) == Counter((i, re.sub(r"\s+", " ", t or "")) for i, t in want)

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in kept:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, b) in enumerate(packing.pieces(ids)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) == -(-sum(r.length for r in got) // 2048)
