"""jaccard.one_of_each against brute force on null and repeated ids."""

import random
from collections import Counter

from siftwork.llm import jaccard

DOCS = "doc_id long, text string, n int"


def near(text, k):
    """Near copies: one word added at the end for each k."""
    return f"{text} {k}"


def texts():
    r = random.Random(7)
    return [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(12)]


def components(rows, width=jaccard.WIDTH, percent=jaccard.PERCENT):
    """Lists of row numbers; blank texts are alone."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of = [of[j] if c == of[i] else c for c in of]
    groups: dict = {}
    for i, c in enumerate(of):
        groups.setdefault(c, []).append(i)
    return list(groups.values())


def check(spark, rows):
    """Each component has one row left, and it has the component's smallest id."""
    got = Counter(tuple(r) for r in jaccard.one_of_each(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert not got - Counter(rows)
    for group in components(rows):
        here = [(rows[i][0], rows[i][1]) for i in group]
        left = [(r[0], r[1]) for r, k in got.items() for _ in range(k) if (r[0], r[1]) in here]
        ids = [i for i, _ in here if i is not None]
        if rows[group[0]][1] is None or not rows[group[0]][1].strip():
            continue
        assert len(left) == 1 and left[0][0] == min(ids, default=None)
    blank = lambda x: Counter({r: k for r, k in x.items() if not (r[1] or "").strip()})
    assert blank(got) == blank(Counter(rows))
    return got


def test_null_and_repeated_ids(spark):
    t = texts()
    rows = [(None, near(t[0], 1), 0), (5, near(t[0], 2), 0), (None, t[1], 0), (None, t[2], 0), (6, t[3], 0), (None, None, 0), (None, "", 0)]
    rows += [(None, near(t[4], k), 0) for k in range(4)]
    rows += [(1, near(t[5], 1), 0), (2, near(t[5], 2), 0), (2, t[6], 0), (3, near(t[7], 1), 0), (3, near(t[7], 2), 0), (3, t[8], 0)]
    rows += [(10, t[9], 1), (10, t[9], 2), (None, t[10], 3), (None, t[10], 4), (7, "", 5), (7, "", 6), (8, t[11], 7)]
    got = check(spark, rows)
    assert got[(None, t[1], 0)] == got[(None, t[2], 0)] == got[(2, t[6], 0)] == got[(3, t[8], 0)] == got[(5, near(t[0], 2), 0)] == 1
    assert sum(got.values()) == 16


def test_mixed(spark):
    t, r = texts(), random.Random(1)
    check(spark, [(r.choice([None, None, 1, 2, 3, 4, 5]), near(r.choice(t), r.randrange(4)), 0) for _ in range(60)])
