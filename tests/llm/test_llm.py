"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwork.llm import byte_bpe, chat, exact_dedup, jaccard, line_dedup, packing, quality, topk, url_filter, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, t long, n int"
LINE = "a line of more than twenty characters"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(8)]
    out = [(None, base[0]), (0, None), (1, ""), (2, " \t\n"), (3, base[0]), (3, base[0]), (4, base[0].replace(" ", "  \n", 1)), (5, f"{LINE}\nx\n {LINE.upper()} \n{LINE}"), (6, f"{LINE}\ny"), (7, f"z\n{LINE}"), (8, "one two"), (9, "One  two")]
    for i in range(10, 60):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        out.append((i, " ".join(w)))
    return out + [(100, "long " * 30_000 + base[1]), (101, "long " * 30_000 + base[1])]


def test_line_dedup(spark, rows):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.strip(strip).translate(low)
    holders: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(-1 if i is None else i)
    want = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(h := holders.get(key(x), ())) >= 3 and (-1 if i is None else i) != max(h))]
        want.append((i, "\n".join(kept)))
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark, table(spark, rows)).collect()]
    assert Counter(got) == Counter(want)
    assert line_dedup.dedup_lines(spark, table(spark, [])).count() == 0


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), first and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"modulus": 2, "chars": 1000}, {"huge": 1000, "chars": 700}])
def test_exact_dedup(spark, rows, options):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(spark, table(spark, rows), **options).collect())
    assert got == brute_exact(rows)
    if not options:
        assert exact_dedup.drop_copies(spark, table(spark, rows)).count() == sum(x[3] * n for x, n in got.items())


def test_fingerprints_compose():
    poly = exact_dedup.Polynomial()
    a, b = b"x" * 5000, b"yz" * 700
    h = lambda v: (len(v), poly.many([v])[0].tolist())
    assert poly.combine(h(a), h(b)) == h(a + b)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        want[(doc, len(sets[i]), min(ids) if sets[i] and ids else doc)] += 1
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark, table(spark, rows), width, percent).collect())
    assert got == want


def test_byte_bpe(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(data), special_tokens={})
    r = random.Random(2)
    odd = [(i, "".join(r.choice(" \n\t\r ab'sé1.!\x1c　日😀") for _ in range(30))) for i in range(200, 400)] + [(500, "a" * 3000), (501, "日本" * 400)]
    docs = table(spark, rows[:12] + odd)
    encoded = byte_bpe.encode(docs, data, P.PATTERN)
    got = Counter((x.doc_id, tuple(x.ids)) for x in encoded.collect())
    assert got == Counter((i, tuple(coder.encode_ordinary(t or ""))) for i, t in rows[:12] + odd)
    back = Counter((x.doc_id, bytes(x.bytes)) for x in byte_bpe.decode(encoded, data, P.PATTERN).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in rows[:12] + odd)


def test_packing(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(spark, table(spark, rows)).collect()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(x[3] * n for x, n in want.items()) // 2048) + 2
    assert packing.pack_documents(spark, table(spark, [])).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(spark, docs.withColumn("x", F.lit(1)), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    odd = quality.classify(spark, table(spark, [(None, None), (1, ""), (1, "")]), labels.limit(0)).collect()
    assert [r.score for r in odd] == [1.0] * 3 and quality.classify(spark, table(spark, []), labels).count() == 0


def test_topk(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(0, 900, 3)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(901, 960)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1100, [float("nan")] * 4), (1200, [0.25, 0.5]), (None, [1.0] * 4), (100, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).repartition(3)
    import numpy as np

    good = [(i, np.floor(np.asarray(v, np.float32).astype(float) * 1024)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 100 == 0:
            found = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    for wave in (2, 4096):
        assert sorted(tuple(x) for x in topk.search(spark, df.filter("vec_id % 100 = 0"), df, wave=wave).collect()) == sorted(want)


def test_urls(spark):
    urls = ["http://A.Example.com/en/77", "x://com/en/", "http://mycom/en/", "http://a.com", None, "nothing", "http://b.example.net/de/8?x", "http://q.net/de/9#/de/8", "://org/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string").withColumn("key", F.lit(1))
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark, pages, listed).collect()}
    assert got == {(0, "a.example.com", "example.com/en/7", "allow"), (1, "com", "com/en/", "block"), (2, "mycom", None, "allow"), (3, "a.com", None, "allow"), (4, "", None, "allow"), (5, "", None, "allow"), (6, "b.example.net", "example.net/de/8", "block"), (7, "q.net", "net/de/", "block"), (8, "org", "org/es/", "block"), (None, "a.example.com", "example.com/en/7", "allow")}
    assert url_filter.filter_urls(spark, pages, listed.limit(0)).filter("verdict = 'allow'").count() == 10


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 70, "ann", "yo"), (2, None, None, "x"), (3, 0, "system", "only")], "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    got = {(r.conv_id, r.participant, r.part): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (2, "", -1)}
    a = got[1, "ann", 0]
    assert a.text == "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n"
    assert [a.text[m.start : m.start + m.length] for m in a.mask] == ["hi"]


def test_warc(spark):
    rows = [("r1", "response", "HTTP://A.b:80#f", 10, 200, {"etag": '"1"', "vary": "x"}, b"one"), ("r2", "response", "http://a.b/", 9000, 200, {"etag": '"2"'}, b"two"), ("v0", "revisit", "http://a.b/", 10, 304, {}, b""), ("v1", "revisit", "http://a.b/", 8000, 304, {"etag": 'W/"1"', "date": "d", "server": "s"}, b""), ("v2", "revisit", "http://a.b/", 9001, 304, {"etag": '"1"'}, b""), ("v3", "revisit", None, None, 304, None, b"")]
    got = {r.record_id: r for r in warc.resolve_revisits(spark, spark.createDataFrame(rows, warc.CAPTURE)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {"v0": ("orphan", None), "v1": ("matched", "r1"), "v2": ("mismatch", "r2"), "v3": ("orphan", None)}
    assert dict(got["v1"].headers) == {"etag": 'W/"1"', "vary": "x", "date": "d"} and bytes(got["v1"].body) == b"one"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, "/root/testdata/sf0.001").cache()
        assert new.columns == docs.columns and 0 < new.count() <= kept.count()
        kept = new
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert packed.select("doc_id").distinct().count() == kept.count()
