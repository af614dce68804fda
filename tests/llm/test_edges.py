"""Defined cases of top-k search and WARC records that the other tests leave out."""

import gzip

import pytest
from pyspark.sql import functions as F

from siftwork.llm import topk, warc

VECTORS = "vec_id long, embedding array<double>, score long"


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in topk.search(spark, df.filter("vec_id % 100 = 0"), df, **options).collect())


@pytest.mark.parametrize("wave", [1, 4096])
def test_each_query_row_asks(spark, wave):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]
    k = 1024 * 1024
    want = [(100, 1, 1, 3 * k), (100, 2, 3, k), (100, 3, 2, 0), (100, 4, 100, 0), (100, 1, 2, 2 * k), (100, 2, 3, k), (100, 3, 1, 0), (100, 4, 100, 0)]
    assert found(spark, rows, wave=wave) == sorted(want)


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    k = 1024 * 1024
    copies = [(100, [1.0, 0.0])] * 3 + [(100, [0.0, 1.0]), (5, [1.0, 0.0])]
    one = [(100, 1, 5, k), (100, 2, 100, k), (100, 3, 100, k), (100, 4, 100, 0)]
    other = [(100, r, v, 0) for r, v in ((1, 5), (2, 100), (3, 100), (4, 100))]
    assert found(spark, copies) == sorted(one * 3 + other)
    assert found(spark, copies, k=2) == sorted(one[:2] * 3 + other[:2])


def test_no_rows_and_no_queries(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(100, [1.0]), (200, None)]) == []


def test_large_components_are_exact_or_fail(spark):
    big = float(2**50)  # scaled 2**60, beyond what doubles add exactly
    assert found(spark, [(100, [1 / 1024, 1 / 1024]), (1, [big, 1.0]), (2, [big, 0.0])]) == [(100, 1, 1, 2**60 + 1024), (100, 2, 2, 2**60)]
    for value in (1e300, 1.7e308):
        with pytest.raises(Exception, match="OverflowError"):
            found(spark, [(100, [1.0]), (1, [value])])


def record(kind, name, url, date, block):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n" + (f"WARC-Record-ID: {name}\r\n" if name else "") + f"WARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_broken_files_keep_what_comes_before(spark):
    r = [record("response", f"r{i}", "http://a.b/", f"2024-01-01T00:00:0{i}.25Z", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\n" + bytes(range(256)) * 400) for i in range(3)]
    cut = gzip.compress(r[0]) + gzip.compress(r[1])[:-40]
    files = [r[0] + r[1][:-50], cut, b"\x1f\x8bnothing", b"", None, r[0].replace(b"Content-Length: ", b"Content-Length: -"), b"".join(map(gzip.compress, r)), r[2].replace(b"2024-01", b"when")]
    got = warc.parse(spark, spark.createDataFrame([(f, "x") for f in files], "content binary, url string"))
    names = sorted((x.record_id, x.ts) for x in got.filter("ts IS NOT NULL").collect())
    assert names == [("r0", 1704067200_250000)] * 3 + [("r1", 1704067201_250000), ("r2", 1704067202_250000)]
    assert [x.record_id for x in got.filter("ts IS NULL").collect()] == ["r2"]


def test_records_without_id_repeated_and_clashing(spark):
    rows = [
        (None, "response", "http://a.b/", 1, 200, {"etag": "1"}, b"one"), (None, "response", "http://a.b/c", 1, 200, {"etag": "1"}, b"two"), (None, "response", "http://a.b/c", 1, 200, {"etag": "1"}, b"two"),
        ("v", "revisit", "http://a.b/", 5, 304, {"etag": "1"}, None), ("v", "revisit", "http://a.b/", 5, 304, {"etag": "1"}, None), ("w", "revisit", "http://a.b/c", 9000, 304, {}, None),
        (None, "revisit", None, 5, 304, None, None), (None, "revisit", "http://a.b/", None, 304, None, None), (None, None, None, None, None, None, None),
    ]
    captures = spark.createDataFrame(rows, warc.CAPTURE).withColumn("key", F.lit("k")).withColumn("of", F.lit(1)).withColumn("near", F.lit(1))
    got = sorted((r.record_id or "", r.outcome, r.response_id, r.body and bytes(r.body)) for r in warc.resolve_revisits(spark, captures).collect())
    assert got == [("", "orphan", None, None)] * 2 + [("v", "matched", None, b"one")] * 2 + [("w", "unverified", None, b"two")]
    assert warc.resolve_revisits(spark, captures.limit(0)).count() == 0


def test_only_not_modified_revisits_are_resolved_and_fractions_count(spark):
    def revisit(name, date, status, profile=None):
        r = record("revisit", name, "http://a.b/", date, f"HTTP/1.1 {status} X\r\n\r\n".encode())
        return r.replace(b"WARC-Date", f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/{profile}\r\nWARC-Date".encode()) if profile else r

    files = [record("response", "r", "http://a.b/", "2024-01-01T00:00:00.10Z", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nold"), revisit("same-second", "2024-01-01T00:00:00.90Z", 304), revisit("before", "2024-01-01T00:00:00.05Z", 304)]
    files += [revisit("digest", "2024-01-01T00:00:05Z", 200, "identical-payload-digest"), revisit("named", "2024-01-01T00:00:06Z", 304, "server-not-modified"), revisit("plain 200", "2024-01-01T00:00:07Z", 200)]
    files += [revisit("minute", "2024-01-01T00:01Z", 304), revisit("day", "2024-01-02", 304), revisit("year", "2025", 304), revisit("month", "2023-12", 304), revisit("never", "2024-13-01T00:00:00Z", 304)]
    got = {r.record_id: (r.outcome, r.body and bytes(r.body)) for r in warc.resolve_revisits(spark, warc.parse(spark, spark.createDataFrame([(f,) for f in files], "content binary"))).collect()}
    old, none = ("unverified", b"old"), ("orphan", None)
    assert got == {"same-second": old, "before": none, "digest": ("other", None), "named": old, "plain 200": ("other", None), "minute": old, "day": old, "year": old, "month": none, "never": none}
