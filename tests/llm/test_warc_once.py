"""warc.resolve_revisits reads its captures once, also where revisits of other profiles are among them."""

from siftwork.llm import warc


def test_captures_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    digest = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    rows = [("r", "response", "http://A.b", 1, 200, {"etag": "1"}, b"x", None), ("v", "revisit", "http://a.b/", 2, 304, {"etag": "1"}, b"", None), ("w", "revisit", "http://A.b#c", 2, 200, {"etag": "1"}, b"y", digest), ("n", "revisit", None, None, None, None, None, digest)]
    schema = warc.CAPTURE + ", profile string"
    captures = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    got = {r.record_id: (r.url, r.ts, r.outcome, r.response_id, r.status, r.headers, r.body and bytes(r.body)) for r in warc.resolve_revisits(spark, captures).collect()}
    assert got == {"v": ("http://a.b/", 2, "matched", "r", 200, {"etag": "1"}, b"x"), "w": ("http://a.b/", 2, "other", None, None, None, None), "n": (None, None, "other", None, None, None, None)}
    assert seen.value == len(rows)
