"""warc.resolve_revisits: only full responses serve a revisit."""

import pytest

from siftwork.llm import warc

URL = "http://a.b/"


@pytest.mark.parametrize("apart", [10, 9000])  # within one time bucket, and over several
def test_later_status(spark, apart):
    rows, want = [], {}
    for status in (206, 304, 404, 503, None):
        for tag in ({}, {"etag": '"x"'}):
            url, key = f"{URL}{status}/{len(tag)}", f"{status}-{len(tag)}"
            rows.append((f"good-{key}", "response", url, 100, 200, {"etag": '"1"'}, b"good"))
            rows.append((f"late-{key}", "response", url, 100 + apart, status, tag, b"late"))
            rows.append((f"v-{key}", "revisit", url, 100 + 2 * apart, 304, {"etag": '"1"'}, b""))
            want[f"v-{key}"] = ("matched", f"good-{key}", 200, b"good")
            rows.append((f"only-{key}", "response", f"{url}/only", 100, status, tag, b"late"))
            rows.append((f"w-{key}", "revisit", f"{url}/only", 100 + apart, 304, {"etag": '"x"'}, b""))
            want[f"w-{key}"] = ("orphan", None, None, None)
    rows += [("old", "response", URL, 100, 200, {"etag": '"1"'}, b"old"), ("new", "response", URL, 100 + apart, 200, {"etag": '"2"'}, b"new"), ("v", "revisit", URL, 100 + 2 * apart, 304, {"etag": '"2"'}, b"")]
    want["v"] = ("matched", "new", 200, b"new")
    got = warc.resolve_revisits(spark, spark.createDataFrame(rows, warc.CAPTURE)).collect()
    assert {r.record_id: (r.outcome, r.response_id, r.status, r.body and bytes(r.body)) for r in got} == want
