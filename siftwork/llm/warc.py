"""WARC: parsing of records, and resolution of not-modified revisits by an as-of join.

A revisit (server-not-modified) takes the latest earlier full response of its canonical URL. The
join is in two steps, so that one URL with very many captures is cut by time: the last response of
each (URL, time bucket) is aggregated, carried over buckets, and only captures within one bucket are
sorted together. Bodies and headers join by record id afterwards. The revisit's validators are
checked against the response's, and headers that a 304 may update are merged into the response's.

A full response has a status of FULL: a 206 is a part, a 304 has no body, and errors and redirects
are not what a client kept, so none of them hides an earlier full response.

Only not-modified revisits are resolved: those of a server-not-modified profile, with status 304, or with neither
profile nor status. Others (of equal payload digests, say) tell nothing of validators; their outcome is "other".

Outcomes: matched (equal ETag, or without ETags on both sides equal Last-Modified), mismatch,
unverified (no validator on both sides), orphan (no earlier full response), other (see above).

Defined cases:
- "earlier" is a smaller timestamp; of responses with one timestamp the largest record id counts.
- revisits without a URL or timestamp are orphans; repeated revisit rows each get a result, of
  repeated response rows with one record id any one serves (they are the same record).
- a response without a record id is known by a hash of what it holds, and response_id is null.
- records that cannot be parsed (a bad length, a cut or broken compressed file) end their file's
  records; those before stay. Dates count to the microsecond and may be cut to a minute, day, month or year;
  one that cannot be read is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, read, ship

#: Headers that a 304 response may update (fixed values).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Statuses of responses that hold the whole representation.
FULL = [200, 203]
BUCKET = 3600 * 10**6
#: Bytes of bodies that are held before they are passed on.
HELD = 4 << 20
#: Captures; `profile` may follow, that of a revisit.
CAPTURE = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment gone, an empty path as "/"."""
    plain = F.regexp_replace(F.btrim(url), r"(?s)#.*\z", "")
    site = F.lower(F.regexp_extract(plain, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    port = F.regexp_replace(F.regexp_replace(site, r"\A(http://.*):80\z", "$1"), r"\A(https://.*):443\z", "$1")
    rest = F.substr(plain, F.length(site) + 1)
    return F.concat(port, F.when((site != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest))


def records(data: bytes):
    """(WARC headers, HTTP status, HTTP headers, body) of each record of a plain or gzipped file, one at a time."""
    stream = io.BytesIO(data)
    try:
        yield from _records(gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream)
    except (EOFError, OSError, zlib.error):  # the file ends early or is broken
        return


def _records(stream):
    while True:
        line = stream.readline()
        while line and not line.strip():
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        head = _headers(stream)
        try:
            size = int(head.get("content-length", "0"))
        except ValueError:
            return
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) < size:
            return
        status, http, body = None, {}, block
        if block.startswith(b"HTTP/"):
            inner = io.BytesIO(block)
            first = inner.readline().split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            http = _headers(inner)
            body = inner.read()
        yield head, status, http, body


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "kind", "url", "date", "profile", "status", "headers", "body"])


def parse(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Captures (CAPTURE, profile) of responses and revisits from rows with a binary column `content`."""
    ship(spark)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for head, status, http, body in records(data or b""):
                    if head.get("warc-type") in ("response", "revisit"):
                        rows.append((head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-profile"), status, list(http.items()), body))
                        size += len(body)
                    if size > HELD:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    got = files.select(F.col("content").cast("binary")).mapInArrow(run, "record_id string, kind string, url string, date string, profile string, status int, headers map<string,string>, body binary")
    return got.select("record_id", "kind", "url", micros(F.col("date")).alias("ts"), "status", "headers", "body", "profile")


def micros(date: Column) -> Column:
    """Microseconds of a date as WARC has it: to the second, with a fraction, or cut short."""
    part = lambda i: F.regexp_extract(date, r"\A(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d:\d\d)(?:(:\d\d)(?:\.(\d{1,9}))?)?Z)?)?)?\z", i)
    given = lambda i, default: F.when(part(i) != "", part(i)).otherwise(default)
    whole = F.concat(part(1), F.lit("-"), given(2, "01"), F.lit("-"), given(3, "01"), F.lit("T"), given(4, "00:00"), given(5, ":00"), F.lit("Z"))
    seconds = F.unix_timestamp(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return seconds * 1_000_000 + F.rpad(F.substr(part(6), F.lit(1), F.lit(6)), 6, "0").cast("long")


def resolve_revisits(spark: SparkSession, captures: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each revisit: (record_id, url, ts, outcome, response_id, status, headers, body)."""
    work = Scratch(spark, "warc")
    listed = ", ".join(f"'{h}'" for h in PERMITTED)
    full = (F.col("kind") == "response") & F.col("status").isin(FULL)
    same_record = F.sha2(F.to_json(F.struct("url", "ts", "status", F.array_sort(F.map_entries("headers")).alias("h"), F.sha2("body", 256).alias("b"))), 256)
    profile = F.col("profile") if "profile" in captures.columns else F.lit(None).cast("string")
    same_profile = F.coalesce(profile.endswith("/server-not-modified"), F.lit(False))
    other = (F.col("kind") == "revisit") & ~(same_profile | F.coalesce(F.col("status") == 304, profile.isNull()))
    captures = captures.select("record_id", "kind", "url", "ts", "status", "headers", "body", other.alias("other"))
    rows = captures.filter(full | (F.col("kind") == "revisit")).withColumn("curl", canonical(F.col("url")))
    rows = rows.withColumn("key", F.when(~F.col("other"), F.coalesce(F.concat(F.lit("i"), "record_id"), F.concat(F.lit("h"), same_record))))
    # Captures are read, and so parsed, once; of other revisits nothing but their place goes into the table.
    kept = work.table(rows.withColumns({c: F.when(~F.col("other"), F.col(c)) for c in ("headers", "body")}), "captures")
    rows, others = kept.filter(~F.col("other")).drop("other"), kept.filter("other")
    # A revisit brings what it may update; only that and the validators go through the windows.
    new = F.when(F.col("kind") == "revisit", F.expr(f"map_filter(coalesce(headers, map()), (k, v) -> k IN ({listed}))"))
    slim = rows.select("curl", "ts", "kind", "record_id", "key", F.expr(f"ts div {bucket}").alias("bucket"), "status", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), new.alias("new"))
    placed = slim.filter("curl IS NOT NULL AND ts IS NOT NULL")
    served = F.when(full, F.struct("ts", "record_id", "key", "etag", "modified"))
    last = placed.groupBy("curl", "bucket").agg(F.max(served).alias("last"))
    before = Window.partitionBy("curl").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("curl", "bucket", F.last("last", ignorenulls=True).over(before).alias("carry"))
    within = Window.partitionBy("curl", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max(served).over(within)).filter("kind = 'revisit'")
    found = near.join(carried, ["curl", "bucket"], "left").withColumn("of", F.coalesce("near", "carry"))
    strong = lambda c: F.regexp_replace(c, r"\AW/", "")
    tags, dates = F.col("etag").isNotNull() & F.col("of.etag").isNotNull(), F.col("modified").isNotNull() & F.col("of.modified").isNotNull()
    same = F.when(tags, strong(F.col("etag")) == strong(F.col("of.etag"))).when(dates, F.col("modified") == F.col("of.modified"))
    outcome = F.when(F.col("of").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "matched").otherwise("mismatch")
    judged = found.select("record_id", "curl", "ts", outcome.alias("outcome"), F.col("of.record_id").alias("response_id"), F.col("of.key").alias("of_key"), "new")
    # Without a URL or a time there is nothing earlier.
    lost = slim.filter("kind = 'revisit' AND (curl IS NULL OR ts IS NULL)")
    none = F.lit(None).cast("string")
    judged = judged.unionByName(lost.select("record_id", "curl", "ts", F.lit("orphan").alias("outcome"), none.alias("response_id"), none.alias("of_key"), "new"))
    bodies = rows.filter(full).dropDuplicates(["key"]).select(F.col("key").alias("of_key"), F.col("status").alias("r_status"), F.col("headers").alias("r_headers"), "body")
    joined = judged.join(bodies, "of_key", "left")
    merged = F.expr(f"map_concat(map_filter(coalesce(r_headers, map()), (k, v) -> NOT (k IN ({listed}) AND map_contains_key(coalesce(new, map()), k))), map_filter(coalesce(new, map()), (k, v) -> k IN ({listed})))")
    ok = F.col("outcome").isin("matched", "unverified")
    other = others.select("record_id", F.col("curl").alias("url"), "ts", F.lit("other").alias("outcome"), none.alias("response_id"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"))
    out = joined.select("record_id", F.col("curl").alias("url"), "ts", "outcome", "response_id", F.when(ok, F.col("r_status")).alias("status"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("body")).alias("body"))
    return out.unionByName(other)


def page_files(pages: DataFrame) -> DataFrame:
    """A WARC file for each page: its response r at second page_id, an error e in between, and revisits.

    Not-modified ones are u, in the same second, and v, 1000 seconds later; w is of an equal payload digest.
    """
    html = F.coalesce("html", F.lit("")).cast("string")
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))

    def record(kind: str, prefix: str, later: int, fraction: str, block: Column, profile: str = "") -> Column:
        date = F.date_format(F.timestamp_seconds(F.col("page_id") + later), f"yyyy-MM-dd'T'HH:mm:ss'{fraction}Z'")
        about = f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/{profile}" if profile else ""
        head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {prefix}", F.col("page_id"), f"{about}\r\nWARC-Target-URI: ", F.coalesce("url", F.lit("")), "\r\nWARC-Date: ", date, "\r\nContent-Length: ", F.octet_length(block), "\r\n\r\n", block, "\r\n\r\n"]
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in head])

    full = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nVary: accept\r\nETag: "), tag, F.lit("\r\n\r\n"), html)
    same = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nServer: later\r\nDate: later\r\nETag: "), tag, F.lit("\r\n\r\n"))
    error, copy = F.lit("HTTP/1.1 503 Busy\r\n\r\nbusy"), F.lit("HTTP/1.1 200 OK\r\n\r\n")
    parts = [record("response", "r", 0, ".1", full), record("response", "e", 500, "", error), record("revisit", "u", 0, ".9", same), record("revisit", "v", 1000, "", same, "server-not-modified"), record("revisit", "w", 1000, ".5", copy, "identical-payload-digest")]
    return pages.filter("page_id IS NOT NULL").select(F.concat(*parts).cast("binary").alias("content"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(spark, parse(spark, page_files(read(spark, sf_dir, "pages"))))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return out.select(F.substr("record_id", F.lit(2)).cast("long").alias("page_id"), F.left("record_id", F.lit(1)).alias("revisit"), "url", "ts", "outcome", F.substr("response_id", F.lit(2)).cast("long").alias("response_page"), "status", flat.alias("headers"), F.sha2("body", 256).alias("body_sha256"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(trim(url), '(?s)#.*$', '') AS u FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, coalesce(html, '') AS html, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) AS site, substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1) AS rest FROM p),
c AS (SELECT page_id, html, site || CASE WHEN site <> '' AND NOT starts_with(rest, '/') THEN '/' ELSE '' END || rest AS url, '"' || md5(html) || '"' AS tag FROM q),
k(revisit, later) AS (VALUES ('u', 900000), ('v', 1000000000)),
v AS (SELECT page_id, revisit, url, page_id * 1000000 + later AS ts, tag FROM c, k),
r AS (SELECT page_id AS response_page, url, page_id * 1000000 + 100000 AS ts, tag AS r_tag, html FROM c),
j AS (SELECT v.*, r.response_page, r.r_tag, r.html FROM v ASOF JOIN r ON v.url = r.url AND v.ts > r.ts)
SELECT page_id, revisit, url, ts, CASE WHEN tag = r_tag THEN 'matched' ELSE 'mismatch' END AS outcome, response_page, CASE WHEN tag = r_tag THEN 200 END AS status,
  CASE WHEN tag = r_tag THEN 'content-type=text/html|date=later|etag=' || tag || '|vary=accept' END AS headers, CASE WHEN tag = r_tag THEN sha256(html) END AS body_sha256
FROM j UNION ALL SELECT page_id, 'w', url, page_id * 1000000 + 1000500000, 'other', NULL, NULL, NULL, NULL FROM c
"""
