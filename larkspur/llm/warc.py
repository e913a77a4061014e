"""WARC: resolving not-modified revisits.

``read_warc`` takes a file's bytes apart and ``write_record`` makes one record. ``resolve``
joins every revisit record (a 304 answer) as of its date to the latest earlier full response
for the same canonical URL, checks the validators and merges the headers that a 304 may
update. Bodies never take part in the join, only identifiers and headers.

The as-of join is two-level: rows of a URL fall into spans of time, a span's last full response
is carried into the next spans, and inside a span a window finds the latest one. A URL that
holds a third of all records is so spread over its spans; ``spans`` bounds how many.

Defined results. Records of the same date count as earlier by their record number. A revisit
whose URL or date is null, or that has no earlier response, is 'unresolved'. One whose ETag
or Last-Modified contradicts the response is 'mismatch'; one without any validator in common
is 'unvalidated'; else 'resolved'. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, table

#: Header fields that a 304 answer may update in a stored response (RFC 9110, RFC 9111).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit, not a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")
SPANS = 64


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no www., no default port, no fragment, no tracking parameters, no trailing slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    args = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), rf"(^|&)({'|'.join(TRACKING)})=[^&]*", ""), r"^&", "")
    return F.concat(host, path, F.when(args != "", F.concat(F.lit("?"), args)).otherwise(""))


def resolve(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """A row per revisit.

    records: record_id long, url string, date timestamp_ntz, kind ('response' or 'revisit'),
    headers map<string,string> with lower-case names. The result has record_id, canonical,
    date, response_id, age_s, status and the merged headers.
    """
    seen = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "date", "kind", "headers", F.unix_micros(F.col("date").cast("timestamp")).alias("us"))
    seen = checkpointed(seen.where(F.col("kind").isin("response", "revisit")))
    edges = seen.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    lo, width = edges["lo"] or 0, max(1, ((edges["hi"] or 0) - (edges["lo"] or 0)) // spans + 1)
    known = F.col("canonical").isNotNull() & F.col("us").isNotNull()
    keyed = seen.where(known).withColumn("span", F.floor((F.col("us") - F.lit(lo)) / F.lit(width)).cast("int"))
    full = F.when(F.col("kind") == "response", F.struct("us", F.col("record_id").alias("id"), "headers"))
    last = F.struct("us", F.col("record_id").alias("id"))
    # Carried: for each span of a URL, the last full response of the spans before it.
    ends = keyed.groupBy("canonical", "span").agg(F.max(F.when(F.col("kind") == "response", last)).alias("end"))
    before = W.partitionBy("canonical").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("canonical", "span", F.max("end").over(before).alias("carried"))
    inside = W.partitionBy("canonical", "span").orderBy("us", "record_id").rowsBetween(W.unboundedPreceding, -1)
    found = keyed.withColumn("near", F.last(F.when(F.col("kind") == "response", last), ignorenulls=True).over(inside)).where("kind = 'revisit'")
    found = found.join(carried, ["canonical", "span"], "left").withColumn("response_id", F.coalesce("near.id", "carried.id"))
    lost = seen.where(~known & (F.col("kind") == "revisit")).select("record_id", "canonical", "date", "headers", "us", F.lit(None).cast("long").alias("response_id"))
    found = found.select("record_id", "canonical", "date", "headers", "us", "response_id").unionByName(lost)
    base = seen.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("us").alias("stored_us"))
    out = found.join(base, "response_id", "left")
    # Maps hold a name once; a name that the revisit does not send stays as stored.
    mine, theirs = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("stored", F.create_map().cast("map<string,string>"))
    may = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(may, k)), may)
    both = lambda name: F.map_contains_key(mine, name) & F.map_contains_key(theirs, name)
    value = lambda m, name: F.regexp_replace(F.try_element_at(m, F.lit(name)), r"^W/", "")
    differs = lambda name: both(name) & (value(mine, name) != value(theirs, name))
    status = (
        F.when(F.col("response_id").isNull(), "unresolved")
        .when(differs("etag") | (~both("etag") & differs("last-modified")), "mismatch")
        .when(both("etag") | both("last-modified"), "resolved")
        .otherwise("unvalidated")
    )
    return out.select(
        "record_id", "canonical", "date", "response_id", F.floor((F.col("us") - F.col("stored_us")) / 1_000_000).cast("long").alias("age_s"), status.alias("status"),
        F.when(status.isin("resolved", "unvalidated"), merged).otherwise(mine).alias("headers"),
    )


def write_record(kind: str, fields: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": kind} | fields | {"Content-Length": str(len(body))}).items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n", mtime=0)


def read_warc(data: bytes) -> list[dict]:
    """The records of a file, gzipped by member or plain: kind, fields, http headers (lower-case) and body.

    A header line that starts with a space continues the one before; of a repeated field the
    last counts. A record cut short ends the list.
    """
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    out = []
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return out
        fields = _fields(stream)
        n = int(fields.get("content-length", "0"))
        block = stream.read(n)
        if len(block) < n:
            return out
        http, body = {}, block
        if fields.get("content-type", "").startswith("application/http"):
            part = io.BytesIO(block)
            http = {":status": part.readline().decode("latin-1").strip()} | _fields(part)
            body = part.read()
        out.append({"kind": fields.get("warc-type", ""), "fields": fields, "headers": http, "body": body})


def _fields(stream) -> dict[str, str]:
    out, name = {}, ""
    while (line := stream.readline().decode("utf-8", "replace")).strip("\r\n"):
        if line[0] in " \t" and name:
            out[name] += " " + line.strip()
        elif m := re.match(r"([^:\s]+):\s*(.*)", line.rstrip("\r\n")):
            name = m[1].lower()
            out[name] = m[2]
    return out


RECORD = "record_id long, url string, date timestamp_ntz, kind string, headers map<string,string>, body binary"


def records_of_files(files: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of WARC files given as bytes (Spark's binaryFile source), ready for ``resolve``.

    A file is one task's work, as it is one gzip stream. record_id is a hash of WARC-Record-ID; a
    date that is no ISO date is null; null files give no rows.
    """
    names = ["record_id", "url", "date", "kind", "headers", "body"]
    kinds = [pa.int64(), pa.string(), pa.timestamp("us"), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def rows(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = []
                for k, r in enumerate(read_warc(data or b"")):
                    f = r["fields"]
                    h = xxhash.xxh3_64_intdigest(f.get("warc-record-id", f"{len(data)}#{k}"))
                    try:
                        date = dt.datetime.fromisoformat(f.get("warc-date", "").replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None)
                    except ValueError:
                        date = None
                    found.append((h - (1 << 64) if h >> 63 else h, f.get("warc-target-uri"), date, r["kind"], list(r["headers"].items()), r["body"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return files.select(content_col).mapInArrow(rows, RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records from raw pages: each is fetched once in full and visited again later.

    The first visit of page p is at p seconds after 2024; the second a day later brings a 304.
    Its ETag is the page's own, but changed for every 7th page; every 5th sends none.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    first = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60"))
    again = F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-type"), F.lit("text/plain"))).otherwise(
        F.create_map(F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-type"), F.lit("text/plain"), F.lit("etag"), F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(tag))
    )
    visit = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.to_timestamp_ntz(at).alias("date"), F.lit("response").alias("kind"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.to_timestamp_ntz(at + F.expr("interval 1 day")).alias("date"), F.lit("revisit").alias("kind"), again.alias("headers")),
    )
    return pages.select("url", F.explode(visit).alias("v")).select("url", "v.*")


QUERY = "op6_warc_revisits"

_TRACK = "|".join(TRACKING)
ORACLE = rf"""
WITH p AS (
  SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages
), u AS (
  SELECT page_id, tag,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest FROM p
), v AS (
  SELECT page_id, tag, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS base,
    regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)({_TRACK})=[^&]*', '', 'g'), '^&', '') AS args FROM u
), c AS (SELECT page_id, tag, base || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS canonical FROM v),
full_r AS (SELECT page_id * 2 AS record_id, canonical, tag, 1704067200 + page_id AS s FROM c),
again AS (SELECT page_id, page_id * 2 + 1 AS record_id, canonical, 1704067200 + page_id + 86400 AS s,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE tag END AS sent FROM c),
j AS (
  SELECT a.*, f.record_id AS response_id, f.tag AS stored, f.s AS stored_s,
    row_number() OVER (PARTITION BY a.record_id ORDER BY f.s DESC NULLS LAST, f.record_id DESC) AS k
  FROM again a LEFT JOIN full_r f ON a.canonical = f.canonical AND (f.s < a.s OR (f.s = a.s AND f.record_id < a.record_id))
)
SELECT record_id, canonical, response_id, s - stored_s AS age_s,
  CASE WHEN response_id IS NULL THEN 'unresolved' WHEN sent IS NULL THEN 'unvalidated' WHEN sent <> stored THEN 'mismatch' ELSE 'resolved' END AS status,
  CASE WHEN sent IS NOT NULL THEN sent WHEN response_id IS NULL THEN NULL ELSE stored END AS etag,
  'max-age=3600' AS cache_control,
  CASE WHEN response_id IS NULL OR (sent IS NOT NULL AND sent <> stored) THEN 'text/plain' ELSE 'text/html' END AS content_type
FROM j WHERE k = 1
"""


def op6_warc_revisits(spark, sf_dir):
    found = resolve(page_records(table(spark, sf_dir, "pages")))
    get = lambda name: F.try_element_at("headers", F.lit(name))
    return found.select("record_id", "canonical", "response_id", "age_s", "status", get("etag").alias("etag"), get("cache-control").alias("cache_control"), get("content-type").alias("content_type"))
