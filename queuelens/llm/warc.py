"""WARC archives: writing pages as transactions, reading and assembling them.

`write` makes three records for each page, a request, a response (or a
revisit of an earlier equal payload) and metadata, tied by WARC-Concurrent-To,
and writes them with Spark's text sink, whose line separator is the blank line
pair that ends a WARC record. Files are compressed as wholes, so a reader gets
each of them in one piece.

`read` splits the files at version lines with Spark's text source, and puts
records that hold such a line in their content together again by their
Content-Length. `assemble` joins request, response and metadata records
through their concurrent-to identifiers and gives one nested row per capture.

Results, also for odd input:

* a null html counts as the empty payload; a null url is written as an empty
  target;
* of equal payloads of at least `MIN_REVISIT` bytes those of the smallest
  page_id are responses and the others revisit it; smaller payloads are all
  responses. Null page_ids come after all others;
* repeated rows each make their own capture, with identifiers of its own;
  where they share the smallest page_id, all of them are responses;
* payloads of any length and bytes come back unchanged;
* no page gives an archive without records; columns beside page_id, url and
  html are ignored;
* records without a partner give a capture with nulls for what is missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import small_enough, written

VERSION = "WARC/1.1"
MIN_REVISIT = 100
#: Repeated payloads whose first pages are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Records in an archive file.
FILE_RECORDS = 30_000
_CRLF = "\r\n"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content: Column) -> Column:
    lines = [F.lit(f"{VERSION}{_CRLF}WARC-Type: {kind}{_CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{_CRLF}")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit(_CRLF)]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit(_CRLF + _CRLF), content)


def _urn(kind: str, seed: Column) -> Column:
    h = F.sha2(F.concat(F.lit(kind + ":"), seed), 256)
    return F.concat(F.lit("urn:uuid:"), *[p for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for p in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def captures(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, and the page that they revisit (`first`)."""
    # As the archive writes them, line ends in an address would end its header.
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("long_enough", F.octet_length("payload") >= MIN_REVISIT)
    repeated = base.filter("long_enough").groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    repeated = written(repeated.select(F.col("digest").alias("d"), "first", "first_url"), "warc-repeated")
    if small_enough(repeated, BROADCAST_ROWS):
        repeated = F.broadcast(repeated)
    return base.join(repeated, (base.digest == F.col("d")) & base.long_enough, "left").drop("d", "long_enough")


def write(pages: DataFrame, path: str) -> None:
    """Write the records of all pages (page_id, url, html) as archives below `path`."""
    rows = captures(pages)
    seed = F.concat_ws("/", F.monotonically_increasing_id().cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))
    rows = rows.withColumn("seed", seed).select("*", *[_urn(k, F.col("seed")).alias(k) for k in ("request", "response", "metadata")])
    revisit = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first")) | F.col("page_id").isNull())
    uri, date = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit("2024-01-31T00:00:00Z"))
    with_response = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("response"), F.lit(">")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#\s]*)", 1)
    request = _record("request", F.col("request"), [date, uri, with_response, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF + _CRLF)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(_CRLF + _CRLF))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", F.col("response"), [date, uri, digest, kind], F.concat(http, F.col("payload")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    # The standard names a revisited capture by its address and date; its page's id is our own header.
    refers = [("WARC-Refers-To-Target-URI", F.coalesce("first_url", F.lit(""))), ("WARC-Refers-To-Date", date[1]), ("WARC-Refers-To-Page", F.col("first").cast("string"))]
    again = _record("revisit", F.col("response"), [date, uri, digest, profile, *refers, kind], http)
    fields = F.concat(F.lit("page-id: "), page, F.lit(f"{_CRLF}payload-bytes: "), F.octet_length("payload").cast("string"), F.lit(_CRLF))
    metadata = _record("metadata", F.col("metadata"), [date, uri, with_response, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", _CRLF + _CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parse(raw: bytes, keep: bool) -> tuple | None:
    """A record's row, from what follows its version line; None if cut short."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split(_CRLF):
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    size = int(headers.get("content-length", "0"))
    if len(rest) < size:
        return None
    content = rest[:size]
    kind, fields = headers.get("warc-type"), {}
    if headers.get("content-type", "").startswith("application/http"):
        start, _, content = content.partition(b"\r\n\r\n")
        lines = start.decode("utf-8", "replace").split(_CRLF)
        fields = {"first-line": lines[0]} | {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines[1:]) if c}
    elif headers.get("content-type", "").startswith("application/warc-fields"):
        fields = {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in content.decode("utf-8", "replace").split(_CRLF)) if c}
    # A revisit has its payload's digest in its header; the payload itself is elsewhere.
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None if kind == "revisit" else hashlib.sha256(content).hexdigest()
    bare = lambda x: x.strip("<>") if x else None
    return (bare(headers.get("warc-record-id")), kind, bare(headers.get("warc-concurrent-to")), headers.get("warc-refers-to-page"), headers.get("warc-target-uri"), fields, len(content), digest, content if keep else None)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below `path`, with columns `RECORD`.

    payload_bytes and payload_digest are of the content behind the HTTP head;
    with payloads=False the content itself is left out.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    separator = (VERSION + _CRLF).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = b"", [], 0
        for batch in batches:
            for piece in batch.column("value"):
                raw = piece.as_py()
                held = held + separator + raw if held else raw
                if not held:
                    continue
                row = _parse(held, payloads)
                if row is None:
                    continue
                rows.append(row)
                size += len(held)
                held = b""
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if f.name == "fields" else v for v in c], f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if held:
            raise ValueError("an archive ends within a record")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if f.name == "fields" else v for v in c], f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    lines = spark.read.option("lineSep", separator.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its id, and its response, request and metadata records, nested.

    The capture's id is the identifier that its records are concurrent to.
    """
    key = F.coalesce("concurrent_to", "record_id")
    part = F.struct("record_id", "type", "refers_to", "uri", "fields", "payload_bytes", "payload_digest", "payload")
    keyed = records.withColumn("capture_id", key).withColumn("part", part)
    pick = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), F.col("part")), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return keyed.groupBy("capture_id").agg(pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata"))
