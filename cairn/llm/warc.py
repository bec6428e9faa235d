"""WARC archives: written from pages, read back, and assembled into transactions.

A capture is three records. The response (or, for a payload that another page's response
holds, a revisit) carries the HTTP header and payload; request and metadata name it in
WARC-Concurrent-To. Archives are WARC/1.1 files with a gzip member to each record, closed when
they have grown to a bounded number of bytes, that Spark puts into the shared folder. They are
read a member at a time and cut by Content-Length, so no payload can be taken for a record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.skew import join_unique
from cairn.llm.urls import host_of
from cairn.plans.durable import discard, durable, pick, shared_root

LEAST_REVISIT = 1_000  # bytes of a payload that is stored once
FILE_BYTES = 32 << 20  # of an archive, but for its last record
BATCH_BYTES = 16 << 20  # of bodies that are handed on at a time
DATE = "2024-01-01T00:00:00Z"


def _urn(*parts) -> Column:
    """A record's id, the same whenever it is written: 32 hex digits as a UUID of version 8."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("8"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12)))


def _record(kind: str | Column, record_id: Column, uri: Column, content_type: str, body: Column, *more: tuple[str, Column]) -> Column:
    """One record as text, with the two line ends that close it; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    lines = [line("WARC-Type", kind), line("WARC-Record-ID", angle(record_id)), F.lit(f"WARC-Date: {DATE}"), line("WARC-Target-URI", uri), *[line(n, v) for n, v in more]]
    lines += [F.lit(f"Content-Type: {content_type}"), line("Content-Length", F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _uri(url: Column) -> Column:
    """A URL that stands on one line: control characters and space as %XX, null as none."""
    url = F.coalesce(url.cast("string"), F.lit("about:blank"))
    out = url
    for c in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike("[\\x00-\\x20\\x7F]"), out).otherwise(url)


def member(record: bytes) -> bytes:
    """A record as a gzip member that ends with a zero byte.

    A member's last byte is that of its size's highest eight bits, zero below 16 MiB; a larger
    record is followed by a member of nothing.
    """
    out = b""
    for part in (record,) if len(record) & 0xFFFFFFFF < 1 << 24 else (record, b""):
        squeeze = zlib.compressobj(6, wbits=31)
        out += squeeze.compress(part) + squeeze.flush()
    return out


def _archives(batches):
    """Records (binary) as archives, one row each, closed at FILE_BYTES.

    The writer ends a row with a separator of one zero byte, which is the archive's last.
    """

    def row():
        data = b"".join(held)[:-1]
        held.clear()
        ends = pa.py_buffer(np.array([0, len(data)], np.int64))
        # Bytes as they are, under the one type that Spark writes to files without a format.
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, ends, pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([text], names=["value"])

    held, size = [], 0
    for batch in batches:
        for record in batch.column(0).to_pylist():
            held.append(member(record))
            size += len(held[-1])
            if size >= FILE_BYTES:
                yield row()
                size = 0
    if held:
        yield row()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a capture of every page under ``path``: request, response or revisit, metadata.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the largest id is
    the response and the others revisit it; rows that repeat that id are responses too.
    Null payloads are empty, null URLs are about:blank, a null id is never the largest (of
    null ids alone all are responses). Payloads are kept byte for byte.
    """
    p = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    html = F.coalesce(F.col("_html").cast("string"), F.lit(""))
    p = p.select("_id", _uri(F.col("_url")).alias("uri"), F.col("_url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    digests = p.select("_id", "digest", "bytes").filter(F.col("bytes") >= LEAST_REVISIT)
    largest = digests.groupBy("digest").agg(F.max("_id").alias("largest"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and largest is not null")
    # Written first, so that its size is known: payloads are shuffled only if it is large, and
    # those that many pages have not even then.
    largest = durable(largest, "largest")
    copies = int(largest.agg(F.sum("copies")).first()[0] or 0)
    counts = largest.select("digest", F.col("copies").alias("__n"))
    some = join_unique(p.filter(F.col("bytes") >= LEAST_REVISIT), largest.drop("copies"), "digest", copies, counts=counts, nulls=False)
    few = p.filter(F.col("bytes") < LEAST_REVISIT).withColumn("largest", F.lit(None).cast(p.schema["_id"].dataType))
    p = some.unionByName(few)
    p = p.withColumn("revisit", F.col("largest").isNotNull() & (F.col("_id").isNull() | (F.col("_id") < F.col("largest"))))
    # Ids of what is kept once come from the payload, so that a revisit can name its response.
    stored = lambda page_id: _urn(F.lit("response"), page_id.cast("string"), "digest")
    own = _urn(F.lit("capture"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("uri"), "digest")
    p = p.withColumn("rid", F.when(F.col("revisit") | F.col("_id").isNull(), own).otherwise(stored(F.col("_id"))))
    size = F.col("bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    sha = F.concat(F.lit("sha1:"), F.col("digest"))
    host = host_of(F.col("uri"))
    rest = F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    note = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("_id").cast("string"), F.lit("\r\n")), F.concat(F.lit("page-url: "), F.to_json(F.struct("url")), F.lit("\r\n")))
    angle = F.concat(F.lit("<"), F.col("rid"), F.lit(">"))
    no = F.lit(None).cast("string")
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(F.col("revisit"), F.concat(F.lit("<"), stored(F.col("largest")), F.lit(">")))
    main = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("rid"), F.col("uri"), "application/http; msgtype=response", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))), ("WARC-Payload-Digest", sha), ("WARC-Profile", profile), ("WARC-Refers-To", refers))
    request = _record("request", _urn(F.lit("request"), "rid"), F.col("uri"), "application/http; msgtype=request", rest, ("WARC-Concurrent-To", angle), ("WARC-IP-Address", no))
    metadata = _record("metadata", _urn(F.lit("metadata"), "rid"), F.col("uri"), "application/warc-fields", note, ("WARC-Concurrent-To", angle))
    records = p.select(F.explode(F.array(request, main, metadata)).alias("value")).select(F.col("value").cast("binary"))
    records.mapInArrow(_archives, "value string").write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    discard(largest)


class BadArchive(ValueError):
    """An archive that isn't whole."""


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a file of gzip members, a piece at a time."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(data):
                raise BadArchive("the last member is cut short")
            try:
                yield member.decompress(data[at : at + step])
            except zlib.error as e:
                raise BadArchive(f"member before byte {at}: {e}") from e
            at += min(step, len(data) - at)
        at -= len(member.unused_data)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and body of each record of a stream; one is held at a time."""
    held, pieces, done = bytearray(), iter(pieces), 0

    def fill(upto: int) -> bool:
        while len(held) < upto:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if end < 0 and not fill(seen + 1):
                break
        if end < 0 or not held.startswith(b"WARC/1."):
            raise BadArchive(f"no record header after {done} records")
        headers = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise BadArchive(f"record {done} does not end where its length says")
        yield headers, bytes(held[start:stop])
        del held[: stop + 4]
        done += 1


RECORDS = "record_id string, kind string, concurrent_to string, uri string, date string, refers_to_id string, http_header string, payload binary, payload_bytes long, payload_digest string, stated_digest string"


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``; digests are of the bytes that were read.

    A revisit's payload isn't there: its length is its HTTP header's, its digest the stated
    one. Without ``payloads`` they are counted and hashed but not handed on.
    """

    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def table(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, body in parse_records(inflate(data or b"")):
                    kind, strip = h["warc-type"], lambda x: x.strip("<>") if x else None
                    head, payload, n, digest = None, None, None, None
                    if kind in ("response", "revisit", "request"):
                        top, _, payload = body.partition(b"\r\n\r\n")
                        head, n, digest = top.decode("utf-8", "replace"), len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        payload = body
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "revisit":
                        lengths = [x.partition(":")[2] for x in head.split("\r\n") if x.lower().startswith("content-length:")]
                        n, digest, payload = int(lengths[0]), stated, None
                    keep = payload if payloads or kind == "metadata" else None
                    rows.append((strip(h["warc-record-id"]), kind, strip(h.get("warc-concurrent-to")), h.get("warc-target-uri"), h.get("warc-date"), strip(h.get("warc-refers-to")), head, keep, n, digest, stated))
                    size += len(keep or b"") + 500
                    if size >= BATCH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, refers_to.

    ``response`` is a response or revisit; request and metadata are those that are concurrent
    to it, null where there is none; ``refers_to`` is the record that a revisit names. Of
    several requests or metadata records of one capture that with the least id is taken, and a
    response or revisit that repeats gives a row each time.
    """
    mains = records.filter("kind in ('response', 'revisit')")
    fields = F.struct("record_id", "kind", "uri", "date", "refers_to_id", "http_header", "payload", "payload_bytes", "payload_digest", "stated_digest")
    mains = mains.select(F.col("record_id").alias("capture_id"), fields.alias("response"))

    def beside(kind: str) -> DataFrame:
        of = records.filter((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        return of.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "uri", "date", "http_header", "payload")).alias(kind))

    return mains.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = True) -> DataFrame:
    """Write archives of ``pages`` into the shared folder and assemble what they hold.

    Columns: page_id (as the metadata states it, a long), payload_bytes, payload_digest,
    record_type, refers_to (the page_id of the response), capture (the nested row). An empty
    table writes no record and gives none. Other columns of ``pages`` don't matter.
    """
    spark = pages.sparkSession
    path = f"{shared_root(spark)}/cairn-tables/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col)
    records = read_records(spark, path, payloads)
    if not payloads:  # small then: the archives are parsed once, not for each kind of record
        records = durable(records, "records")
    captures = assemble(records)
    note = F.col("metadata.payload").cast("string")
    page = F.regexp_extract(note, r"(?:^|\n)page-id: (-?\d+)", 1)
    captures = captures.withColumn("page_id", F.when(page != "", page.cast("long")))
    # Only revisits look for the page that they refer to; a popular response stays one row.
    named = captures.filter("response.kind = 'response'").groupBy(F.col("capture_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    again = captures.filter("response.kind = 'revisit'").withColumn("refers_to_id", F.col("response.refers_to_id"))
    counts = records.filter("kind = 'revisit'").groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("__n"))
    again = join_unique(again, named, "refers_to_id", records.filter("kind = 'revisit'").count(), counts=counts)
    columns = ["page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type")]
    capture = F.struct("capture_id", "response", "request", "metadata").alias("capture")
    first = captures.filter("response.kind = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"), capture)
    return first.union(again.select(*columns, "refers_to", capture))


def op5_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """What the archives hold of every page."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False).drop("capture")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d"""
