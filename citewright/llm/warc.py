"""WARC writing and reading.

Writing: one response record for each page, an HTTP message in chunked transfer framing; a payload of at least REVISIT_BYTES that
a page with a larger id has too becomes a revisit record that refers to that page. Records longer than SEGMENT bytes are cut into
a first segment and continuation records. Spark's text writer puts the records into gzip files, with the two line ends that close a record
as its line separator; the files go to the folder that all machines share.

Reading: an archive (RECORDS records at most, none longer than a segment and its header) is decompressed and parsed as a stream, once; whole records are decoded on the spot.
Segments are grouped by the identifier of their origin record and ordered by number, their total length is checked against the last
segment's, and the body is freed of its chunk framing. Digests and lengths are those of decoded payloads; a revisit's are taken from the response that it refers to, which must have
the digest that the revisit names.

Defined cases: null html is an empty payload; a null url is `urn:page:<id>` in the archive; line ends in urls are percent-encoded; repeated rows
are records of their own, and of rows that share the largest page id all are responses; of pages without id all are responses unless
a page with an id has the payload; very long payloads become many segments and are put together in one pass; extra columns never enter; an empty table gives an archive without records. A broken record
(wrong length, missing segment, bad chunk, revisit without response) stops the read with an error that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import cut, read, remove, shared_dir, small_batches

REVISIT_BYTES, SEGMENT, CHUNK, BROADCAST_ROWS, RECORDS = 1000, 65_536, 16_384, 100_000, 2000
END = "\r\n\r\n"


# ---- records ---------------------------------------------------------------------------------------------------------


def pieces(data: bytes, size: int) -> list[bytes]:
    """Cut UTF-8 into parts of at most `size` bytes, never inside a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces(payload, CHUNK)) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends early")
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[line + 2 : line + 2 + n]
        if len(part) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("chunk of wrong length")
        out.append(part)
        at = line + 4 + n


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the line ends that close it."""
    head = "WARC/1.1\r\nWARC-Type: " + kind + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def records(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, unique: str) -> list[bytes]:
    """The records of one page."""
    target = (url if url is not None else f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{unique} {page} {digest}").urn
    head = [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload)))]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers)), ("Content-Type", "application/http; msgtype=response")]
        return [record("revisit", head + more, status + b"\r\n")]
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= SEGMENT:
        return [record("response", head, block)]
    parts = pieces(block, SEGMENT)
    out = [record("response", [*head, ("WARC-Segment-Number", "1")], parts[0])]
    for i, p in enumerate(parts[1:], 2):
        more = [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {i}').urn}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(i))]
        more += [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        out.append(record("continuation", more, p))
    return out


def parse(data: bytes | BinaryIO):
    """(type, headers in lower case, block) of every record of an uncompressed archive, read as a stream."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while True:
        line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record header at byte {at}")
        head, size = {}, len(line)
        while line := source.readline():
            size += len(line)
            if line == b"\r\n":
                break
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        n = int(head["content-length"])
        block = source.read(n)
        if len(block) != n or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} has another length than it says")
        yield head["warc-type"], head, block
        at += size + n + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunk(body) if lines.get(b"transfer-encoding") == b"chunked" else body


# ---- tables ----------------------------------------------------------------------------------------------------------


def write(pages: DataFrame, path: str) -> None:
    """Write page_id, url, html to gzip archives under path."""
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("page"), "url", html.alias("body"), F.sha1(html).alias("digest"))
    # only ids, digests and lengths meet to find equal payloads
    long = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    shared = cut(long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 and first is not null").select("digest", "first"))
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    refers = F.when(F.col("page").isNull() | (F.col("page") != F.col("first")), F.col("first"))
    rows = rows.select("page", "url", "body", "digest", F.when(F.octet_length("body") >= REVISIT_BYTES, refers).alias("refers"))

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page, url, body, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                out += records(page, url, body, digest, refers_to, f"{part} {seen}")
                seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


COLUMNS = ["kind", "page", "url", "digest", "length", "refers"]
SEGMENTS = "id string, number int, total long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", block binary"
DECODED = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
names_of = lambda schema: [c.split()[0] for c in schema.split(", ")]
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], ARROW[c.split()[1]]) for i, c in enumerate(schema.split(", "))]


def decode(kind: str, page: str, url: str, digest: str, length: str, refers: str, block: bytes, texts: bool) -> tuple:
    """A row of DECODED. Length and digest are of the payload; a revisit has none, so they are what it names."""
    body = payload_of(block) if kind == "response" else None
    size, sha = (int(length), digest) if body is None else (len(body), hashlib.sha1(body).hexdigest())
    return int(page) if page else None, url, kind, int(refers) if refers else None, size, sha, body if texts else None


def load(spark: SparkSession, path: str, texts: bool = False) -> DataFrame:
    """The archives under path, read once: columns of DECODED for whole records (id is null) and of SEGMENTS, prefixed by s_, for segments."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                done, parts, size = [], [], 0
                for kind, h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    row = kind, h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("x-payload-length"), h.get("x-refers-to-page"), block
                    if number is None:
                        done.append(decode(*row, texts))
                    else:
                        parts.append((h.get("warc-segment-origin-id") or h["warc-record-id"], int(number), None if total is None else int(total), *row))
                    size += len(block)
                    if size > 4 << 20:
                        yield both(done, parts)
                        done, parts, size = [], [], 0
                yield both(done, parts)

    def both(done, parts):
        n, m = len(names_of(DECODED)), len(names_of(SEGMENTS))
        cols = batch_of(done + [(None,) * n] * len(parts), DECODED) + batch_of([(None,) * m] * len(done) + parts, SEGMENTS)
        return pa.RecordBatch.from_arrays(cols, names=names_of(DECODED) + [f"s_{c}" for c in names_of(SEGMENTS)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, DECODED + ", " + ", ".join(f"s_{c}" for c in SEGMENTS.split(", ")))


def reassemble(parts: DataFrame, texts: bool = False) -> DataFrame:
    """Rows of SEGMENTS to rows of DECODED: no group is larger than one record was."""
    groups = parts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in COLUMNS],
    )

    def run(batches):
        for b in batches:
            rows = []
            for own, total, s, *head in zip(*(c.to_pylist() for c in b.columns)):
                whole = b"".join([x["block"] for x in s])
                if [x["number"] for x in s] != list(range(1, len(s) + 1)) or len(whole) != total:
                    raise ValueError(f"segments of record {own} are not complete")
                rows.append(decode(*head, whole, texts))
            yield pa.RecordBatch.from_arrays(batch_of(rows, DECODED), names=names_of(DECODED))

    return groups.select("id", "total", "s", *COLUMNS).mapInArrow(run, DECODED)


def read_archives(spark: SparkSession, path: str, *, texts: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and with texts the payload of responses) of every page in the archives under path."""
    small_batches(spark, rows=500)
    found = cut(load(spark, path, texts))
    parts = found.filter("s_id is not null").select(*[F.col(f"s_{c}").alias(c) for c in names_of(SEGMENTS)])
    got = resolve(found.filter("s_id is null").select(*names_of(DECODED)).unionByName(reassemble(parts, texts)))
    return got if texts else got.drop("payload")


def resolve(decoded: DataFrame) -> DataFrame:
    """decoded, with digests and lengths of revisits taken from the responses that they refer to."""
    revisits = decoded.filter("record_type = 'revisit'")
    asked = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    origins = decoded.filter("record_type = 'response'").join(asked, ["page_id", "payload_digest"], "left_semi").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("bytes")).distinct()
    origins = cut(origins)
    few = origins.count() <= BROADCAST_ROWS
    met = revisits.join(F.broadcast(origins) if few else origins, ["refers_to", "payload_digest"], "left")
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    met = met.withColumn("payload_bytes", F.coalesce("bytes", missing))
    return decoded.filter("record_type != 'revisit'").unionByName(met.select(*decoded.columns))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages, read the archives back."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    got = read_archives(spark, path)  # what it read is materialised
    remove(spark, path)
    small_batches(spark, rows=500)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
