"""WARC archives: writing pages as transactions, reading them back, assembling captures.

A page becomes three records: the request, the response (or a revisit, when an earlier page had the
same payload of at least 100 bytes) and metadata. Request and metadata name the response in
WARC-Concurrent-To. Writing is a plain text sink: a record is one row, and the line separator is the
empty line that ends a record. Files are gzip streams with a bounded number of records.

Reading parses each file as a stream by Content-Length, so payloads may contain anything.
Assembly joins the three kinds through the concurrent-to identifiers into one nested row per capture.

Defined results: a null payload is empty; a null page id is written as none and sorts behind all
others when the first of equal payloads is chosen; of equal payloads of at least 100 bytes exactly one row is the
response, that of the smallest page id and among its rows that of the smallest URL digest, and all others revisit it; rows that
repeat page id, URL and payload are one capture, or with ``every_row`` a capture each, told apart by a stored row number
in the identifiers of all but the first; line breaks, blanks and control characters of a URL are percent-encoded, a null URL is left out;
an empty table gives an archive without records and no captures; columns are selected by name.
"""

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.storage import shared_path, stored
from wakeline.llm.words import in_batches
from wakeline.session import small_side

REVISIT_BYTES = 100
RECORDS_PER_FILE = 6_000
DUPLICATE_GROUPS = 200_000
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, record_id string, type string, target_uri string, concurrent_to string, refers_to string, "
    "payload_bytes long, payload_digest string, page_id long, payload binary"
)


def record_id(kind: str, page_id: Column, url_digest: Column, payload_digest: Column, copy: Column | None = None) -> Column:
    """``copy`` is the number of a repeated row, null in all others."""
    parts = [F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), url_digest, payload_digest]
    key = F.md5(F.concat_ws("|", *parts, *([] if copy is None else [copy.cast("string")])))  # nulls are left out
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(key, a, n) for a, n in cuts)), F.lit(">"))


def _with_copies(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``: a row number for all but the first of equal page id, URL and payload."""
    key = ["page", "url_digest", "digest"]
    plain = rows.withColumn("copy", F.lit(None).cast("long"))
    repeated = small_side(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), DUPLICATE_GROUPS)
    if repeated.isEmpty():
        return plain
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    again = rows.alias("r").join(repeated.alias("k"), same, "left_semi")
    # Stored before anything depends on the numbers.
    again = stored(again.withColumn("copy", F.monotonically_increasing_id()), "copies")
    leads = small_side(again.groupBy(*key).agg(F.min("copy").alias("lead")), DUPLICATE_GROUPS)
    numbered = again.alias("r").join(leads.alias("k"), same).select("r.*", "k.lead")
    numbered = numbered.withColumn("copy", F.when(F.col("copy") != F.col("lead"), F.col("copy"))).drop("lead")
    return plain.alias("r").join(repeated.alias("k"), same, "left_anti").unionByName(numbered)


def records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", every_row: bool = False
) -> DataFrame:
    """One row per record, its bytes as text without the final empty line."""
    raw = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), raw.alias("payload"),
        F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("digest"),
        F.sha2(F.coalesce(F.col(url), F.lit("")), 256).alias("url_digest"),
    )
    rows = _with_copies(rows) if every_row else rows.withColumn("copy", F.lit(None).cast("long"))
    # Of rows that share page id, URL and payload the one without a copy number comes first.
    who = F.struct(F.col("page").isNull().alias("last"), F.col("page"), F.col("url_digest"), F.coalesce("copy", F.lit(-1)).alias("copy"))
    first = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(who).alias("first"), F.max(who).alias("other"))
    first = small_side(first.where("first <> other").drop("other"), DUPLICATE_GROUPS)
    rows = rows.join(first, "digest", "left")
    revisit = F.coalesce(~F.col("first").eqNullSafe(who) & F.col("first").isNotNull(), F.lit(False))
    own = record_id("response", F.col("page"), F.col("url_digest"), F.col("digest"), F.col("copy"))
    earlier = record_id("response", F.col("first.page"), F.col("first.url_digest"), F.col("digest"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    host = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)

    def record(kind: Column, identity: Column, content: str, block: Column, *more: Column) -> Column:
        lines = [
            F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), identity),
            F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), target), *more, F.lit(f"Content-Type: {content}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
        return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)

    with_ = F.concat(F.lit("WARC-Concurrent-To: "), own)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    request = record(
        F.lit("request"), record_id("request", F.col("page"), F.col("url_digest"), F.col("digest"), F.col("copy")), "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(F.coalesce(path, F.lit("/"))), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")), with_,
    )
    response = record(
        F.when(revisit, "revisit").otherwise("response"), own, "application/http; msgtype=response",
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), earlier)),
    )
    metadata = record(
        F.lit("metadata"), record_id("metadata", F.col("page"), F.col("url_digest"), F.col("digest"), F.col("copy")), "application/warc-fields",
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.col("size").cast("string"), F.lit("\r\n")), with_,
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Write the pages' records below ``path``."""
    out = records(pages, **options).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; ``payloads`` keeps the responses' bodies."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORD.split(", "))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for row in parsed(content.as_buffer()):
                    size += len(row["payload"] or b"") + 500
                    rows.append(row | {"file": path, "payload": row["payload"] if payloads else None})
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return in_batches(files, run, RECORD)


class _Inflated(io.RawIOBase):
    """A gzip stream of any number of members, inflated piece by piece."""

    def __init__(self, data):
        self.data, self.at, self.rest = memoryview(data), 0, b""
        self.inflater = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.inflater.eof:
                self.rest = self.inflater.unused_data
                if not self.rest and self.at >= len(self.data):
                    return 0
                self.inflater = zlib.decompressobj(31)
            piece = self.inflater.unconsumed_tail or self.rest
            self.rest = b""
            if not piece:
                if self.at >= len(self.data):
                    return 0
                piece = bytes(self.data[self.at : self.at + (1 << 16)])
                self.at += len(piece)
            out = self.inflater.decompress(piece, len(target))
            if out:
                target[: len(out)] = out
                return len(out)


def headers(stream) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case."""
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def parsed(data) -> Iterator[dict]:
    """The records of one archive, gzip or plain."""
    raw = bytes(memoryview(data)[:2])
    stream = io.BufferedReader(_Inflated(data), 1 << 18) if raw == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:60]!r}")
        fields = headers(stream)
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{fields.get('warc-record-id')}: cut off")
        kind = fields["warc-type"]
        row = {
            "record_id": fields["warc-record-id"], "type": kind, "target_uri": fields.get("warc-target-uri"),
            "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
            "payload_bytes": None, "payload_digest": None, "page_id": None, "payload": None,
        }
        if kind in ("response", "revisit"):
            inner = io.BytesIO(block)
            inner.readline()
            http = headers(inner)
            payload = inner.read()
            if kind == "response":
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            else:
                row |= {"payload_bytes": int(http.get("content-length", 0)), "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2]}
        elif kind == "metadata":
            own = headers(io.BytesIO(block))
            row["page_id"] = int(own["page-id"]) if own.get("page-id") else None
        yield row


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, page_id, response, request, metadata.

    A record written twice counts once. Request and metadata are null where the archives hold none.
    """
    def kind(*types: str) -> DataFrame:
        return records.where(F.col("type").isin(*types))

    responses = kind("response", "revisit").dropDuplicates(["record_id"]).select(
        "record_id", "target_uri",
        F.struct("type", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"),
    )
    request = kind("request").dropDuplicates(["concurrent_to"]).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), F.col("target_uri").alias("target_uri")).alias("request"),
    )
    metadata = kind("metadata").dropDuplicates(["concurrent_to"]).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "page_id").alias("metadata"),
    )
    joined = responses.join(request, "record_id", "left").join(metadata, "record_id", "left")
    return joined.select("record_id", "target_uri", F.col("metadata.page_id").alias("page_id"), "response", "request", "metadata")


def round_trip(pages: DataFrame, payloads: bool = False, every_row: bool = False) -> DataFrame:
    """Write the pages, read the archives back and assemble captures, revisits with their response's page.

    With ``every_row``, wholly repeated rows are captures of their own.
    """
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, every_row=every_row)
    found = stored(captures(stored(read(pages.sparkSession, path, payloads), "records")), "captures")
    originals = found.where("response.type = 'response'").select(F.col("record_id").alias("original"), F.col("page_id").alias("refers_to"))
    revisits = found.where("response.type = 'revisit'").join(originals, F.col("response.refers_to") == F.col("original"), "left").drop("original")
    return found.where("response.type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
