"""WARC archives with revisit resolution.

Headers (an id, the payload's digest and size) are shuffled by digest; among records with equal payloads of at least
``least`` bytes the smallest id stays the response, and the others become revisit records that refer to it by id, target
and date.  Only revisit rows of the header table meet the payloads, by id and digest, so the big side is shuffled once.

Archives are written with fresh headers by Spark's text writer, so any Hadoop file system takes them.  Every record is a
gzip member of its own, as readers that seek expect, and the line separator is an empty gzip member, so each part file is
a valid sequence of members.  Rows of the writer are pieces of about ``PIECE`` bytes; a larger record is followed by as
many empty rows as it takes pieces, and each file gets a fixed number of rows.  A file so holds at most ``file_bytes`` and
one record, whatever the sizes of pages, and begins with a warcinfo record.  Files are read back as a stream of records.

Cases: null html counts as an empty payload; payloads under ``least`` bytes are always responses; payloads that hold
record ends or header lines come back unchanged; an empty table gives empty archives and an empty result; rows that
repeat an id with the same payload are alike, with different payloads each is resolved by its own payload; rows without
an id are responses; null urls become an empty target.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "id long, uri string, type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
PIECE = 1 << 20
#: A gzip member of nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)


def resolve(headers: DataFrame, least: int = 100) -> DataFrame:
    """Which records are revisits: ``id, digest, refers_to, refers_uri``.  ``headers``: ``id, digest, size, uri``."""
    long_ = headers.filter((F.col("size") >= least) & F.col("id").isNotNull())
    first = long_.groupBy("digest").agg(F.min(F.struct("id", "uri")).alias("first"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    return long_.select("id", "digest").join(first.select("digest", "first"), "digest").select("id", "digest", F.col("first.id").alias("refers_to"), F.col("first.uri").alias("refers_uri")).filter("id != refers_to")


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + END + block + END) + pack.flush()


def write_archives(records: DataFrame, folder: str, least: int = 100, file_bytes: int = 64 << 20, date: datetime | None = None) -> None:
    """``records``: ``id, uri, payload`` (text).  ``date``: of the headers; now, unless given."""
    named = records.select("id", F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x1f]", "").alias("uri"), F.coalesce("payload", F.lit("")).alias("payload"))
    full = named.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    links = resolve(full.select("id", "digest", "size", "uri"), least).dropDuplicates(["id", "digest"])
    known = full.join(links, ["id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    rows = known.select("id", "uri", "digest", "refers_to", "refers_uri", F.when(~again, F.col("payload").cast("binary")).alias("payload"))
    at = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows_of_file = max(1, file_bytes // PIECE)

    def run(batches):
        number = 0  # of rows written so far

        def row(data: bytes):
            nonlocal number
            # Fills up with empty rows so that rows count pieces, up to the file's end.
            taken = min(-(-len(data) // PIECE), rows_of_file - number % rows_of_file)
            number += max(1, taken)
            return pa.RecordBatch.from_arrays([pa.array([data, *[b""] * (taken - 1)], pa.binary())], ["value"])

        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:record:warcinfo>"), ("WARC-Date", at), ("Content-Type", "application/warc-fields")], b"software: foliolake\r\nformat: WARC File Format 1.1\r\n")
        held = b""
        for b in batches:
            for i in range(b.num_rows):
                id_, uri, digest, refers_to, refers_uri, payload = (c[i].as_py() for c in b.columns)
                fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:record:{'' if id_ is None else id_}>"), ("WARC-Target-URI", uri), ("WARC-Date", at), ("WARC-Payload-Digest", f"sha256:{digest}")]
                block = b""
                if refers_to is None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                else:
                    fields += [("WARC-Refers-To", f"<urn:record:{refers_to}>"), ("WARC-Refers-To-Target-URI", refers_uri), ("WARC-Refers-To-Date", at), ("WARC-Profile", PROFILE)]
                packed = record([*fields, ("Content-Type", "application/http; msgtype=response")], block)
                if held and len(held) + len(packed) > PIECE:
                    yield row(held)
                    held = b""
                held += packed if held or number % rows_of_file else info + packed
        if held:
            yield row(held)

    # Members are bytes, which the writer passes through.
    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", rows_of_file).option("compression", "none").text(folder)


def members(data: bytes, step: int = 1 << 16):
    """The contents of the gzip members of a file, one at a time."""
    at = 0
    while at < len(data):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof and at < len(data):
            part = data[at : at + step]
            out.append(unzip.decompress(part))
            at += len(part) - len(unzip.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = member.index(END)
    lines = member[:end].decode("utf-8", "replace").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, member[end + 4 : end + 4 + int(headers["Content-Length"])]


def _number(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_archives(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Every record: ``id, uri, type, refers_to, payload_digest, payload_bytes, payload``; the last two of a revisit are null."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out, held = {f.name: [] for f in kinds}, 0
                for member in members(batch.column(0)[i].as_py()):
                    headers, block = parse(member) if member else ({}, b"")
                    if headers.get("WARC-Type") not in ("response", "revisit"):
                        continue
                    again = headers["WARC-Type"] == "revisit"
                    payload = None if again else block[block.index(END) + 4 :]
                    # A revisit's digest comes from its header and finds its response; a response's is computed.
                    facts = (headers["WARC-Payload-Digest"].rpartition(":")[2], None) if again else (hashlib.sha256(payload).hexdigest(), len(payload))
                    row = (_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], _number(headers.get("WARC-Refers-To")), *facts, payload if payloads else None)
                    for k, v in zip(out, row):
                        out[k].append(v)
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema=kinds)
                        out, held = {f.name: [] for f in kinds}, 0
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    kinds = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, PARSED)


def rejoin(records: DataFrame) -> DataFrame:
    """Revisit rows with the digest, size and payload of the response that they refer to."""
    facts = ["payload_bytes", "payload"]
    named = records.filter("type = 'response'")
    of = named.select(F.col("id").alias("refers_to"), "payload_digest", *[F.col(c).alias(f"of_{c}") for c in facts]).dropDuplicates(["refers_to", "payload_digest"])
    again = records.filter("type = 'revisit'").drop(*facts).join(of, ["refers_to", "payload_digest"], "left").select("id", "uri", "type", "refers_to", "payload_digest", *[F.col(f"of_{c}").alias(c) for c in facts])
    return named.unionByName(again)


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_archives(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload")), folder)
    return rejoin(read_archives(spark, folder, payloads=False)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> h.page_id THEN f.first_id END AS refers_to
FROM h LEFT JOIN f ON h.payload_digest = f.payload_digest
"""
