"""WARC archives: writer with revisit records, and a splittable reader (op 10).

Writing: equal payloads (by SHA-1) share one response record, the one with the largest page_id;
the others are revisits that name it.  Every task streams its records, one gzip member each, to
an archive of its own in the shared folder.  The written manifest lists the archives of the
attempts that succeeded, so a retried task leaves no record twice.

Reading: archives are cut into byte ranges.  A task scans its range for the gzip magic,
validates each candidate by decoding the start of the member as a WARC header, and owns the
records that start inside its range, reading past the end of the range where the last one does.

Defined results: null html is an empty payload; a null page_id stays null (it is a response
where its payload has no row with an id, else a revisit); rows that repeat the largest
page_id are all responses; an empty table gives no archive and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, materialise, rows_of, shared_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
ARCHIVE_BYTES = 512 << 20
BLOCK_BYTES = 1 << 18
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
           response: bool, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP header block only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if response:
        block += payload or b""
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", _name(page_id)),
              ("WARC-Target-URI", re.sub(r"[\x00-\x20]+", "%20", url or "about:blank")),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if not response:
        fields[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; returns the manifest.

    The manifest (path, bytes, records) is written before it is returned.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    # Payloads are dealt by page, not by digest: one that many pages share is no hot key.  What is dealt
    # by digest are ids, a few bytes a page.
    named = rows.withColumn("sha1", F.sha1("payload"))
    ids = named.select("page_id", "sha1").distinct()
    winners = ids.groupBy("sha1").agg(F.max("page_id").alias("winner"))
    verdicts = ids.join(winners, "sha1").select(F.col("page_id").alias("id"), F.col("sha1").alias("digest"), "winner")
    told = (named.join(verdicts, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("digest")))
            .withColumn("response", F.col("page_id").eqNullSafe(F.col("winner")))
            .select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("size"),
                    F.when(F.col("response"), F.col("payload")).alias("payload"), "response", "winner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, size, count, name = None, 0, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for page_id, url, sha1, length, payload, response, winner in rows_of(
                batches, "page_id", "url", "sha1", "size", "payload", "response", "winner"):
            if out is None:
                name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            member = record(page_id, url, payload, length, digest, response, winner)
            out.write(member)
            size, count = size + len(member), count + 1
            if size >= ARCHIVE_BYTES:
                yield closed()
                out = None
        if out is not None:
            yield closed()

    return materialise(told.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Member:
    """A gzip member read from ``at`` on; bytes come from ``read(offset, size)``."""

    def __init__(self, read, at: int):
        self.read, self.at, self.unpack = read, at, zlib.decompressobj(31)

    def header_ok(self) -> bool:
        """Whether what starts here decodes as a WARC header."""
        try:
            return self.unpack.decompress(self.read(self.at, 512), 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def content(self) -> tuple[bytes, int]:
        """The decoded member and the offset behind it."""
        unpack, parts, at = zlib.decompressobj(31), [], self.at
        while not unpack.eof:
            block = self.read(at, BLOCK_BYTES)
            if not block:
                raise ValueError(f"the member at {self.at} is cut off")
            parts.append(unpack.decompress(block))
            at += len(block)
        return b"".join(parts), at - len(unpack.unused_data)


def records_in(read, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Decoded records whose member starts in [start, stop) of an archive of ``size`` bytes."""
    at = start
    while at < stop:
        block = read(at, min(BLOCK_BYTES, stop - at + len(MAGIC) - 1))
        hit = block.find(MAGIC)
        if hit < 0:
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= stop:
            return
        member = Member(read, at)
        if member.header_ok():
            content, at = member.content()
            yield content
        else:
            at += 1


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields, HTTP header, payload) of a decoded record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read(spark: SparkSession, manifest: DataFrame, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the manifest's archives; a response's digest is checked against its payload."""
    ranges = (manifest.where("bytes > 0")
              .select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / split))).alias("n"))
              .select("path", "bytes", (F.col("n") * split).alias("start"),
                      F.least(F.col("bytes"), (F.col("n") + 1) * split).alias("stop")))
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, size, start, stop in rows_of(batches, "path", "bytes", "start", "stop"):
            store, place = filesystem(path)
            rows, held = [], 0
            with store.open_input_file(place) as archive:
                for content in records_in(lambda at, n: archive.read_at(min(n, max(0, size - at)), at) if at < size else b"",
                                          size, start, stop):
                    rows.append(_row(content, payloads))
                    held += len(content)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return ranges.repartition(wide, "path", "start").mapInArrow(run, schema)


def _row(content: bytes, payloads: bool) -> dict:
    fields, http, payload = parse(content)
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if response and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": None if response else _page(fields["WARC-Refers-To"]),
            "payload": payload if payloads and response else None}


def round_trip(pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Write archives to the shared folder and read every record's identity back."""
    spark = pages.sparkSession
    manifest = write(pages, shared_folder(spark, "warc"))
    return read(spark, manifest, split, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of ``round_trip`` over ``pages``: base 32 takes four characters of each five hex digits.
ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS s,
             max(page_id) OVER (PARTITION BY sha1(body)) AS winner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
         CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM h
"""
