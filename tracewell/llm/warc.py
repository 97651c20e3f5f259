"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` turns pages into archives (a table ``archive_id, n_records, archive``),
``read_archives`` decodes them again: it loads the dictionary from the leading skippable
frame, decodes one frame per record and validates headers, lengths and digests.

Cases: a null payload is empty; a null URL is written as ``urn:page:<id>``; a row without a page_id is a record as
well, its id made from URL and digest (page_id is null on reading); payloads under
``min_dedup_bytes`` are never revisits; a corrupt or truncated archive gives its good records and a row with an ``error``; rows that repeat the smallest id of equal payloads are
responses too; payloads of any length are one record; an empty table gives no archives. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, table

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, error string"
)


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 64))}>"


def page_of(rid: str) -> int | None:
    """The page of a record id; None if that was made from URL and digest."""
    n = uuid.UUID(rid.strip("<>")).int
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def build_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; a revisit where first is another page's id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    own = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {digest}')}>"
    uri = "".join(uri.split()) if uri and uri.strip() else f"urn:page:{page_id}" if page_id is not None else own.strip("<>")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary in it is itself compressed."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its frame and block headers."""
    if bytes(data[at : at + 4]) != FRAME:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if at + 3 > len(data) or kind == 3:
            raise ValueError(f"bad block at byte {at}")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def parse_record(raw: bytes) -> dict:
    """Headers, lengths and digests of one record, validated; raises ValueError."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise ValueError(f"no {key}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length}, {len(rest)} bytes follow")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP message")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    out = {"page_id": page_of(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": None, "payload": payload, "payload_bytes": declared, "payload_digest": digest, "error": None}
    if out["record_type"] == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
            raise ValueError("bad revisit")
        out |= {"refers_to": page_of(fields["warc-refers-to"]), "payload": None}
    elif out["record_type"] == "response":
        if declared != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    else:
        raise ValueError(f"unknown type {out['record_type']}")
    return out


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive; a record that fails validation has only ``error``, and so has what follows a broken frame, once."""
    failed = dict.fromkeys(("page_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"))
    try:
        yield from _records(data, failed)
    except (ValueError, IndexError, struct.error, zstandard.ZstdError) as e:
        yield failed | {"error": f"broken archive: {e}"}


def _records(data: bytes, failed: dict) -> Iterator[dict]:
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("truncated dictionary frame")
        body = bytes(view[8 : 8 + size])
        if body[:4] == FRAME:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        end = frame_end(view, at)
        try:
            yield parse_record(reader.decompress(view[at:end], max_output_size=0))
        except (ValueError, zstandard.ZstdError) as e:
            yield failed | {"error": str(e)}
        at = end


def train_dictionary(pages: DataFrame, html: str, size: int = 32 << 10, sample: int = 256) -> bytes:
    """A dictionary from at most ``sample`` distinct pages (the smallest hashes), 16 KiB of each; b"" if too few.

    The hashes are ranked alone; only the chosen pages' texts reach the driver.
    """
    hashed = pages.where(F.length(html) > 0).withColumn("_h", F.xxhash64(html))
    last = [r._h for r in hashed.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    if not last:
        return b""
    rows = hashed.where(F.col("_h").isin(last)).groupBy("_h").agg(F.first(F.substring(html, 1, 16384)).alias("t")).orderBy("_h").collect()
    try:
        return zstandard.train_dictionary(size, [r.t.encode("utf-8", "replace") for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_dedup_bytes: int = 100, archive_bytes: int = 8 << 20, salts: int = 16) -> DataFrame:
    """Archives of about ``archive_bytes`` of payload each, one record per row of pages.

    Equal payloads are found by their SHA-256: the smallest id of each is aggregated before any
    shuffle of rows, and only digests that occur twice are joined back, salted, since one payload may
    be a third of all rows.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(body, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= min_dedup_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("digest").alias("d2"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("page_id", F.monotonically_increasing_id())), F.lit(salts)).cast("int"))
    rows = rows.join(firsts, (F.col("digest") == F.col("d2")) & (F.col("salt") == F.col("salt2")), "left").select("page_id", "url", "payload", "digest", "first")
    trained = train_dictionary(pages, html)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(trained) if trained else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        lead = dictionary_frame(trained) if trained else b""
        parts, n, size = [lead], 0, 0

        def flush() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.record_batch({"archive_id": pa.array([hashlib.sha256(data).hexdigest()[:32]]), "n_records": pa.array([n], pa.int64()), "archive": pa.array([data], pa.large_binary()).cast(pa.binary())})

        for batch in batches:
            for pid, uri, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(writer.compress(build_record(pid, uri, payload, digest, first)))
                n, size = n + 1, size + len(payload)
                if size >= archive_bytes:
                    yield flush()
                    parts, n, size = [lead], 0, 0
        if n:
            yield flush()

    return rows.mapInArrow(build, "archive_id string, n_records long, archive binary")


def read_archives(archives: DataFrame, archive: str = "archive", payloads: bool = True) -> DataFrame:
    """The records of a table of archives, schema ``RECORD_SCHEMA``; without payloads that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True))

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch({k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in read_archive(data.as_py() or b""):
                    size += len(r["payload"] or b"")
                    rows.append(r if payloads else r | {"payload": None})
                    if len(rows) >= 4096 or payloads and size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select(archive).mapInArrow(read, RECORD_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM m
"""
