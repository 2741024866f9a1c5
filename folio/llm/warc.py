"""WARC archives with an index made as they are written, and reads of selected records by coalesced byte ranges."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tasks, new_path, written
from .files import NewFile, Ranges

#: Payloads of at least so many bytes are stored once; later copies are revisits.
LEAST_SHARED = 1000
#: Bytes at which an archive is closed and the next begun.
ARCHIVE_BYTES = 1 << 30
#: Records that lie at most so far apart are fetched by one read, of at most READ_BYTES unless one record is larger.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record_id(archive: str, offset: int) -> str:
    """Of the record at that place: no other has it, also if rows are repeated or have no page_id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _header_text(s: str) -> str:
    """A url as a header can hold it: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in s)


def encode_record(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record as a gzip member of its own. Of a revisit, the HTTP header is stored without the payload; the response that it
    refers to is named by its page and url. A url that a header can't hold as it is goes along in base64."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
        if _header_text(url) != url:
            lines.append(f"X-Target-URI: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_text(refers_url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def decode_record(data: bytes) -> dict:
    """The record in one gzip member; the payload is null for a revisit."""
    d = zlib.decompressobj(31)
    raw = d.decompress(data) + d.flush()
    if not d.eof or d.unused_data or not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not one whole record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    body = rest[:n].partition(b"\r\n\r\n")[2]
    url = fields.get("WARC-Target-URI")
    if "X-Target-URI" in fields:
        url = base64.b64decode(fields["X-Target-URI"]).decode("utf-8", "surrogatepass")
    return {
        "page_id": None if page is None else int(page),
        "url": url,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload": body if fields["WARC-Type"] == "response" else None,
    }


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes each row as a WARC record into folder and returns the index, a written table (INDEX).

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least LEAST_SHARED bytes the row with the
    largest page_id is the response and all others revisit it; equal payloads and page_ids (repeated rows) are
    each a record, the repeated largest ones all responses. Smaller ones are all responses. Rows with a null page_id
    are responses and nothing refers to them.

    Only digests with two rows or more are joined back, one row each, and adaptive execution splits a hot one.
    A task writes archives of its own, of ARCHIVE_BYTES about, which only a finished attempt's index rows name: a lost
    or repeated task leaves a file that nothing refers to.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = rows.where(f"octet_length(payload) >= {LEAST_SHARED} and page_id is not null")
    keepers = written(shared.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "keepers")
    refers = (F.col("digest") == F.col("d")) & F.expr(f"octet_length(payload) >= {LEAST_SHARED}") & (F.col("page_id") < F.col("refers_to"))
    rows = rows.join(keepers, refers, "left").drop("d")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = None, TaskContext.get().partitionId()
        for batch in batches:
            index: list[dict] = []
            for page, u, payload, digest, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")), strict=True):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    out = NewFile(folder, f"part-{part:05d}", ".warc.gz")
                    c = zlib.compressobj(1, zlib.DEFLATED, 31)
                    info = b"software: folio\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(c.compress(head.encode() + info + b"\r\n\r\n") + c.flush())
                record = encode_record(record_id(out.uri, out.size), page, u, payload, digest, to, to_url)
                index.append({"page_id": page, "url": u, "archive": out.uri, "offset": out.write(record), "length": len(record), "payload_digest": digest, "payload_bytes": len(payload), "record_type": "response" if to is None else "revisit", "refers_to": to})
            yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        if out:
            out.close()

    return written(rows.mapInArrow(write, INDEX), "warc-index")


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def coalesced(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, length, records in it) for (offset, length) of records in the order of a file."""
    held: list[tuple[int, int]] = []
    for at, n in wanted:
        end = held[-1][0] + held[-1][1] if held else 0
        if held and (at - end > GAP_BYTES or at + n - held[0][0] > READ_BYTES):
            yield held[0][0], end - held[0][0], held
            held = []
        held.append((at, n))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1] - held[0][0], held


def read_warc(index: DataFrame) -> DataFrame:
    """The records (RECORD) at the archive, offset and length of index, a selection of what write_warc returns.

    The ranges are dealt out and sorted by archive and offset, so that a task reads neighbouring records by one
    request. Payloads of revisits are null: join their refers_to for them. No index rows give no records.
    """
    n = n_tasks(index.sparkSession)
    ranges = index.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            names, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            begin = 0
            while begin < len(names):
                end = begin
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                for at, n, records in coalesced(list(zip(offsets[begin:end], lengths[begin:end], strict=True))):
                    data = files.read(names[begin], at, n)
                    yield pa.RecordBatch.from_pylist([decode_record(data[o - at : o - at + k]) for o, k in records], schema=_RECORD)
                begin = end
        files.close()

    return ranges.mapInArrow(read, RECORD)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < top THEN top END AS refers_to
FROM k
"""
