"""WARC archives with revisit resolution.

Headers alone are grouped by payload digest; records whose payload another record holds become revisits of it, and
archives are written without their payloads but with fresh headers. Each task writes gzip members of its own to the shared
folder and names its files in a manifest row, which only a successful attempt leaves.
"""

from __future__ import annotations

import base64
import datetime
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, scratch, tasks, written

#: Payloads shorter than this are never revisits; bytes after which a task begins another file; compression level.
LEAST_BYTES, FILE_BYTES, LEVEL = 1000, 64 << 20, 3
#: Digests shared by several records that may be broadcast (32 bytes each); more are joined by an exchange.
BROADCAST_ROWS = 100_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (hex SHA-1), refers_to (page_id of the original, or null).

    The original of equal payloads is the one with the largest page_id; further rows with that very page_id, and rows
    whose payload has only null ids, are originals too. Null html is an empty payload. Payloads may be of any length, other
    columns are left out, and an empty table stays empty. Payloads are exchanged only where more digests than may be
    broadcast are shared; digests that many records share are broadcast even then.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    heads = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    heads = written(heads.where("n > 1 and original is not null").drop("payload_bytes"), "originals")
    if heads.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(heads.drop("n")), "payload_digest", "left")
    else:
        joined = join_uneven(rows, heads, "payload_digest", "n", "left")
    refers = F.when(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(got[1]) if got else None


def _field(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_field(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of resolve_revisits below folder (a URI that executors share); returns the manifest: path, records.

    A null page_id makes the record id none, a null or empty url no target; equal rows make a record each. A payload of any
    length is one record; an empty table makes no file.
    """
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, top), task = pa.fs.FileSystem.from_uri(folder), TaskContext.get()
        place.create_dir(top)
        out, path, n, made = None, "", 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    path = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made)}.warc.gz"
                    out, n = place.open_output_stream(path, compression=None), 0
                    out.write(_member(info.encode()))
                out.write(_member(record(page_id, url, payload, digest, refers_to, date)))
                n += 1
                if out.tell() > FILE_BYTES:
                    out.close()
                    out = None
                    made.append((path, n))
        if out is not None:
            out.close()
            made.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "manifest")


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of a gzip-compressed WARC stream with a member for each record or not."""
    inflate, held, ended = zlib.decompressobj(31), bytearray(), False

    def more() -> bool:
        nonlocal inflate, ended
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        data = data or source.read(1 << 18)
        if not data:
            ended = True
            return False
        held.extend(inflate.decompress(data))
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 8 + size:
            if not more():
                break
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per page record: page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to, payload (null in revisits).

    A record of id none has a null page_id, one without a target a null url; an empty manifest gives no rows.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with place.open_input_stream(path, compression=None) as source:
                    for headers, block in records(source):
                        if headers.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        full = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = headers["warc-type"] == "revisit"
                        rows.append((_id(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], full, digest, _id(headers.get("warc-refers-to", "")), None if revisit else payload))
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.repartition(tasks(manifest.sparkSession)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for every page, reads all archives back, and returns what the archives say.

    Nulls, long payloads, repeated rows and an empty table are as in resolve_revisits() and write_archives().
    """
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(resolve_revisits(pages, least_bytes), folder)
    return read_archives(manifest, folder)
