"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every task writes its own archives to the shared folder and reports their paths; the report is a Parquet
table, so only archives of committed task attempts are ever read. Reading streams frame by frame and holds one record.

Defined cases: a null payload is empty; payloads under `least` bytes never become revisits; rows that repeat the
smallest page_id of a payload are all responses; control characters in a URL are percent-encoded; a null page_id is
written as an empty id and reads back as null; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import map_batches, materialise, scratch

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Beyond so many archives, a task reads several.
MOST_READERS = 100_000

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


class BadArchive(ValueError):
    """A record or frame that breaks the format."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the whole payload, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, rows: int = 200, size: int = 32_768) -> bytes:
    """A dictionary from a bounded sample (`rows` payloads of at most 20,000 characters); empty where there are too few.
    It changes sizes of archives, never results."""
    sample = [r[0].encode() for r in pages.where("length(html) between 100 and 20000").select("html").limit(rows).collect()]
    try:
        return zstd.train_dictionary(size, sample).as_bytes() if len(sample) >= 20 else b""
    except zstd.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 64 << 20) -> DataFrame:
    """pages: page_id, url, html, payload_digest, refers_to. Returns path, records and bytes of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        packer = zstd.ZstdCompressor(level=3, write_checksum=True, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        out, name, records, size = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                frame = packer.compress(record_bytes(row["page_id"], row["url"], (row["html"] or "").encode(), row["payload_digest"], row["refers_to"]))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(map_batches(pages, write, "path string, records long, bytes long"), "warc-manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame after the dictionary frame; the stream is read once, forwards."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadArchive("no leading skippable frame")
    length = struct.unpack("<I", head[4:])[0]
    data = stream.read(length)
    if len(data) < length:
        raise BadArchive("the dictionary frame is cut off")
    if data[:4] == FRAME:  # the dictionary may be compressed itself
        data = zstd.ZstdDecompressor().decompressobj().decompress(data)
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data)) if data else zstd.ZstdDecompressor()
    rest = stream.read(chunk)
    while rest:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or stream.read(chunk)
                break
            rest = stream.read(chunk)
            if not rest:
                raise BadArchive("the last frame is cut off")
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises BadArchive where a header, a length or a digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise BadArchive("no WARC version line")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    try:
        length = int(fields["Content-Length"])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        page = re.fullmatch(r"<urn:page:(-?\d*)>", fields["WARC-Record-ID"])[1]
    except (KeyError, ValueError, TypeError) as error:
        raise BadArchive(f"a required header is missing or wrong: {error}") from None
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive("the block has another length than its header says")
    http, gap, body = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"(?:^|\r\n)Content-Length: (\d+)(?:\r\n|$)", http)
    if not gap or not http.startswith(b"HTTP/1.1 ") or not stated:
        raise BadArchive("the HTTP header is wrong")
    refers_to = None
    if kind == "response":
        if len(body) != int(stated[1]) or hashlib.sha256(body).hexdigest() != digest:
            raise BadArchive("the payload doesn't match its length or digest")
    elif kind == "revisit" and (to := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))) and not body:
        refers_to = int(to[1])
    else:
        raise BadArchive(f"a record of type {kind} that can't be read")
    return {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": refers_to, "payload_bytes": int(stated[1]), "payload_digest": digest, "payload": body if kind == "response" else None}


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives whose `path` the manifest lists; their number must be that which the writer reported."""
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item in b.to_pylist():
                store, path = fs.FileSystem.from_uri(item["path"])
                rows, seen = [], 0
                with store.open_input_stream(path) as stream:
                    for data in frames(stream):
                        rows.append(parse_record(data))
                        seen += 1
                        if len(rows) == 500:
                            yield batch(rows)
                            rows = []
                if seen != item["records"]:
                    raise BadArchive(f"{path} has {seen} records, {item['records']} were written")
                if rows:
                    yield batch(rows)

    # One task for each archive: a number that is given isn't coalesced, however little a list of paths weighs.
    archives = manifest.select("path", "records")
    return map_batches(archives.repartition(min(max(archives.count(), 1), MOST_READERS)), read, schema)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes every page as a record, equal payloads of at least `least` bytes once, and returns the archives' manifest."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html").withColumns({
        "payload_digest": F.sha2(F.coalesce("html", F.lit("")), 256),
        "n_bytes": F.octet_length(F.coalesce("html", F.lit(""))),
    })
    firsts = (
        pages.where(F.col("n_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    firsts = materialise(firsts, "warc-firsts")  # its size is known now: small, it is broadcast; else a skewed digest is split
    marked = pages.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )
    return write_archives(marked, scratch(spark, "warc"), train_dictionary(pages))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of `pages` hold, read back."""
    return read_archives(archive_pages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
