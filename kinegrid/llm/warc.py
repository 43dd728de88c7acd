"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all its records,
plain or compressed; one Zstandard frame follows for each record. The reader loads the dictionary from the
leading frame, decodes frame by frame, and checks version line, header syntax, Content-Length against the
block, the record's end, the HTTP block's own length, and payload digests; anything odd raises ValueError.

Archives are written by the tasks straight into the shared folder (``file:`` paths by the local API, others
through pyarrow's file systems) under names of their own; the manifest, a table committed by Spark, lists
the archives of the attempts that counted. They are read back with Spark's binaryFile source. ``ARCHIVE_MB``
bounds an archive, and so a reader's memory; a larger record makes a larger archive.

Cases: null html is an empty payload; a null url becomes a urn made of the id; control characters and blanks in a url are
percent-encoded; a null page_id stays null; rows that repeat the id and payload of a response are responses too;
an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
LEAST = 100  # bytes from which equal payloads are stored once
ARCHIVE_MB = 16
DICTIONARY_PAGES, DICTIONARY_PREFIX, DICTIONARY_BYTES = 400, 8192, 32768
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page refers_to, with its own HTTP block."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {name(page_id)[1:-1] if url is None else quote(url, safe=PRINTABLE)}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PRINTABLE = "".join(chr(c) for c in range(33, 127) if c != ord("%"))


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame; the dictionary inside is itself compressed."""
    data = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(data)) + data


def read_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and the place of its first record."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary's frame is cut short")
    found = data[8 : 8 + size]
    if found[:4] == ZSTD_MAGIC:
        found = zstandard.ZstdDecompressor().decompress(found, max_output_size=64 << 20)
    return zstandard.ZstdCompressionDict(found), 8 + size


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame after the dictionary."""
    dictionary, at = read_dictionary(data)
    decode = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 4] != ZSTD_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one = decode.decompressobj()
        out, fed, step = [], at, 1 << 12  # what is fed beyond the frame's end is copied, so steps grow with the frame
        while not one.eof:
            if fed >= len(data):
                raise ValueError(f"the frame at byte {at} is cut short")
            out.append(one.decompress(view[fed : fed + step]))
            fed, step = min(len(data), fed + step), min(2 * step, 1 << 20)
        at = fed - len(one.unused_data)
        yield b"".join(out)


def _fields(head: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.0-9A-Z^-z|~]+", key):
            raise ValueError(f"a malformed line in the {what} header: {line[:80]!r}")
        key = key.decode().lower()
        if key in out:
            raise ValueError(f"{key} occurs twice in the {what} header")
        out[key] = value.strip().decode()
    return out


def _id(urn: str) -> int | None:
    """The page that a record id names, if it is one of this writer's."""
    if not re.fullmatch(r"<[^<>\s]+:[^<>\s]*>", urn):
        raise ValueError(f"not a record id: {urn[:80]}")
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def parse_record(data: bytes) -> dict | None:
    """The record in a frame, validated; None for a record that is neither a response nor a revisit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("not a WARC record")
    field = _fields(head, "WARC")
    lacks = {"warc-type", "warc-record-id", "warc-date", "content-length"} - field.keys()
    if lacks:
        raise ValueError(f"the record lacks {sorted(lacks)}")
    if not field["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if "warc-block-digest" in field and field["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block does not match its digest")
    kind = field["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, http = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("the block is no HTTP response")
    length = int(_fields(http, "HTTP")["content-length"])
    kind_digest, _, digest = field.get("warc-payload-digest", "").partition(":")
    if kind_digest != "sha256" or not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("the payload's digest is missing or malformed")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in field):
        raise ValueError("a revisit has no payload and names what it refers to")
    return {
        "record_id": field["warc-record-id"], "page_id": _id(field["warc-record-id"]), "url": unquote(field.get("warc-target-uri", "")), "record_type": kind,
        "refers_to": _id(field["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": length, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _put(uri: str, parts: list[bytes]) -> None:
    """Write a file of the shared folder; it appears under its name when it is complete."""
    where = urlsplit(uri)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        with open(f"{where.path}.part", "wb") as f:
            f.writelines(parts)
        os.replace(f"{where.path}.part", where.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as f:
            for x in parts:
                f.write(x)


def train(pages: DataFrame) -> bytes:
    """A dictionary from the starts of a bounded number of pages (those with the smallest hash of their ids)."""
    some = bounded_sample(pages.where("html is not null"), "page_id", DICTIONARY_PAGES)
    texts = [r["html"].encode() for r in some.select(F.substring("html", 1, DICTIONARY_PREFIX).alias("html")).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: plain content serves as well
        return b"".join(texts)[:DICTIONARY_BYTES] or b"<html><head><title></title></head><body></body></html>"


@dataclass
class Archives:
    root: str
    manifest: DataFrame  # archive, records, bytes


def write_archives(spark: SparkSession, pages: DataFrame, archive_mb: int = ARCHIVE_MB, least: int = LEAST) -> Archives:
    """A record for each row of pages (page_id, url, html); equal payloads of ``least`` bytes are stored once."""
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    html = F.coalesce("html", F.lit("")).cast("binary")
    prints = scratch.write(pages.where(F.length(html) >= least).select("page_id", F.unhex(F.sha2(html, 256)).alias("digest")), "digests")
    first = prints.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = prints.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    # revisits only: their written size decides whether they are broadcast or shuffled
    again = scratch.write(again, "revisits").withColumnRenamed("page_id", "again")
    rows = pages.join(again, (F.col("page_id") == F.col("again")) & (F.unhex(F.sha2(html, 256)) == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")
    dictionary, root = train(pages), scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = zstandard.ZstdCompressionDict(dictionary)
        own.precompute_compress(level=3)
        pack = zstandard.ZstdCompressor(dict_data=own, write_checksum=True)
        head = leading_frame(dictionary)
        parts, size, number = [head], 0, 0
        done = []

        def close() -> None:
            nonlocal parts, size, number
            name = f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.warc.zst"
            _put(f"{root}/{name}", parts)
            done.append((name, len(parts) - 1, size + len(head)))
            parts, size, number = [head], 0, number + 1

        for batch in batches:
            for page_id, url, text, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                parts.append(pack.compress(record_bytes(page_id, url, (text or "").encode(), refers)))
                size += len(parts[-1])
                if size >= archive_mb << 20:
                    close()
        if len(parts) > 1:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    return Archives(root, scratch.write(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest"))


def read_archives(spark: SparkSession, archives: Archives) -> DataFrame:
    """All records of the archives, payloads included; the records of each archive must be as many as the manifest says."""
    if not archives.manifest.limit(1).count():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(archives.root)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").join(archives.manifest.select("archive", "records"), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size, seen = [], 0, 0
                for data in frames(batch.column("content")[i].as_py()):
                    seen, size, found = seen + 1, size + len(data), parse_record(data)
                    if found:
                        rows.append(found)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                if seen != batch.column("records")[i].as_py():
                    raise ValueError(f"{batch.column('archive')[i].as_py()} has {seen} records")

    return files.mapInArrow(run, RECORD)
