"""WARC archives in seekable Zstandard bundles.

Each task writes bundles: records are grouped into independent frames, a footer seek table lists the frames, and an
index maps each record id to (bundle, frame, offset in the frame, length). Reading goes through the index: seek table,
one frame, one record.

Cases: null html is an empty payload; a null url has no target header; null page_ids sort after all others (their record
id is `null`), and rows that repeat the smallest page_id of a payload are all responses. Control characters of a url are
percent-encoded in the header. A payload of any length is one record in one frame; a task holds one frame at a time. An empty
table gives an empty archive. Extra columns are ignored. A retried task writes
bundles under new names; only bundles that the committed index names are part of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import only, saved, shared_dir

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
INDEX_SCHEMA = "page_id long, bundle string, frame int, offset int, length int"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; refers_to makes it a revisit, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "record_type": fields["WARC-Type"],
        "id": fields["WARC-Record-ID"][10:-1],
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "digest": digest,
        "refers_to": fields["WARC-Refers-To"][10:-1] if "WARC-Refers-To" in fields else None,
    }


class BundleWriter:
    """Frames of records in one file after another; index rows come out of add() and close()."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.packer, self.out, self.rows = zstandard.ZstdCompressor(level=3), None, []

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.sizes, self.held, self.held_bytes, self.written = [], [], 0, 0

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self._open()
        self.rows.append((page_id, self.name, len(self.sizes), self.held_bytes, len(data)))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= FRAME_BYTES:
            self._frame()
            if self.written >= BUNDLE_BYTES:
                self.close()

    def _frame(self) -> None:
        packed = self.packer.compress(b"".join(self.held))
        self.out.write(packed)
        self.sizes.append((len(packed), self.held_bytes))
        self.written += len(packed)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC))
        self.out.close()
        self.out = None

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=["page_id", "bundle", "frame", "offset", "length"])
        return out.astype({"page_id": "Int64"})


class BundleReader:
    """Frames by number, through the seek table at the end of the file."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.frames[k]
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain))
        return self.last[1]


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles to folder (any file system that pyarrow opens by URI, shared by all executors) and returns the
    index. Equal payloads of at least min_revisit_bytes are stored once, as the response of their smallest page_id."""
    rows = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_n", F.octet_length("html"))
    first = rows.where(F.col("_n") >= min_revisit_bytes).groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies"))
    rows = rows.join(first.where("_copies > 1").drop("_copies"), ["_sha", "_n"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = BundleWriter(folder)
        for batch in batches:
            for page_id, url, html, first in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["_first"].astype("Int64"), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                own = "null" if page_id is pd.NA else str(page_id)
                refers = None if first is pd.NA or own == str(first) else str(first)
                out.add(page_id, record(own, url, payload, base32_sha1(payload), refers, date))
            yield out.taken()
        out.close()

    return saved(rows.select("page_id", "url", "html", "_first").mapInPandas(write, INDEX_SCHEMA), "warc-index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload (empty for a revisit), payload_bytes, payload_digest, refers_to."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part, out = batch.iloc[a : a + 1000], []
                for page_id, bundle, k, at, n in zip(
                    part["page_id"].astype("Int64"),
                    part["bundle"],
                    part["frame"],
                    part["offset"],
                    part["length"],
                    strict=True,
                ):
                    if bundle != name:
                        name, reader = bundle, BundleReader(store, f"{top}/{bundle}")
                    r = parsed(reader.frame(k)[at : at + n])
                    refers = pd.NA if r["refers_to"] in (None, "null") else int(r["refers_to"])
                    out.append((page_id, r["url"], r["record_type"], r["payload"], r["payload_bytes"], r["digest"], refers))
                done = pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
                yield done.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads every record back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    return read_archive(write_archive(pages, folder, min_revisit_bytes), folder)
