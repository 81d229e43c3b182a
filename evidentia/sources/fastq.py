"""FASTQ files as a Python data source with its own partitions.

A plain file is cut into byte ranges. So is a block gzip file (BGZF): its blocks are gzip members that tell their own size, so a
task finds the first block of its range, checks it by inflating it and by the blocks that follow, and indexes the blocks to
its end. An ordinary gzip file can only be read from its start and is one partition. Whatever the kind, a task holds one read
buffer and one batch of records.

A record belongs to the range that its first byte lies in, where the first byte of a range belongs to the range before (only
the first range of a file owns its own). A task finds its first record by the shape of records: a line with `@`, and two lines on one with
`+`; as sequences hold neither sign, no other line of a record fits.
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, range_no int, ordinal long, name string, seq string, qual string"
COUNTS = "path string, range_no int, records long"
BUFFER, BATCH_ROWS, BATCH_BYTES = 1 << 20, 4096, 4 << 20
SEQUENCE = re.compile(rb"[A-Za-z.*\-]*\Z")
# The first four bytes of a gzip member with extra fields, and the field that tells a block's size.
GZIP, EXTRA = b"\x1f\x8b", b"\x1f\x8b\x08\x04"
HEADER = 18


class Damaged(ValueError):
    def __init__(self, path: str, why: str):
        super().__init__(f"damaged FASTQ file {path}: {why}")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that fit: a file, a folder's files, or a pattern."""
    store, path = opened(glob)
    scheme = glob[: len(glob) - len(path)] if glob.endswith(path) else ""
    if re.search(r"[*?\[]", path):
        base = re.split(r"[^/]*[*?\[]", path)[0].rstrip("/") or "/"
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if fnmatch.fnmatchcase(f.path, path) and f.path.count("/") == path.count("/")]
    else:
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
    out = sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File)
    if not out:
        raise FileNotFoundError(f"no FASTQ file at {glob}")
    return out


def block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that begins with this header; None if none does."""
    if len(head) < HEADER or head[:4] != EXTRA or head[10:16] != b"\x06\x00BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


@dataclass
class Range(InputPartition):
    path: str
    range_no: int
    start: int
    end: int
    kind: str  # plain, gzip or blocks
    first: int = 0  # records of the file before this range


#: Ranges are dealt out over so many tasks, or one for so many stored bytes where that is more.
TASKS, TASK_BYTES = 64, 64 << 20


@dataclass
class Task(InputPartition):
    parts: list[Range]


def dealt(parts: list[Range]) -> list[Task]:
    """Neighbouring ranges in tasks, so that short ranges do not make a task each."""
    n = min(len(parts), max(TASKS, sum(p.end - p.start for p in parts) // TASK_BYTES))
    return [Task(parts[len(parts) * k // n : len(parts) * (k + 1) // n]) for k in range(n)]


def kind_of(path: str) -> str:
    store, p = opened(path)
    with store.open_input_file(p) as f:
        head = f.read(HEADER)
    return "plain" if head[:2] != GZIP else "gzip" if block_size(head) is None else "blocks"


def ranges(glob: str, range_bytes: int) -> list[Range]:
    """The partitions: ranges of about range_bytes of stored bytes, and each ordinary gzip file as one."""
    out = []
    for path, size in listed(glob):
        kind = kind_of(path)
        n = 1 if kind == "gzip" else max(1, -(-size // range_bytes))
        cuts = [size * k // n for k in range(n + 1)]
        out += [Range(path, k, cuts[k], cuts[k + 1], kind) for k in range(n)]
    return out


def inflated(path: str, data: bytes) -> bytes:
    """The content of one whole gzip member."""
    try:
        inflater = zlib.decompressobj(31)
        out = inflater.decompress(data)
    except zlib.error as e:
        raise Damaged(path, f"{e}") from e
    if not inflater.eof:
        raise Damaged(path, "a gzip block ends early")
    return out


def first_block(f: pa.NativeFile, path: str, at: int, size: int, chain: int = 3) -> int:
    """The place of the first block at or after `at`: a header whose block inflates and that `chain` more follow, or the end."""
    if at == 0:
        return 0
    while at < size:
        f.seek(at)
        window = f.read((1 << 16) + HEADER)
        place = window.find(EXTRA)
        while 0 <= place <= len(window) - HEADER:
            start = here = at + place
            for _ in range(chain):
                f.seek(here)
                head = f.read(HEADER)
                if not head and here == size:
                    break
                n = block_size(head)
                if n is None or here + n > size:
                    here = -1
                    break
                here += n
            if here > 0:
                f.seek(start)
                try:
                    inflated(path, f.read(block_size(window[place : place + HEADER])))
                    return start
                except Damaged:
                    pass
            place = window.find(EXTRA, place + 1)
        at += max(1, len(window) - HEADER)
        if len(window) <= HEADER:
            break
    return size


def contents(part: Range) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the text from the start of a range to the end of the file, and whether the piece lies in the range."""
    store, p = opened(part.path)
    if part.kind == "gzip":
        with store.open_input_stream(p, compression=None, buffer_size=BUFFER) as f:
            inflater = None
            while data := f.read(BUFFER):
                while data:
                    if inflater is None:
                        if not data.strip(b"\0"):
                            break  # padding after the last member
                        inflater = zlib.decompressobj(31)
                    try:
                        text = inflater.decompress(data, BUFFER)  # the rest waits: a few bytes can stand for much text
                    except zlib.error as e:
                        raise Damaged(part.path, f"{e}") from e
                    yield text, True
                    if inflater.eof:
                        data, inflater = inflater.unused_data, None
                    else:
                        data = inflater.unconsumed_tail
            if inflater is not None:
                raise Damaged(part.path, "a gzip member ends early")
        return
    with store.open_input_file(p) as f:
        size = f.size()
        if part.kind == "plain":
            f.seek(part.start)
            at = part.start
            while data := f.read(BUFFER if at >= part.end else min(BUFFER, part.end - at)):
                yield data, at < part.end
                at += len(data)
            return
        at, last = first_block(f, part.path, part.start, size), first_block(f, part.path, part.end, size)
        index = []  # place and size of each block of the range; 64 KiB of text a block at most
        while at < size:
            f.seek(at)
            n = block_size(f.read(HEADER))
            if n is None or at + n > size:
                raise Damaged(part.path, f"no whole block at byte {at}")
            if at < last:
                index.append((at, n))
            else:
                break
            at += n
        for start, n in index:
            f.seek(start)
            yield inflated(part.path, f.read(n)), True
        while at < size:  # what the last record needs
            f.seek(at)
            n = block_size(f.read(HEADER))
            if n is None or at + n > size:
                raise Damaged(part.path, f"no whole block at byte {at}")
            f.seek(at)
            yield inflated(part.path, f.read(n)), False
            at += n


def lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place of the first byte, line without its end) from the start of a range on; None as place marks lines of later ranges."""
    held, place, inside, own_end = b"", 0, True, None
    read = 0
    for piece, own in contents(part):
        if inside and not own:
            own_end, inside = read, False
        read += len(piece)
        parts = (held + piece).split(b"\n")
        held = parts.pop()
        for x in parts:
            yield (place if own_end is None or place <= own_end else -1), x.removesuffix(b"\r")
            place += len(x) + 1
    if held:
        yield (place if own_end is None or place <= own_end else -1), held.removesuffix(b"\r")


def records(part: Range) -> Iterator[tuple[bytes, bytes, bytes]]:
    """name, sequence and quality of the records that a range owns."""
    source = lines(part)
    if part.range_no:
        next(source, None)  # it belongs to the range before, whole or not
        held = []
        while True:
            line = next(source, None)
            if line is not None:
                held.append(line)
            full = len(held) >= 7 or line is None
            if full:
                break
        fits = [o for o in range(min(4, len(held))) if held[o][1][:1] == b"@" and len(held) > o + 2 and held[o + 2][1][:1] == b"+"]
        if not fits:
            if held and held[0][0] >= 0 and len(held) >= 7:
                raise Damaged(part.path, f"no record in the {len(held)} lines from range {part.range_no} on")
            return
        source = chained(held[fits[0] :], source)
    while (head := next(source, None)) is not None and head[0] >= 0:
        seq, mark, qual = (next(source, (None, None))[1] for _ in range(3))
        if qual is None or head[1][:1] != b"@" or mark[:1] != b"+" or len(seq) != len(qual) or not SEQUENCE.match(seq):
            raise Damaged(part.path, f"record {head[1][:60]!r}")
        yield head[1][1:], seq, qual


def chained(first: list, rest: Iterator) -> Iterator:
    yield from first
    yield from rest


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.glob, self.counting = options["path"], options.get("count", "false").lower() == "true"
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.starts = json.loads(options.get("starts", "{}"))

    def partitions(self) -> list[Task]:
        out = ranges(self.glob, self.range_bytes)
        for part in out:
            starts = self.starts.get(part.path)
            part.first = starts[part.range_no] if starts else 0
        return dealt(out)

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        for part in task.parts:
            yield from self.read_range(part)

    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.counting:
            yield pa.RecordBatch.from_pydict({"path": [part.path], "range_no": pa.array([part.range_no], pa.int32()), "records": [sum(1 for _ in records(part))]})
            return
        names, seqs, quals, size, done = [], [], [], 0, part.first
        for name, seq, qual in records(part):
            for column, x in ((names, name), (seqs, seq), (quals, qual)):
                column.append(x)
            size += len(name) + 2 * len(seq)
            if len(names) == BATCH_ROWS or size >= BATCH_BYTES:
                yield batch(part, done, names, seqs, quals)
                done, size = done + len(names), 0
                names, seqs, quals = [], [], []
        if names:
            yield batch(part, done, names, seqs, quals)


def batch(part: Range, done: int, names: list[bytes], seqs: list[bytes], quals: list[bytes]) -> pa.RecordBatch:
    n = len(names)
    try:
        text = [pa.array([x.decode("ascii") for x in column], pa.string()) for column in (names, seqs, quals)]
    except UnicodeDecodeError as e:
        raise Damaged(part.path, f"{e}") from e
    head = [pa.array([part.path] * n), pa.array([part.range_no] * n, pa.int32()), pa.array(range(done + 1, done + n + 1), pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *text], names=["path", "range_no", "ordinal", "name", "seq", "qual"])


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path or pattern). Options: rangeBytes (stored bytes of a partition), count (true: one row with
    the number of records per partition), starts (records before each partition, as JSON by path)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return COUNTS if self.options.get("count", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def load_fastq(spark: SparkSession, glob: str, range_bytes: int = 64 << 20) -> DataFrame:
    """path, record_no (from 1 in its file), name, seq, qual of every record. Lines of unequal length, other framing and broken gzip
    data are errors. Where a file has several ranges their records are counted first, in tasks; one number per range comes to
    the driver. An empty file has no records."""
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq").option("rangeBytes", range_bytes)
    counts = reader.option("count", True).load(glob)
    several = max(part.range_no for part in ranges(glob, range_bytes)) > 0
    starts: dict[str, list[int]] = {}
    if several:
        for row in counts.orderBy("path", "range_no").collect():
            before = starts.setdefault(row["path"], [0])
            before.append(before[-1] + row["records"])
    rows = spark.read.format("fastq").option("rangeBytes", range_bytes).option("starts", json.dumps(starts)).load(glob)
    return rows.select("path", F.col("ordinal").alias("record_no"), "name", "seq", "qual")
