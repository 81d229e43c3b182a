"""The FASTQ source: ranges of plain and block gzip files, ordinary gzip, damage, and bounded memory."""

import gzip
import random
import resource
import struct
import zlib

import pytest

from evidentia.sources import fastq


def block(data):
    """One BGZF block."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = len(body) + 26
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def bgzf(data, size):
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


def reads(seed, n, longest=40):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        m = rng.choice([0, 1, 7, rng.randint(0, longest)])
        qual = "".join(chr(rng.choice([33, 43, 64, 64, 64, rng.randint(33, 126)])) for _ in range(m))  # `@` and `+` are common
        out.append((f"r{k}" + rng.choice(["", " @x", "+"]), "".join(rng.choice("ACGTN") for _ in range(m)), qual))
    return out


def text_of(rows, end="\n", name_again=False):
    return "".join(f"@{n}{end}{s}{end}+{n if name_again else ''}{end}{q}{end}" for n, s, q in rows).encode()


def parts(path, range_bytes):
    return [[tuple(x.decode() for x in r) for r in fastq.records(p)] for p in fastq.ranges(str(path), range_bytes)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("range_bytes", [1, 2, 3, 17, 61, 64, 1000, 1 << 20])
def test_every_record_lies_in_one_range(tmp_path, range_bytes, end):
    for seed, n in enumerate((0, 1, 2, 3, 40)):
        rows = reads(seed, n)
        text = text_of(rows, end, seed % 2 == 1)
        (tmp_path / f"{seed}.fq").write_bytes(text)
        (tmp_path / f"{seed}.cut.fq").write_bytes(text[: -len(end)] if rows and rows[-1][2] else text)
        for name in (f"{seed}.fq", f"{seed}.cut.fq"):
            assert [r for p in parts(tmp_path / name, range_bytes) for r in p] == rows


@pytest.mark.parametrize("size", [1, 13, 50, 400])
def test_block_gzip_ranges(tmp_path, size):
    rows = reads(size, 60)
    (tmp_path / "x.fq.gz").write_bytes(data := bgzf(text_of(rows), size))
    for range_bytes in (30, 77, 500, len(data)):
        found = parts(tmp_path / "x.fq.gz", range_bytes)
        assert [r for p in found for r in p] == rows and (len(found) > 3 or range_bytes >= 500)


def test_blocks_are_not_taken_from_their_content(tmp_path):
    """The bytes of a header inside a block do not start one."""
    rows = [(f"a{k}", "ACGT", "IIII") for k in range(30)]
    stored = b"".join(block(text_of(rows[k : k + 3])) for k in range(0, 30, 3))
    trap = stored[:18] * 3
    raw = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, 18 + 5 + len(trap) + 8 - 1)
    stuck = raw + b"\x01" + struct.pack("<HH", len(trap), 65535 - len(trap)) + trap + struct.pack("<2I", zlib.crc32(trap), len(trap))
    (tmp_path / "t.gz").write_bytes(stored + stuck + block(b""))
    with fastq.fs.LocalFileSystem().open_input_file(str(tmp_path / "t.gz")) as f:
        size = f.size()
        assert fastq.first_block(f, "t", len(stored) + 1, size) == len(stored) + len(stuck)


def test_spark_reads_all_kinds(spark, tmp_path):
    rows = reads(5, 300)
    (tmp_path / "a.fastq").write_bytes(text_of(rows))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text_of(rows[:100])) + gzip.compress(text_of(rows[100:])))
    (tmp_path / "c.fastq.gz").write_bytes(bgzf(text_of(rows), 200))
    (tmp_path / "d.fastq").write_bytes(b"")
    got = fastq.load_fastq(spark, str(tmp_path / "*.fastq*"), 512)
    assert got.rdd.getNumPartitions() > 10
    by_file = {}
    for r in got.collect():
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["record_no"], r["name"], r["seq"], r["qual"]))
    want = [(k + 1, *r) for k, r in enumerate(rows)]
    assert {k: sorted(v) for k, v in by_file.items()} == {k: want for k in ("a.fastq", "b.fastq.gz", "c.fastq.gz")}
    one = fastq.load_fastq(spark, f"file://{tmp_path}/a.fastq").collect()
    assert [(r["record_no"], r["name"]) for r in one] == [(k + 1, r[0]) for k, r in enumerate(rows)]
    with pytest.raises(FileNotFoundError):
        fastq.load_fastq(spark, str(tmp_path / "none*"))


@pytest.mark.parametrize(
    "damage",
    [
        lambda t: t[:-3],  # a short last quality
        lambda t: t.replace(b"@r40", b"r40", 1),
        lambda t: t.replace(b"\n+\n", b"\n-\n", 1),
        lambda t: t + b"@last\nACGT\n+\n",
        lambda t: t + b"@last\nAC+T\n+\nIIII\n",
        lambda t: t + b"\n\n\n\n",
    ],
)
@pytest.mark.parametrize("kind", ["plain", "gzip", "blocks"])
def test_damaged_records_are_errors(tmp_path, damage, kind):
    text = damage(text_of([(f"r{k}", "ACGTAC", "IIIIII") for k in range(60)]))
    data = {"plain": text, "gzip": gzip.compress(text), "blocks": bgzf(text, 100)}[kind]
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(fastq.Damaged):
        parts(tmp_path / "x", 200)


@pytest.mark.parametrize("kind", ["gzip", "blocks"])
def test_damaged_gzip_is_an_error(tmp_path, kind):
    text = text_of(reads(1, 500))
    data = gzip.compress(text) if kind == "gzip" else bgzf(text, 500)
    for broken in (data[: len(data) // 2], data[: len(data) // 2] + b"\xff" + data[len(data) // 2 + 1 :]):
        (tmp_path / "x").write_bytes(broken)
        with pytest.raises(fastq.Damaged):
            parts(tmp_path / "x", 1 << 20)


def test_a_large_file_needs_little_memory(tmp_path):
    """3 GiB of text, as one ordinary gzip member that repeats a piece: it is streamed."""
    piece = text_of([(f"r{k}", "ACGT" * 2048, "IIII" * 2048) for k in range(100)])
    times = (3 << 30) // len(piece) + 1
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    with open(tmp_path / "big.gz", "wb") as f:
        for _ in range(times):
            f.write(deflate.compress(piece))
        f.write(deflate.flush())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(1 for p in fastq.ranges(str(tmp_path / "big.gz"), 64 << 20) for _ in fastq.records(p)) == 100 * times
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10  # KiB


def test_short_ranges_do_not_make_a_task_each():
    parts = [fastq.Range("p", k, 100 * k, 100 * k + 100, "plain") for k in range(1000)]
    tasks = fastq.dealt(parts)
    assert len(tasks) == fastq.TASKS and [p for t in tasks for p in t.parts] == parts
    large = [fastq.Range("p", k, k << 26, (k + 1) << 26, "plain") for k in range(300)]
    assert [len(t.parts) for t in fastq.dealt(large)] == [1] * 300 and [len(t.parts) for t in fastq.dealt(parts[:3])] == [1] * 3
