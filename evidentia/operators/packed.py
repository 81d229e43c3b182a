"""Residues packed by column: bit planes for comparing rows, count vectors for summing them up. Numpy inside tasks; Spark deals the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = ord("-")
#: Columns of a long; bits of an ASCII letter, and of any code point.
LONG, LOW, ALL = 64, 7, 21
#: Columns that travel together, rows that travel as they are where counts do, and bytes of counts that a task holds.
WIDE, FEW, HELD_BYTES = 4096, 32, 64 << 20


def codes(text: str | None, width: int) -> np.ndarray:
    """Code points of a text, a byte each where all fit; filled up with 0 to a multiple of width (once at least)."""
    text = text or ""
    padded = text.ljust(max(1, -(-len(text) // width)) * width, "\0")
    try:
        return np.frombuffer(padded.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")


def planes_of(x: np.ndarray) -> np.ndarray:
    """Rows of longs, a bit a column: which columns are there, which are gaps, and the bits of the residues, the lowest first."""
    bits = ALL if x.max() >> LOW else LOW
    marks = [x != 0, x == GAP, *(x & x.dtype.type(1 << k) for k in range(min(bits, 8 * x.itemsize)))]
    return np.stack([np.packbits(m != 0, bitorder="little").view("<u8") for m in marks])


def compared(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Columns of two rows that count, and how many of these differ."""
    n, bits = min(a.shape[1], b.shape[1]), min(len(a), len(b))
    a, b = a[:, :n], b[:, :n]
    told = a[0] & b[0] & ~(a[1] & b[1])
    differ = np.bitwise_or.reduce(a[2:bits] ^ b[2:bits], axis=0)
    for longer in (a[bits:], b[bits:]):
        if len(longer):
            differ = differ | np.bitwise_or.reduce(longer, axis=0)
    return int(np.bitwise_count(told).sum()), int(np.bitwise_count(told & differ).sum())


def bit_planes(rows: DataFrame, keys: str) -> DataFrame:
    """Rows (keys..., sequence) as one row per WIDE columns: stretch, longs of a plane, and the planes. keys: names and types. An empty or null
    sequence has one stretch without columns. U+0000 is no residue."""
    names = [x.split()[0] for x in keys.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, place, stretch, longs, data = batch.iloc[at : at + 256], [], [], [], []
                for i, text in enumerate(part["sequence"]):
                    planes = planes_of(codes(text, LONG))
                    for k in range(0, planes.shape[1], WIDE // LONG):
                        own = planes[:, k : k + WIDE // LONG]
                        place.append(i)
                        stretch.append(k // (WIDE // LONG))
                        longs.append(own.shape[1])
                        data.append(own.tobytes())
                out = part[names].iloc[place].reset_index(drop=True)
                yield out.assign(stretch=np.array(stretch, np.int32), longs=np.array(longs, np.int32), planes=data)

    return rows.select(*names, "sequence").mapInPandas(pack, f"{keys}, stretch int, longs int, planes binary")


def compared_pairs(pairs: DataFrame, keys: str) -> DataFrame:
    """keys, compared and mismatches of pairs of stretches (planes_i, longs_i, planes_j, longs_j)."""
    names = [x.split()[0] for x in keys.split(", ")]
    columns = ("planes_i", "longs_i", "planes_j", "longs_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [compared(*(np.frombuffer(d, "<u8").reshape(-1, n) for d, n in ((x, m), (y, k)))) for x, m, y, k in zip(*(batch[c] for c in columns), strict=True)]
            yield batch[names].assign(compared=[f[0] for f in found], mismatches=[f[1] for f in found])

    return pairs.mapInPandas(run, f"{keys}, compared long, mismatches long")


class Counts:
    """Residues of a stretch of columns: a few rows as they are, more as counts by residue and column."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.counts: dict[int, np.ndarray] = {}

    def add(self, row: np.ndarray) -> None:
        """row: code points, 0 beyond the end of a text."""
        self.rows.append(row)
        if len(self.rows) > FEW:
            self.settle()

    def settle(self) -> None:
        if self.rows:
            block = np.stack(self.rows)
            for u in np.flatnonzero(np.bincount(block.ravel())) if block.itemsize == 1 else np.unique(block):
                if u != 0 and u != GAP:
                    self.plus(int(u), (block == u).sum(0, dtype=np.int64))
            self.rows = []

    def plus(self, residue: int, counts: np.ndarray) -> None:
        if residue in self.counts:
            self.counts[residue] += counts
        else:
            self.counts[residue] = counts.astype(np.int64)

    @property
    def size(self) -> int:
        return sum(r.nbytes for r in self.rows) + 8 * WIDE * len(self.counts)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """(residue, counts), and (less than 0, a row)."""
        for residue, counts in self.counts.items():
            yield residue, counts.tobytes()
        for row in self.rows:
            yield -row.itemsize, row.tobytes()

    def take(self, residue: int, data: bytes) -> None:
        if residue < 0:
            self.add(np.frombuffer(data, np.uint8 if residue == -1 else "<u4"))
        else:
            self.plus(residue, np.frombuffer(data, np.int64))

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns (from 0) that have residues, the count of the most common one, and all residues."""
        self.settle()
        if not self.counts:
            none = np.zeros(0, np.int64)
            return none, none, none
        each = np.stack(list(self.counts.values()))
        top, total = each.max(0), each.sum(0)
        at = np.flatnonzero(total)
        return at, top[at], total[at]


#: Rows that a task gives out at a time.
OUT_ROWS = 1 << 17


def column_counts(alignment: DataFrame) -> DataFrame:
    """alignment_id, col (from 1), top (rows with the most common residue) and residues (rows with any), of columns that have residues."""

    def columns(name, k: int, at: np.ndarray, top: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"alignment_id": name, "col": (at + k * WIDE + 1).astype(np.int32), "top": top, "residues": total})

    return by_stretch(alignment, columns, "col int, top long, residues long")


def full_runs(alignment: DataFrame, min_length: int) -> DataFrame:
    """alignment_id, first_col, last_col of the maximal runs, inside a stretch of WIDE columns, of columns whose residues are all alike. Runs
    shorter than min_length are left out, but not where they end at a border of the stretch."""

    def runs(name, k: int, at: np.ndarray, top: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        full = at[top == total]
        cut = np.flatnonzero(np.diff(full) > 1)
        first, last = full[np.concatenate([[0], cut + 1])] if len(full) else full, full[np.concatenate([cut, [len(full) - 1]])] if len(full) else full
        keep = (last - first + 1 >= min_length) | (first == 0) | (last == WIDE - 1)
        return pd.DataFrame({"alignment_id": name, "first_col": first[keep] + k * WIDE + 1, "last_col": last[keep] + k * WIDE + 1})

    return by_stretch(alignment, runs, "first_col long, last_col long")


def by_stretch(alignment: DataFrame, told, schema: str) -> DataFrame:
    """alignment_id and what told(alignment_id, stretch, columns from 0, top, residues) makes of each stretch of WIDE columns.

    A task adds up what it has of each stretch of columns, in bounded memory, and sends one entry per stretch and residue; entries of a
    stretch are merged one after the other. So no group of rows is ever held, however many rows an alignment has, and results go out as
    soon as there are OUT_ROWS of them."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Counts] = {}
        size = 0
        for batch in batches:
            for name, text in zip(batch["alignment_id"], batch["sequence"], strict=True):
                x = codes(text, WIDE)
                for k in range(len(x) // WIDE):
                    own = held.setdefault((name, k), Counts())
                    before = own.size
                    own.add(x[k * WIDE : (k + 1) * WIDE])
                    size += own.size - before
                if size > HELD_BYTES:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    def sent(held: dict[tuple, Counts]) -> Iterator[pd.DataFrame]:
        rows = []
        for (name, k), counts in held.items():
            rows += [(name, k, residue, data) for residue, data in counts.parts()]
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=["alignment_id", "stretch", "residue", "data"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["alignment_id", "stretch", "residue", "data"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, out, rows = None, None, [], 0
        for batch in batches:
            for name, k, residue, data in zip(batch["alignment_id"], batch["stretch"], batch["residue"], batch["data"], strict=True):
                if (name, k) != key:
                    if own is not None:
                        out.append(told(*key, *own.summary()))
                        rows += len(out[-1])
                    if rows >= OUT_ROWS:
                        yield pd.concat(out)
                        out, rows = [], 0
                    key, own = (name, k), Counts()
                own.take(residue, data)
        if own is not None:
            out.append(told(*key, *own.summary()))
            yield pd.concat(out)

    kind = dict(alignment.dtypes)["alignment_id"]
    rows = alignment.where(F.length("sequence") > 0).select("alignment_id", "sequence")
    parts = rows.mapInPandas(add_up, f"alignment_id {kind}, stretch int, residue int, data binary")
    parts = parts.repartition("alignment_id", "stretch").sortWithinPartitions("alignment_id", "stretch")
    return parts.mapInPandas(merge, f"alignment_id {kind}, {schema}")


#: Positions of reads whose sums a task holds at a time.
BLOCK = 1 << 16


def position_sums(reads: DataFrame) -> DataFrame:
    """position (from 1), reads, bases, gc, qualities, quality (sum, Phred+33) and q30, per task and block of positions."""
    names = ("reads", "bases", "gc", "qualities", "quality", "q30")

    def rows_of(block: int, sums: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(sums[0])
        return pd.DataFrame({"position": at + block * BLOCK + 1} | {n: s[at] for n, s in zip(names, sums, strict=True)})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seq, qual in zip(batch["seq"], batch["qual"], strict=True):
                n = max(len(seq or ""), len(qual or ""))
                for block in range(-(-n // BLOCK)):
                    if block not in held and len(held) >= 16:
                        for k in list(held):
                            yield rows_of(k, held.pop(k))
                    sums = held.setdefault(block, np.zeros((len(names), BLOCK), np.int64))
                    cut = slice(block * BLOCK, (block + 1) * BLOCK)
                    s, q = (np.frombuffer((x or "")[cut].encode("utf-32-le", "surrogatepass"), "<u4") for x in (seq, qual))
                    sums[0, : max(len(s), len(q))] += 1
                    sums[1, : len(s)] += 1
                    sums[2, : len(s)] += np.isin(s, [ord(c) for c in "GCgc"])
                    sums[3, : len(q)] += 1
                    sums[4, : len(q)] += q.astype(np.int64) - 33
                    sums[5, : len(q)] += q >= 63
        for k in list(held):
            yield rows_of(k, held.pop(k))

    return reads.select("seq", "qual").mapInPandas(add_up, "position long, " + ", ".join(f"{n} long" for n in names))
