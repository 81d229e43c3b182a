"""Counting 64-bit keys of a whole corpus in compact blocks.

A task turns each chunk of documents into keys (of word windows, shingles or anchors) and deals them into hash buckets: one
row per (chunk, bucket) holds all of them, packed. A bucket sees every key of its hash range, so it can count keys over
the corpus, and answers each chunk with the entries that matter. Chunks then put the answers together by document. What
is shuffled is a few bytes per key. Callers leave out what they can settle inside a chunk; the rest is sent key by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import CHUNK_BYTES, chunks, give_back, mixed

ROW = "bucket int, chunk long, kind string, a binary, b binary, c binary"
#: Entries that one bucket should hold, and the fewest bits of the key that choose the bucket.
BUCKET_KEYS, LEAST_BITS = 1 << 20, 6

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Seeds and multipliers of two hashes of words, and the base of a second hash of windows.
SEED, OTHER, OTHER2 = 0x243F6A8885A308D3, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: Words of more bytes are hashed one by one, by BLAKE2b.
LONG_WORD = 512
#: Arrays with fewer entries are not compressed on their own.
SMALL = 48


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; tables are kept by rounded size."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], by differences of one prefix sum of values times powers."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse(base), len(values) + 1)[starts]


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~SPACE[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A 64-bit hash per word: eight bytes at a time are mixed in, each bit into all others, so that words that repeat a pattern
    are told apart like any others. Long words go through BLAKE2b."""
    sizes = ends - starts
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    at_each_byte = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mixed(sizes.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed))
    live = np.flatnonzero(sizes <= LONG_WORD)
    done = 0
    while len(live):
        left = np.minimum(sizes[live] - done, 8).astype(np.uint64)
        part = at_each_byte[starts[live] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        out[live] = mixed(out[live] ^ (mixed(part + np.uint64(seed)) * np.uint64(seed | 1)))
        done += 8
        live = live[sizes[live] > done]
    for i in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def window_keys(hashes: np.ndarray, k: int, base: int = BASE2) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mixed(rolling(hashes, at, at + k, base) + np.uint64(k))


class Words:
    """The words of a chunk of texts: hashes of all words, and where each text's words begin."""

    def __init__(self, texts: list[str | None], lowered: bool = False, twice: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        buffer = LOWERED[buffer] if lowered else buffer
        ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
        starts, ends = word_spans(buffer)
        self.hashes = word_hashes(buffer, starts, ends)
        self.others = word_hashes(buffer, starts, ends, OTHER) if twice else None
        self.first = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]).astype(np.int64)
        self.counts = np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all windows of k words inside one text, the index of their first word, and their text."""
        keys = window_keys(self.hashes, k)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.arange(len(keys))
        keep = text[: len(keys)] == text[k - 1 :] if len(keys) else np.zeros(0, bool)
        return keys[keep], at[keep], text[: len(keys)][keep]


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray, delta: bool = False) -> bytes:
    """A whole-number array; its bytes are compressed plane by plane."""
    x = np.ascontiguousarray(x)
    y = np.diff(x, prepend=x.dtype.type(0)) if delta else x
    if len(x) < SMALL:
        return bytes([x.itemsize | 128]) + y.tobytes()
    return bytes([x.itemsize]) + _packer.compress(y.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    size = data[0]
    if size & 128:
        x = np.frombuffer(data, dtype, offset=1)
    else:
        planes = np.frombuffer(_unpacker.decompress(data[1:]), np.uint8)
        x = np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if delta else x


def joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def parted(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def packed_runs(values: np.ndarray, dtype=np.int64) -> bytes:
    """An array with long runs of equal values: the values and how often each stands."""
    starts, sizes = group_sizes(values)
    return joined(packed(values[starts].astype(dtype), True), packed(sizes.astype(np.uint32)))


def unpacked_runs(data: bytes, dtype=np.int64) -> np.ndarray:
    values, sizes = parted(data)
    return np.repeat(unpacked(values, dtype, True), unpacked(sizes, np.uint32))


def packed_keys(keys: np.ndarray, bits: int, width: int) -> bytes:
    """`width` bytes of each key, below the `bits` that its bucket tells."""
    rest = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_keys(data: bytes, bucket: int, bits: int, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    rest = out.view("<u8").ravel().astype(np.uint64)
    return (np.uint64(bucket) << np.uint64(64 - bits)) | (rest << np.uint64(64 - 8 * width) >> np.uint64(bits))


def bits_for(n_keys: float) -> int:
    """Bits that choose the bucket, for about BUCKET_KEYS keys in each."""
    return max(LEAST_BITS, min(24, int(np.ceil(np.log2(max(n_keys, 1) / BUCKET_KEYS)))))


def dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its keys in their order)."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)) if bits <= 12 else None
    if edges is None:
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        edges = np.append(cuts, len(order))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(bucket[order[a]]), order[a:b]
        return
    for k in range(1 << bits):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def blocks(docs: DataFrame, make: Callable[[pd.DataFrame], Iterator[tuple]], bits: int, limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ROW. make(chunk) yields (bucket, kind, a, b, c); a bucket of -1 stands for the chunk itself: such rows pass
    the buckets unread. A chunk's number comes from its task and place, both fixed by the scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, chunk in enumerate(chunks(batches, limit=limit)):
            number = (TaskContext.get().partitionId() << 32) | i
            rows = [((1 << bits) + number % 31 if bucket < 0 else bucket, number, kind, a, b, c) for bucket, kind, a, b, c in make(chunk)]
            for at in range(0, len(rows), 64):
                yield pd.DataFrame(rows[at : at + 64], columns=["bucket", "chunk", "kind", "a", "b", "c"])

    return docs.mapInPandas(run, ROW)


def answered(rows: DataFrame, answer: Callable[[int, pd.DataFrame], Iterator[tuple]], bits: int) -> DataFrame:
    """Rows (chunk, kind, a, b, c): answer(bucket, its rows) yields them for each bucket; rows for a chunk pass through."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 1 << bits:
            return group[["chunk", "kind", "a", "b", "c"]]
        out = pd.DataFrame(list(answer(int(key[0]), group)), columns=["chunk", "kind", "a", "b", "c"])
        give_back()
        return out

    return rows.groupBy("bucket").applyInPandas(run, "chunk long, kind string, a binary, b binary, c binary")


def by_chunk(rows: DataFrame, put_together: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """put_together(all rows of a chunk), for each chunk."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = put_together(group)
        give_back()
        return out

    return rows.groupBy(F.col("chunk")).applyInPandas(run, schema)


def group_sizes(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_keys)))
