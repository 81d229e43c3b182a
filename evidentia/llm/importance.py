"""Importance resampling towards a target text, by bit-sliced sums.

A document's features are all runs of 1 to `ngrams` consecutive words; each falls into one of `buckets` hash buckets. Its
counts are kept as bit planes: bit j of plane i is bit i of the count of bucket j. Every bucket has a whole-number gain, the
scaled logarithm of how much likelier it is in the target than in the corpus; gains are planes as well, of positive and of
negative ones. So a document's sum of gains is exact and needs no multiplication of counts:

    sum over i, k of 2**(i + k) * (popcount(count plane i & positive plane k) - popcount(count plane i & negative plane k))

Texts are read once, into a written table of planes that also has each task's sums of counts. Gains are made of `buckets` sums,
the only rows that come to the driver. The documents that are drawn are ranked by ranges of (score, doc_id), so no task sees
all of them.

Cases: null, empty and wordless texts have no features and weight 0. A text of any length is read whole, piece by piece. A null
doc_id is written as empty text in the hash and comes last among ties; rows that share a doc_id are told apart by their sizes
and weights, and equal rows by their place, so repeated rows are drawn one by one. An empty table gives an empty result, an
empty target gains that depend on the corpus alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, only, saved

#: A-Z become small, every other ASCII character but digits and small letters parts words.
FOLDED = bytes(i + 32 if 65 <= i < 91 else i if i >= 128 or 48 <= i < 58 or 97 <= i < 123 else 32 for i in range(256))
PIECE_BYTES = 1 << 20
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Documents whose planes are held against the gains at once.
ROWS = 256
PLANES = "row long, doc_id long, n_words long, n_features long, planes binary, totals binary"


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of the whole text, a piece of it at a time."""
    data, start = (text or "").encode("utf-8", "surrogatepass"), 0
    while len(data) - start > PIECE_BYTES and (cut := BREAK.search(data, start + PIECE_BYTES)):
        yield data[start : cut.start()].translate(FOLDED).split()
        start = cut.start()
    yield data[start:].translate(FOLDED).split()


def bucket_counts(text: str | None, buckets: int, ngrams: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words; the buckets that the text's features fall into and how many fall into each."""
    found, tail, n_words = Counter(), [], 0
    for words in word_lists(text):
        n_words += len(words)
        found.update(words)
        if ngrams > 1:
            run = tail + words
            for k in range(2, ngrams + 1):
                first = max(0, len(tail) - k + 1)
                found.update(b" ".join(run[i : i + k]) for i in range(first, len(run) - k + 1))
            tail = run[-(ngrams - 1) :]
    at = np.fromiter((zlib.crc32(w) % buckets for w in found), np.int64, len(found))
    own, where = np.unique(at, return_inverse=True)
    counts = np.zeros(len(own), np.int64)
    np.add.at(counts, where, np.fromiter(found.values(), np.int64, len(found)))
    return n_words, own, counts


def width(buckets: int) -> int:
    """Bytes of a plane: whole 64-bit words."""
    return -(-buckets // 64) * 8


def planes_of(own: np.ndarray, counts: np.ndarray, buckets: int) -> bytes:
    """Bit planes of the counts, the lowest first; none where all are zero."""
    out = []
    for i in range(int(counts.max()).bit_length() if len(counts) else 0):
        marks = np.zeros(width(buckets) * 8, np.uint8)
        marks[own[(counts >> i) & 1 == 1]] = 1
        out.append(np.packbits(marks).tobytes())
    return b"".join(out)


def as_planes(data: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(-1, width(buckets) // 8)


def count_planes(rows: DataFrame, buckets: int, ngrams: int) -> DataFrame:
    """Rows of PLANES for rows (doc_id, text): one per document, numbered by task and place, and one per task with the sums of its
    counts as `totals`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, number = np.zeros(buckets, np.int64), TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                out, part = [], batch.iloc[at : at + ROWS]
                for doc_id, text in zip(part["doc_id"].astype("Int64"), part["text"], strict=True):
                    n_words, own, counts = bucket_counts(text, buckets, ngrams)
                    totals[own] += counts
                    out.append((number, doc_id, n_words, int(counts.sum()), planes_of(own, counts, buckets), None))
                    number += 1
                yield pd.DataFrame(out, columns=["row", "doc_id", "n_words", "n_features", "planes", "totals"])
        if totals.any():
            yield pd.DataFrame({"row": [None], "doc_id": [None], "n_words": [None], "n_features": [None], "planes": [None], "totals": [totals.tobytes()]})
        give_back()

    return rows.mapInPandas(run, PLANES)


def bucket_sums(planes: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all documents, one number per bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch["totals"]:
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    out = np.zeros(buckets, np.int64)
    parts = planes.where("totals IS NOT NULL").select("totals").mapInPandas(run, "bucket int, n long")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln ((t + 1) (S + B) / ((s + 1) (T + B)))) in doubles."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of the gains' bits."""
    out, every = [], np.arange(len(gain))
    for sign in (1, -1):
        part = np.maximum(sign * gain, 0)
        planes = as_planes(planes_of(every, part, len(gain)), len(gain)) if part.any() else ()
        out += [(sign << k, plane) for k, plane in enumerate(planes)]
    return out


def gain_sums(planes: list[bytes], gain: list[tuple[int, np.ndarray]], buckets: int) -> list[int]:
    """Each document's exact sum of gains over its features."""
    each = [as_planes(x, buckets) for x in planes]
    sizes = np.array([len(x) for x in each])
    if not sizes.sum():
        return [0] * len(planes)
    stacked = np.concatenate(each)
    per_plane = np.zeros(len(stacked), np.int64)
    for power, plane in gain:
        per_plane += power * np.bitwise_count(stacked & plane).sum(1, dtype=np.int64)
    ends, out = np.cumsum(sizes), []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        out.append(sum(int(v) << i for i, v in enumerate(per_plane[end - size : end])))
    return out


def weighed(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features and weight, the floored mean of gains, of every document."""
    buckets, shared = len(gain), planes.sparkSession.sparkContext.broadcast(gain_planes(gain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = []
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                sums = gain_sums(part["planes"].tolist(), shared.value, buckets)
                weights += [s // n if n else 0 for s, n in zip(sums, part["n_features"].tolist(), strict=True)]
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), weight=weights).drop(columns="planes")

    rows = planes.where("totals IS NULL").select("row", "doc_id", "n_words", "n_features", "planes")
    return rows.mapInPandas(run, "row long, doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A whole number with a Gumbel distribution, told by the seed and doc_id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored with `rank`: 1, 2, ... for the `percent` of the rows with the highest scores (ties to the smaller doc_id), else
    null. Rows are dealt into ranges and numbered inside each; only the ranges' sizes come to the driver."""
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), part=part, place=np.arange(n + 1, n + 1 + len(batch)))
            n += len(batch)

    schema = ", ".join(f"{n} long" for n in scored.columns) + ", part int, place long"
    rows = saved(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(numbered, schema), "ranges")
    sizes = sorted(rows.groupBy("part").count().collect())  # one row per range
    before = np.cumsum([0] + [n for _, n in sizes])
    most = int(before[-1]) * percent // 100
    starts = F.lit(0).cast("long")
    if sizes:
        starts = F.create_map(*(F.lit(x) for (part, _), b in zip(sizes, before.tolist(), strict=False) for x in (part, b)))[F.col("part")]
    rank = (starts + F.col("place")).cast("long")
    return rows.select(*scored.columns, F.when(rank <= most, rank).alias("rank"))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10000,
    ngrams: int = 1,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document. target: a table with a text column that the draw should
    look like. Of the N documents with `least_words` words or more, floor(percent N / 100) are drawn without replacement."""
    own = saved(count_planes(only(docs, "doc_id", "text"), buckets, ngrams), "planes")
    aim = saved(count_planes(only(target, "text").select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, ngrams), "target-planes")
    gain = gains(bucket_sums(own, buckets), bucket_sums(aim, buckets))
    rows = weighed(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = saved(rows, "scored")
    out = ranked(rows.where(F.col("n_words") >= least_words), percent)
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
