"""Spelling variants, by dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Where the longer has b code points,
that is so just if they differ and their common prefix and common suffix together reach b - 1; then one of the two reaches
half of it. So words are dealt into groups by their first, and by their last, half: a group of `b` holds words of b and b - 1
code points. The words of a task, sorted by group, stand in blocks as padded matrices of code points, from the left and from the
right; a block is compared with itself and with those after it as long as its last group goes on, all pairs at once, a column
at a time. A pair that the prefix group has found is not counted again in the suffix group. Groups of over TILE words are cut
into tiles, and each pair of tiles is a group of its own.

Pairs never leave the task: it adds up, per word, the number of near words and the best one. A word's form is its near word with
the largest n (ties: the smallest) if that is `times` its own n or more; roots follow forms by doubling steps, as n grows
with each.

Cases: null text has no words. A text of any length is read whole, piece by piece. A null doc_id counts as empty text in the hash.
Rows that share a doc_id are texts of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, only, saved

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
PIECE_CHARS = 1 << 20
#: Distinct words that a task adds up before it hands them on.
HELD_WORDS = 1 << 17
#: Words of a tile, and rows of a block.
TILE, BLOCK = 4096, 256
PARTIAL = "word string, n_near long, best struct<minus:long,form:string>"


def runs_of(text: str | None) -> Counter:
    """The lower-cased runs of the whole text and how often each occurs."""
    lowered = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    found, start = Counter(), 0
    while len(lowered) - start > PIECE_CHARS and (cut := BREAK.search(lowered, start + PIECE_CHARS)):
        found.update(RUN.findall(lowered, start, cut.start()))
        start = cut.start()
    found.update(RUN.findall(lowered, start))
    return found


def slipped(doc_id: int | None, run: str, head: int, every: int) -> str:
    """The run, without one code point where the hash of doc_id and run says so. head: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), head)
    if h % every:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def word_counts(docs: DataFrame, every: int, least_length: int, least_count: int) -> DataFrame:
    """word, n: the words of at least `least_length` code points that occur at least `least_count` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                head = zlib.crc32(b":" if doc_id is pd.NA else b"%d:" % doc_id)
                for word, n in runs_of(text).items():
                    if len(word) >= least_length:
                        word = slipped(doc_id, word, head, every)
                        if len(word) >= least_length:
                            total[word] += n
            if len(total) > HELD_WORDS:
                yield pd.DataFrame({"word": total.keys(), "n": total.values()})
                total.clear()
        if total:
            yield pd.DataFrame({"word": total.keys(), "n": total.values()})
        total = None
        give_back()

    parts = only(docs, "doc_id", "text").mapInPandas(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grouped(words: DataFrame) -> DataFrame:
    """word, n under each of its groups: b (code points of the longer word of a pair), suffix (0: by first half, 1: by last), part (that
    half), a and c (the pair of tiles), second (the word is in the second tile of two different ones)."""
    length = F.char_length("word")

    def key(b, suffix: int):
        half = F.floor(b / 2).cast("int")
        part = F.expr("right(word, half)") if suffix else F.expr("left(word, half)")
        return words.select("word", "n", b.alias("b"), F.lit(suffix).alias("suffix"), half.alias("half")).withColumn("part", part).drop("half")

    rows = key(length, 0).union(key(length + 1, 0)).union(key(length, 1)).union(key(length + 1, 1))
    sizes = rows.groupBy("b", "suffix", "part").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["b", "suffix", "part"]).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = F.least("own", "other").alias("a"), F.greatest("own", "other").alias("c")
    return rows.select("b", "suffix", "part", *tiles, (F.col("own") > F.col("other")).alias("second"), "word", "n")


def matrix(words: list[str], right: bool) -> np.ndarray:
    """Code points, one row a column of all words; padded with 0 after the words, or before them."""
    longest = max(map(len, words))
    text = "".join(w.rjust(longest, "\0") if right else w.ljust(longest, "\0") for w in words)
    return np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), longest).T)


def common(x: np.ndarray, y: np.ndarray, order: range) -> np.ndarray:
    """How many columns, taken in `order`, agree from the first on: rows of x against rows of y."""
    alive = np.ones((x.shape[1], y.shape[1]), bool)
    out = np.zeros(alive.shape, np.uint16)
    for c in order:
        alive &= x[c][:, None] == y[c][None, :]
        if not alive.any():
            break
        out += alive
    return out


class Block:
    """Rows of a sorted task as padded matrices."""

    def __init__(self, rows: pd.DataFrame, group: np.ndarray):
        words = rows["word"].tolist()
        self.group, self.length = group, np.array([len(w) for w in words], np.int64)
        self.b, self.suffix = rows["b"].to_numpy(np.int64), rows["suffix"].to_numpy(np.int64)
        self.second, self.cross = rows["second"].to_numpy(bool), (rows["a"] != rows["c"]).to_numpy()
        self.left, self.right = matrix(words, False), matrix(words, True)


def near(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that are one edit apart and of one group."""
    wide = max(len(x.left), len(y.left))
    pad = lambda m, front: np.pad(m, ((wide - len(m), 0) if front else (0, wide - len(m)), (0, 0)))
    prefix = common(pad(x.left, False), pad(y.left, False), range(wide))
    suffix = common(pad(x.right, True), pad(y.right, True), range(wide - 1, -1, -1))
    longer = np.maximum(x.length[:, None], y.length[None, :])
    hit = (x.group[:, None] == y.group[None, :]) & (longer == x.b[:, None]) & (abs(x.length[:, None] - y.length[None, :]) <= 1)
    hit &= (prefix.astype(np.int64) + suffix >= longer - 1) & ((x.suffix == 0)[:, None] | (prefix < (x.b // 2)[:, None]))
    hit &= (~x.cross)[:, None] | (x.second[:, None] != y.second[None, :])
    if x is y:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def best_of(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """Per word: the number of pairs that it is in, and the largest n among its partners with the smallest such word."""
    of, other = np.concatenate([x, y]), np.concatenate([y, x])
    if not len(of):
        return pd.DataFrame({"word": [], "n_near": [], "best": []}, dtype=object)
    names, places = np.unique(rows["word"].to_numpy(object), return_inverse=True)
    n = rows["n"].to_numpy(np.int64)
    of, other, other_n = places[of], places[other], n[other]
    order = np.lexsort((other, -other_n, of))
    of, other, other_n = of[order], other[order], other_n[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    best = [{"minus": -int(v), "form": names[k]} for v, k in zip(other_n[first], other[first], strict=True)]
    return pd.DataFrame({"word": names[of[first]], "n_near": np.diff(np.append(first, len(of))), "best": best})


def tiled(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of PARTIAL from whole groups, sorted by group."""
    keys = rows[["b", "suffix", "part", "a", "c"]]
    group = np.cumsum((keys != keys.shift()).any(axis=1).to_numpy())
    blocks = [Block(rows.iloc[i : i + BLOCK], group[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
    found = []
    for i, x in enumerate(blocks):
        for j in range(i, len(blocks)):
            if blocks[j].group[0] > x.group[-1]:
                break
            p, q = near(x, blocks[j])
            found.append((p + i * BLOCK, q + j * BLOCK))
    return best_of(rows, np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (the near word with the largest n; ties: the smallest) of the words (word, n) that have any."""
    key = ["b", "suffix", "part", "a", "c"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < 2 * TILE:
                continue
            last = np.flatnonzero((held[key] != held[key].iloc[-1]).any(axis=1).to_numpy())
            if len(last):  # the last group may go on in the next batch
                yield tiled(held.iloc[: last[-1] + 1].reset_index(drop=True))
                held = held.iloc[last[-1] + 1 :].reset_index(drop=True)
        if held is not None and len(held):
            yield tiled(held)

    dealt = grouped(words)
    parts = dealt.repartition(*key).sortWithinPartitions(*key, "word").mapInPandas(run, PARTIAL)
    out = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form) that hold no circle: forms are followed to the last, twice as far each round."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = saved(after, "roots")
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = saved(word_counts(docs, every, least_length, least_count), "words")
    found = saved(near_words(words), "near-words")
    has_form = F.col("best_n") >= F.lit(times) * F.col("n")
    out = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    out = saved(out, "forms")
    last = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
