"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts writes compact passages: which words of the benchmark (lower-cased, punctuation left out) stand
   where in each document. All later steps read this table, a few bytes per known word, and never the texts again.
2. A distributed randomised SVD of the TF-IDF passages (blocks of BLOCK words) over all words of the items: frequencies and the
   product A'A G with a random G are summed up over the corpus in one pass, and a Nystrom step gives the leading right
   singular vectors. The items' own directions are joined to them, so an inner product with an item is exact in the space.
3. Each window (three blocks, stepped by one; block lengths follow the items' lengths) is held against every item by cosine in the
   latent space, as a matrix product. A pair is a candidate if its cosine reaches the least that a leak of this item can have
   in a window of that length: the projection of the item's `needed` least weighty words. So no leak is lost by the search,
   however common the words that it kept.
4. A candidate counts as a leak if in some stretch of about the item's length the longest common subsequence of words covers
   enough of the item, and enough of its answer (its last sentence; the items have no answers of their own), or nearly all
   of the item. Every stretch is judged, so the result is that of brute force over all pairs.

Cases: null or wordless items and documents match nothing; an item of one word matches every document that holds the word;
repeated rows and items with equal texts are matched each; of stretches that tie, the first counts; very long texts are
searched slice by slice; an empty benchmark or table gives an empty result; a null doc_id or item_id stays null. Other
columns are ignored. The benchmark is the stated query set: it is refused beyond MOST_BYTES, and taken in batches of at most
MOST_ITEMS items and MOST_WORDS words (or one item), which bound every matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import keyblocks as kb
from evidentia.llm.common import chunks, give_back, only, saved, summed

#: Words of a passage of the latent space, and the fewest words of a block of the search.
BLOCK, LEAST_BLOCK = 32, 8
MOST_BYTES, MOST_ITEMS, MOST_WORDS = 64 << 20, 512, 1 << 15
#: Blocks that are searched at a time, and the frequent words that are summed up as a dense matrix.
AT_ONCE, DENSE = 4096, 128
#: Lower-cased letters and digits; every other ASCII character separates words.
PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)], np.uint8)
COMPACT = "ids binary, first binary, at binary, number binary"
LEAKS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


class Tokens:
    """Word hashes of several texts, and where each text's words begin."""

    def __init__(self, texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buffer = PLAIN[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        starts, ends = kb.word_spans(buffer)
        self.hashes = kb.word_hashes(buffer, starts, ends)
        self.first = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))]).astype(np.int64)


@dataclass
class Vocabulary:
    """The benchmark's words by hash; a table on the low bits finds most of the others at once."""

    words: np.ndarray
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of known words, and their numbers."""
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        number = np.searchsorted(self.words, hashes[at])
        number[number == len(self.words)] = 0
        good = self.words[number] == hashes[at]
        return at[good], number[good]


def compact_passages(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """COMPACT, one row per chunk of documents: ids (and which are null), where each text's words begin, and place and
    number of every known word."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches):
            tokens, ids = Tokens(chunk["text"]), chunk["doc_id"].astype("Int64")
            at, number = known.value.find(tokens.hashes)
            both = kb.joined(kb.packed(ids.fillna(0).to_numpy(np.int64)), kb.packed(ids.isna().to_numpy(np.uint8)))
            yield pd.DataFrame({
                "ids": [both],
                "first": [kb.packed(tokens.first, True)],
                "at": [kb.packed(at.astype(np.uint32), True)],
                "number": [kb.packed(number.astype(np.uint32))],
            })

    return docs.mapInPandas(compact, COMPACT)


@dataclass
class Passages:
    """A row of COMPACT, with its words renumbered; words without a new number are left out."""

    first: np.ndarray
    at: np.ndarray
    number: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, first: bytes, at: bytes, number: bytes, renumber: np.ndarray) -> Passages:
        first, at = kb.unpacked(first, np.int64, True), kb.unpacked(at, np.uint32, True).astype(np.int64)
        number = renumber[kb.unpacked(number, np.uint32)]
        at, number = at[number >= 0], number[number >= 0]
        return cls(first, at, number.astype(np.int64), np.searchsorted(first, at, side="right") - 1)

    def blocks(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each word, and the text of each block; blocks lie within one text."""
        count = -(-np.diff(self.first) // size)
        base = np.cumsum(count) - count
        return base[self.text] + (self.at - self.first[self.text]) // size, np.repeat(np.arange(len(count)), count)


def sums_by(key: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Sum of vectors by key; keys ascend."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if len(key):
        starts, _ = kb.group_sizes(key)
        out[key[starts]] = np.add.reduceat(vectors, starts, axis=0)
    return out


def block_vectors(block: np.ndarray, number: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sum of the words' rows of basis by block: a matrix product for the words with the lowest numbers, which are the most
    frequent, and a sum of rows for the others."""
    dense = min(DENSE, len(basis))
    often = number < dense
    counts = np.bincount(block[often] * dense + number[often], minlength=n * dense).reshape(n, dense).astype(np.float32)
    return counts @ basis[:dense] + sums_by(block[~often], basis[number[~often]], n)


def latent_space(table: DataFrame, renumber: np.ndarray, n: int, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """idf of the n words, and the leading right singular vectors (n x rank or fewer) of the passages weighted by it.

    With P the word counts of all passages and G random, P'P G is summed up over the corpus; D = diag(idf) follows from the
    same pass. Then A'A = D P'P D is close to (D P'P G)(G' P'P G)^-1 (D P'P G)', whose eigenvectors are those of A."""
    g = np.random.default_rng(seed).standard_normal((n, min(rank, n))).astype(np.float32)
    shared = table.sparkSession.sparkContext.broadcast((renumber, g))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        renumber, g = shared.value
        for batch in batches:
            for row in batch.itertuples():
                words = Passages.of(row.first, row.at, row.number, renumber)
                block, text = words.blocks(BLOCK)
                out = np.zeros((n + 1, g.shape[1] + 1))
                out[n, 0] = len(text)
                order = np.argsort(words.number, kind="stable")
                number, of_block = words.number[order], block[order]
                # the blocks of a word ascend, so repeats inside a block stand together
                once = np.ones(len(order), bool)
                once[1:] = (number[1:] != number[:-1]) | (of_block[1:] != of_block[:-1])
                out[:n, 0] = np.bincount(number[once], minlength=n)
                for a in range(0, len(text), AT_ONCE):
                    lo, hi = np.searchsorted(block, [a, a + AT_ONCE])
                    own = block[lo:hi] - a
                    pg = sums_by(own, g[words.number[lo:hi]], min(AT_ONCE, len(text) - a))
                    order = np.argsort(words.number[lo:hi], kind="stable")
                    out[:n, 1:] += sums_by(words.number[lo:hi][order], pg[own[order]], n)
                yield out
        give_back()

    total = summed(table.select("first", "at", "number"), product, (n + 1, g.shape[1] + 1))
    df, n_passages, y = total[:n, 0], total[n, 0], total[:n, 1:]
    idf = np.maximum(np.log1p(n_passages) - np.log1p(df), 0.1)
    core = g.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 0) * 1e-7
    factor = idf[:, None] * (y @ vectors[:, keep]) / np.sqrt(values[keep])
    return idf, np.linalg.svd(factor, full_matrices=False)[0]


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks: the places of each word of the one side, as bits."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_start(text: str) -> int:
    """Where the last sentence begins; 0 if there is only one."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    return ends[-1] if ends else 0


def stretch(size: int) -> int:
    """Words of the stretches that are held against an item of `size` words."""
    return size + size // 3 + 4


def block_for(span: int) -> int:
    """The block length for stretches of span words: a stretch that begins in a block ends within the two after it."""
    return max(LEAST_BLOCK, 1 << (span // 2 - 1).bit_length())


@dataclass
class Rule:
    """What makes a stretch a leak."""

    min_share: float
    min_answer: float
    sure_share: float

    def needed(self, size: int) -> int:
        return max(1, int(np.ceil(self.min_share * size - 1e-9)))


@dataclass
class Item:
    """An item by its words' numbers."""

    item_id: int | None
    words: list[int]
    answer: list[int]
    masks: dict[int, int] = field(init=False)
    answer_masks: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.masks, self.answer_masks = masks_of(self.words), masks_of(self.answer)

    def best(self, numbers: list[int], places: list[int], end: int, rule: Rule) -> tuple[float, float] | None:
        """(share, answer share) of the best leaking stretch among those that begin at a word before place `end`. Only the item's
        words are given: others add nothing, and a stretch that begins at one of these words holds all of a stretch
        that begins between them and the word before."""
        size, span, needed = len(self.words), stretch(len(self.words)), rule.needed(len(self.words))
        if common_subsequence(self.masks, size, numbers) < needed:
            return None
        found, stop = None, 0
        for start in range(len(numbers)):
            if places[start] >= end:
                break
            while stop < len(numbers) and places[stop] < places[start] + span:
                stop += 1
            if stop - start < needed:
                continue
            own = numbers[start:stop]
            share = common_subsequence(self.masks, size, own) / size
            if share * size < needed - 0.5 or (found and share < found[0]):
                continue
            answer = common_subsequence(self.answer_masks, len(self.answer), own) / max(1, len(self.answer))
            if (answer >= rule.min_answer or share >= rule.sure_share) and (found is None or (share, answer) > found):
                found = share, answer
        return found


@dataclass
class Band:
    """Items of about one length: their latent space and what a leak of each needs."""

    block: int
    items: list[Item]
    basis: np.ndarray  # words x dimensions: idf times directions
    vectors: np.ndarray  # dimensions x items
    least: np.ndarray  # least projection of a leak on the item, times the item's norm
    present: np.ndarray  # items x words
    needed: np.ndarray

    @classmethod
    def of(cls, block: int, items: list[Item], idf: np.ndarray, leading: np.ndarray, rule: Rule) -> Band:
        present = np.zeros((len(items), len(idf)), bool)
        for i, item in enumerate(items):
            present[i, item.words] = True
        rows = present * idf
        directions = np.linalg.qr(np.hstack([rows.T, leading]))[0]
        needed = np.array([rule.needed(len(item.words)) for item in items])
        # the words that count least; float32 products are off by far less than the margin
        least = np.array([np.sort(idf[item.words] ** 2)[:k].sum() for item, k in zip(items, needed, strict=True)]) * 0.999
        return cls(
            block,
            items,
            (idf[:, None] * directions).astype(np.float32),
            (rows @ directions).T.astype(np.float32),
            least.astype(np.float32),
            present,
            needed,
        )

    def search(self, words: Passages, rule: Rule) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item of the band): (share, answer share, cosine) of the best leak."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        block, text = words.blocks(self.block)
        first_block = np.searchsorted(text, np.arange(len(words.first) - 1))
        norms = np.linalg.norm(self.vectors, axis=0)
        for a in range(0, len(text), AT_ONCE):
            e = min(len(text), a + AT_ONCE + 2)
            edges = np.searchsorted(block, np.arange(a, e + 1))
            lo, hi = edges[0], edges[-1]
            x, of = block_vectors(block[lo:hi] - a, words.number[lo:hi], e - a, self.basis), text[a:e]
            window, last = x.copy(), np.arange(1, e - a + 1)
            for k in (1, 2):
                same = of[k:] == of[:-k]
                window[:-k] += x[k:] * same[:, None]
                last[:-k] += same
            n = min(AT_ONCE, len(text) - a)
            # cosine >= least / (norm of the window * norm of the item), both sides times these norms
            row, item = np.nonzero(window[:n] @ self.vectors >= self.least)
            row, item = self.enough_words(words.number, edges[row], edges[last[row]], row, item)
            for r, i in zip(row.tolist(), item.tolist(), strict=True):
                s, t = edges[r], edges[last[r]]
                own = np.flatnonzero(self.present[i, words.number[s:t]]) + s
                k = int(of[r])
                end = words.first[k] + (a + r + 1 - first_block[k]) * self.block
                found = self.items[i].best(words.number[own].tolist(), words.at[own].tolist(), int(end), rule)
                if found:
                    cosine = float(window[r] @ self.vectors[:, i] / max(np.linalg.norm(window[r]) * norms[i], 1e-12))
                    out[k, i] = max(out.get((k, i), (0.0, 0.0, 0.0)), (*found, min(1.0, cosine)))
        return out

    def enough_words(self, number: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates whose window holds as many words of the item as a leak needs: a first exact check, a few at a time."""
        keep = np.zeros(len(row), bool)
        ends = np.cumsum(stop - start)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) if len(ends) else 0, 1 << 20)), len(row)))
        for b, e in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            size = stop[b:e] - start[b:e]
            if e > b:
                at = np.repeat(start[b:e] - np.cumsum(size) + size, size) + np.arange(size.sum())
                held = self.present[np.repeat(item[b:e], size), number[at]]
                keep[b:e] = np.add.reduceat(held, np.cumsum(size) - size, dtype=np.int32) >= self.needed[item[b:e]]
        return row[keep], item[keep]


def batches_of(words: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of items, a batch at a time: at most MOST_ITEMS items and MOST_WORDS different words, or one item."""
    own, seen = [], np.zeros(0, np.int64)
    for i, w in enumerate(words):
        both = np.union1d(seen, w)
        if own and (len(own) >= MOST_ITEMS or len(both) > MOST_WORDS):
            yield own
            own, both = [], np.unique(w)
        own.append(i)
        seen = both
    if own:
        yield own


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 32, min_share: float = 0.6, min_answer: float = 0.5, sure_share: float = 0.85) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of every leak; the best stretch of each pair of rows."""
    spark, docs, rule = docs.sparkSession, only(docs, "doc_id", "text"), Rule(min_share, min_answer, sure_share)
    texts = only(benchmark, "item_id", "text").where("text IS NOT NULL")
    if (texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) > MOST_BYTES:
        raise ValueError(f"the benchmark has more than {MOST_BYTES} bytes")
    rows = [r for r in texts.collect() if len(Tokens([r["text"]]).hashes)]
    if not rows:
        return spark.createDataFrame([], LEAKS)
    tokens, answers = Tokens([r["text"] for r in rows]), Tokens([r["text"][answer_start(r["text"]) :] for r in rows])
    vocabulary = Vocabulary(np.unique(tokens.hashes))
    number_of = lambda t: [np.searchsorted(vocabulary.words, t.hashes[a:b]) for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
    words, answers = number_of(tokens), number_of(answers)
    table = saved(compact_passages(docs.where("text IS NOT NULL"), vocabulary), "passages")
    found = None
    for batch in batches_of(words):
        known = np.unique(np.concatenate([words[i] for i in batch]))
        renumber = np.full(len(vocabulary.words), -1, np.int32)
        renumber[known] = np.arange(len(known))
        idf, leading = latent_space(table, renumber, len(known), rank)
        often_first = np.argsort(idf, kind="stable")
        idf, leading = idf[often_first], leading[often_first]
        renumber[known[often_first]] = np.arange(len(known))
        items = [Item(rows[i]["item_id"], renumber[words[i]].tolist(), renumber[answers[i]].tolist()) for i in batch]
        by_block: dict[int, list[Item]] = {}
        for item in items:
            by_block.setdefault(block_for(stretch(len(item.words))), []).append(item)
        bands = [Band.of(block, own, idf, leading, rule) for block, own in sorted(by_block.items())]
        some = searched(table, renumber, bands, rule)
        found = some if found is None else found.unionByName(some)
    return found


def searched(table: DataFrame, renumber: np.ndarray, bands: list[Band], rule: Rule) -> DataFrame:
    """LEAKS of the items of all bands."""
    shared = table.sparkSession.sparkContext.broadcast((renumber, bands))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renumber, bands = shared.value
        for batch in batches:
            for row in batch.itertuples():
                words, out = Passages.of(row.first, row.at, row.number, renumber), []
                ids, null = (kb.unpacked(x, t) for x, t in zip(kb.parted(row.ids), (np.int64, np.uint8), strict=True))
                for band in bands:
                    for (k, i), (share, answer, cosine) in band.search(words, rule).items():
                        out.append((None if null[k] else int(ids[k]), band.items[i].item_id, cosine, share, answer))
                if out:
                    yield pd.DataFrame(
                        out,
                        columns=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                    ).astype({"doc_id": "Int64", "item_id": "Int64"})
        give_back()

    return table.mapInPandas(search, LEAKS)
