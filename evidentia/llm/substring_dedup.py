"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted over the corpus.

A window is repeated if its word sequence also starts in a document with a smaller doc_id. Repeated windows of a document
merge into maximal removal intervals. A window is told by two Rabin-Karp hashes of 64 bits each with different bases, over words
that are hashed twice as well, by mixing and not by polynomials: the first chooses the bucket, and both together the key in it.
Two different windows are taken for one with odds of about 2^-(64 + n) a pair in n bits of buckets; a window that repeats a pattern
of words can take some 20 bits off each Rabin-Karp hash, as polynomials modulo 2^64 do.

Cases: null text has no words; a text shorter than the window loses nothing; a null doc_id counts as larger than all
others and null ids do not compare with each other; rows with one doc_id never remove each other's windows, equal rows get
equal results. An empty table gives an empty result. A text of any length is read whole, in one task. A unit's rows must come in the
same order when a lost task runs again, as those of a written table do. Other columns of the input are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import keyblocks as kb
from evidentia.llm.common import text_bytes, with_row_key

#: Bytes of text whose windows are dealt out together.
UNIT_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
SPANS = "_rid long, _did long, spans array<int>"


def merged_runs(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [a, a + length) for a in the sorted array `at`."""
    if not len(at):
        return at, at
    first = np.concatenate([[True], at[1:] > at[:-1] + length])
    starts = at[first]
    ends = at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)] + length
    return starts, ends


def first_hash(words: kb.Words, window: int) -> np.ndarray:
    return kb.window_keys(words.hashes, window)


def second_hash(words: kb.Words, window: int) -> np.ndarray:
    return kb.window_keys(words.others, window, kb.OTHER2)


def repeated_windows(docs: DataFrame, window: int, n_bytes: int, hashes: tuple = (first_hash, second_hash)) -> DataFrame:
    """_rid, _did, spans (word offsets start, end, start, end, ...) of the documents that lose words.
    docs: with_row_key(); hashes: the two independent hashes of all windows of a chunk's words."""
    bits = kb.bits_for(n_bytes / 6)

    def make(chunk: pd.DataFrame) -> Iterator[tuple]:
        ids = chunk["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, rids = ids[order], chunk["_rid"].to_numpy(np.int64)[order]
        words = kb.Words([chunk["text"].iloc[i] for i in order], twice=True)
        _, at, text = words.windows(window)
        first, second = (f(words, window)[at] for f in hashes)
        keys = first ^ second
        # the smallest id of each key within the chunk; all other documents are met here
        sort = np.argsort(keys, kind="stable")
        starts, sizes = kb.group_sizes(keys[sort])
        least = np.empty(len(keys), np.int64)
        least[sort] = np.repeat(ids[text[sort]][starts] if len(starts) else starts, sizes)
        later = ids[text] > least
        yield -1, "docs", kb.packed(ids), kb.packed(rids), kb.packed(words.first[:-1])
        yield -1, "found", kb.packed(at[later].astype(np.uint32), True), None, None
        first, keys, at, text = first[~later], keys[~later], at[~later], text[~later]
        for bucket, own in kb.dealt(first, bits):
            yield bucket, "keys", kb.packed_keys(keys[own], 0, 8), kb.packed(at[own].astype(np.uint32), True), kb.packed_runs(ids[text[own]])

    def answer(bucket: int, group: pd.DataFrame) -> Iterator[tuple]:
        keys = [np.frombuffer(a, "<u8") for a in group["a"]]
        docs_of = [kb.unpacked_runs(c) for c in group["c"]]
        at = [kb.unpacked(b, np.uint32, True) for b in group["b"]]
        piece = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, doc, at = np.concatenate(keys), np.concatenate(docs_of), np.concatenate(at)
        sort = np.argsort(key, kind="stable")
        starts, sizes = kb.group_sizes(key[sort])
        least = np.empty(len(key), np.int64)
        least[sort] = np.repeat(np.minimum.reduceat(doc[sort], starts), sizes)
        hit = np.flatnonzero(doc > least)
        for p in np.unique(piece[hit]):
            yield int(group["chunk"].iloc[p]), "found", kb.packed(at[hit[piece[hit] == p]], True), None, None

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["kind"] == "docs"].iloc[0]
        ids, rids, first = (kb.unpacked(head[c], np.int64) for c in "abc")
        found = np.sort(np.concatenate([kb.unpacked(a, np.uint32, True) for a in group.loc[group["kind"] == "found", "a"]])).astype(np.int64)
        text = np.searchsorted(first, found, side="right") - 1
        # a text without words shares its start with the next text, which owns the window
        rows, (starts, sizes) = [], kb.group_sizes(text)
        for s, n in zip(starts, sizes, strict=True):
            t = text[s]
            a, b = merged_runs(found[s : s + n] - first[t], window)
            rows.append((rids[t], ids[t], np.stack([a, b], 1).ravel().astype(np.int32)))
        return pd.DataFrame(rows, columns=["_rid", "_did", "spans"])

    blocks = kb.blocks(docs, make, bits, UNIT_BYTES)
    return kb.by_chunk(kb.answered(blocks, answer, bits), put_together, SPANS).dropDuplicates(["_rid", "_did"])


def substring_dedup(docs: DataFrame, window: int = 50, hashes: tuple = (first_hash, second_hash)) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word offsets start, end, ...; empty where none) and kept_text (the
    words left, joined by one space) of every whole text."""
    rows = with_row_key(docs)
    spans = repeated_windows(rows, window, text_bytes(docs), hashes)
    both = rows.withColumn("_did", F.coalesce("doc_id", F.lit(NO_ID))).join(spans, ["_rid", "_did"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["spans"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                own, kept, last = [] if own is None else list(map(int, own)), [], 0
                for a, b in zip(own[::2], own[1::2], strict=True):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((doc_id, len(words), len(words) - len(kept), own, b" ".join(kept).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return both.select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_words long, n_removed long, spans array<int>, kept_text string")
