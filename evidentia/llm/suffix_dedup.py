"""Suffix-array dedup by column-wise construction over many documents.

Every byte covered by a 200-byte string that also starts elsewhere (same document included, overlaps count) is removed.

1. Anchors: each 200-byte window picks the smallest hash of its 32-byte grams, the leftmost where hashes tie. Equal windows
   pick equal anchors at equal offsets. Anchors are counted over the corpus (keyblocks); one that occurs once cannot lie in
   a repeated window. What is left are segments: the windows that picked one repeated anchor.
2. Segments of a hash range form a collection, aligned at their anchors. Its suffix order is built column by column from the
   right: each round inserts one symbol per segment, sorts the suffixes stably by it (the symbols in suffix order are that
   column's Burrows-Wheeler transform) and updates the common prefixes of neighbours. Windows whose common prefix with a
   neighbour reaches 200 are repeated. Columns stand one after the other in the order of the rounds.
   The segments of a frequent anchor are dealt out over several collections, by where they come from; each of those passes
   one of all its equal segments on to fewer collections of the same anchor, until one is left. Segments that have an equal
   one in their collection are repeated as a whole, so they need no later answer.
3. Repeated windows merge into maximal runs per document.

Aligned at anchors, equal strings always meet in one column, so a column keeps its own transform; the merge of all columns
into one transform, which costs the collection's size per round, is not needed.

Cases: null text is empty; texts under 200 bytes lose nothing; equal rows are copies of each other; null doc_ids are kept
apart by their texts. Other columns are left out, but for those to carry; an empty table gives an empty result. Texts are
anchored in slices of about 256 KiB. A chunk's rows must come in the same order when a lost task runs again, as those of a written
table do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import keyblocks as kb
from evidentia.llm.common import chunks, give_back, saved, text_bytes, with_row_key

GRAM = 32
WIDTH = 6
#: Bits of a window's minimum that hold the gram's place in its slice; the rest are its hash.
PLACE_BITS = 22
SLICE = (1 << 18) - (1 << 10)
#: No UTF-8 text holds this byte; it stands for what lies outside a segment.
OUTSIDE = 255
#: Bytes of text per collection, about.
COLLECTION_BYTES = 8 << 20
#: Segments of one anchor that a collection should hold, about; and how many collections pass their segments on to one.
FREQUENT, FAN_IN = 1 << 13, 32
PIECES = "part long, fan int, salt int, rids binary, places binary, data binary"
FOUND = f"_rid long, spans array<int>, {PIECES}"


def sliding_places(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of each w consecutive values; values hold their place in their low bits."""
    n = len(values) - w + 1
    blocks = -(-len(values) // w)
    x = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    x[: len(values)] = values
    x = x.reshape(blocks, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: hash of each anchor, first window start, number of windows, offset of the anchor from the first. An anchor's
    hash is the least of many, so it is mixed again: by its own leading bits nearly all anchors would share a bucket."""
    found = []
    for a in range(0, max(0, len(text) - length + 1), SLICE):
        part = text[a : a + SLICE + length - 1]
        at = np.arange(len(part) - GRAM + 1)
        hashes = kb.mixed(kb.rolling(kb.BYTE_VALUES[part], at, at + GRAM, kb.BASE))
        place = sliding_places((hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | at.astype(np.uint64), length - GRAM + 1)
        starts, sizes = kb.group_sizes(place)
        found.append((kb.mixed(hashes[place[starts]]), starts + a, sizes, place[starts] - starts))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_segments(docs: DataFrame, length: int, n_bytes: int) -> DataFrame:
    """_rid and packed segments (starts, windows, anchor offsets, how often the anchor occurs, hashes) of the documents with
    repeated anchors."""
    bits = kb.bits_for(n_bytes / 80)

    def make(chunk: pd.DataFrame) -> Iterator[tuple]:
        rids = chunk["_rid"].to_numpy(np.int64)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in chunk["text"]]
        ends = np.cumsum([len(r) for r in raw])
        # all texts at once; windows that cross texts are left out afterwards
        hashes, starts, sizes, offsets, text = inside_texts(*anchors(np.frombuffer(b"".join(raw), np.uint8), length), ends, length)
        # anchors of one hash go as one entry with their number; numbered as they appear, so most follow each other
        _, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        appear = np.argsort(first, kind="stable")
        number = np.empty(len(appear), np.uint32)
        number[appear] = np.arange(len(appear))
        keys, times = hashes[first[appear]], times[appear].astype(np.uint32)
        shape = kb.joined(kb.packed(sizes.astype(np.uint8)), kb.packed(offsets.astype(np.uint8)))
        yield -1, "docs", kb.packed(rids), kb.joined(
            kb.packed_runs(text),
            kb.packed(starts.astype(np.int32), True),
        ), kb.joined(kb.packed(number[which], True), shape)
        for bucket, own in kb.dealt(keys, bits):
            yield bucket, "keys", kb.packed_keys(keys[own], bits, WIDTH), kb.packed(own.astype(np.uint32), True), kb.packed(times[own])

    def answer(bucket: int, group: pd.DataFrame) -> Iterator[tuple]:
        keys = [kb.unpacked_keys(a, bucket, bits, WIDTH) for a in group["a"]]
        key, counted = np.concatenate(keys), np.concatenate([kb.unpacked(c, np.uint32) for c in group["c"]])
        sort = np.argsort(key, kind="stable")
        starts, runs = kb.group_sizes(key[sort])
        times = np.empty(len(key), np.int64)
        times[sort] = np.repeat(np.add.reduceat(counted[sort].astype(np.int64), starts), runs)
        at = 0
        for number, own, data in zip(group["chunk"], keys, group["b"], strict=True):
            n = times[at : at + len(own)]
            hit = n > 1
            at += len(own)
            if hit.any():
                yield int(number), "found", kb.packed_keys(own[hit], 0, 8), kb.packed(
                    kb.unpacked(data, np.uint32, True)[hit],
                    True,
                ), kb.packed(np.minimum(n[hit], 1 << 31).astype(np.uint32))

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        head, hits = group[group["kind"] == "docs"].iloc[0], group[group["kind"] == "found"]
        rows = []
        if len(hits):
            rids = kb.unpacked(head["a"], np.int64)
            text, starts = kb.parted(head["b"])
            text, starts = kb.unpacked_runs(text), kb.unpacked(starts, np.int32, True)
            which, shape = kb.parted(head["c"])
            which, (sizes, offsets) = kb.unpacked(which, np.uint32, True), (kb.unpacked(x, np.uint8) for x in kb.parted(shape))
            key = np.concatenate([np.frombuffer(a, "<u8") for a in hits["a"]])
            number = np.concatenate([kb.unpacked(b, np.uint32, True) for b in hits["b"]])
            times = np.concatenate([kb.unpacked(c, np.uint32) for c in hits["c"]])
            place = np.full(int(which.max()) + 1, -1, np.int64)
            place[number] = np.arange(len(number))
            at = np.flatnonzero(place[which] >= 0)
            key, times = key[place[which[at]]], times[place[which[at]]]
            begins, counts = kb.group_sizes(text[at])
            for s, n in zip(begins, counts, strict=True):
                own = at[s : s + n]
                rows.append((
                    rids[text[own[0]]],
                    kb.joined(
                        kb.packed(starts[own], True),
                        kb.joined(kb.packed(sizes[own]), kb.joined(kb.packed(offsets[own]), kb.joined(kb.packed(times[s : s + n]), key[s : s + n].tobytes()))),
                    ),
                ))
        return pd.DataFrame(rows, columns=["_rid", "segments"])

    rows = kb.answered(kb.blocks(docs, make, bits), answer, bits)
    # equal rows have equal segments
    return kb.by_chunk(rows, put_together, "_rid long, segments binary").dropDuplicates(["_rid"])


def inside_texts(hashes, starts, sizes, offsets, ends, length):
    """The parts of runs of windows that lie within one text, with starts counted from its own first byte."""
    first = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, starts, side="right")
    last = starts + sizes - 1
    out = []
    # a run that begins near the end of a text may reach into the texts after it
    while len(starts):
        stop = np.minimum(last, ends[text] - length)
        good = stop >= starts
        out.append((hashes[good], starts[good] - first[text[good]], (stop - starts + 1)[good], offsets[good], text[good]))
        more = (text + 1 < len(ends)) & (last >= ends[text])
        ahead = first[np.minimum(text + 1, len(ends) - 1)] - starts
        hashes, offsets, starts, last, text = hashes[more], (offsets - ahead)[more], (starts + ahead)[more], last[more], text[more] + 1
    if not out:
        return hashes, starts, sizes, offsets, text
    hashes, starts, sizes, offsets, text = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((starts, text))
    return hashes[order], starts[order], sizes[order], offsets[order], text[order]


def neighbours_after(prefix: np.ndarray, order: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Common prefixes of neighbours after one symbol is put in front: 1 + the least old common prefix between them."""
    n = len(order)
    new = np.zeros(n, np.uint8)
    same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] != OUTSIDE)) + 1
    a, b = order[same - 1] + 1, order[same]
    least = prefix[b]
    far = np.flatnonzero(b > a)
    if len(far):
        table = [prefix]
        while (1 << len(table)) <= n:
            half, before = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(before[:-half], before[half:]))
        span = b[far] - a[far] + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = far[level == k]
            least[own] = np.minimum(table[k][a[own]], table[k][b[own] - (1 << int(k)) + 1])
    new[same] = np.minimum(least.astype(np.int16) + 1, length)
    return new


def repeated_in_collection(segments: list[bytes], offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first and last window start in it) of every run of windows that also start in another segment, in order.
    Segments hold whole windows; offsets are those of their anchors."""
    m, reach = len(segments), length - GRAM
    # column after column, in the order of the rounds; a collection is bounded, so they stand in memory and not in a file
    columns = np.full((reach + length, m), OUTSIDE, np.uint8)
    for i, (data, off) in enumerate(zip(segments, offsets, strict=True)):
        columns[reach - off : reach - off + len(data), i] = np.frombuffer(data, np.uint8)
    order, prefix = np.arange(m), np.zeros(m, np.uint8)
    repeated = np.zeros((m, reach + 3), np.int8)  # by window start, between two borders
    for c in range(len(columns) - 1, -1, -1):
        own = columns[c][order]
        stable = np.argsort(own, kind="stable")
        prefix = neighbours_after(prefix, stable, own[stable], length)
        order = order[stable]
        if c <= reach:
            hit = np.flatnonzero(prefix >= length)
            for which in (order[hit], order[hit - 1]):
                repeated[which, c - reach + offsets[which] + 1] = 1
    del columns
    step = np.diff(repeated, axis=1)
    which, first = np.nonzero(step == 1)
    return which, first, np.nonzero(step == -1)[1] - 1


def piece(rids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, segments: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Segments in one row: rids, places, data."""
    places = kb.joined(kb.packed(starts), kb.joined(kb.packed(sizes.astype(np.uint8)), kb.packed(offsets.astype(np.uint8))))
    return kb.packed(rids), places, zstandard.ZstdCompressor(level=1).compress(b"".join(segments))


def unpieced(group: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """What piece() was given, of all rows of a group."""
    rids, starts, sizes, offsets, segments = [], [], [], [], []
    for r, places, data in zip(group["rids"], group["places"], group["data"], strict=True):
        s, rest = kb.parted(places)
        n, o = kb.parted(rest)
        n = kb.unpacked(n, np.uint8).astype(np.int64)
        rids.append(kb.unpacked(r, np.int64))
        starts.append(kb.unpacked(s, np.int64))
        sizes.append(n)
        offsets.append(kb.unpacked(o, np.uint8).astype(np.int64))
        plain, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(n + length - 1)
        segments += [plain[e - k - length + 1 : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    return np.concatenate(rids), np.concatenate(starts), np.concatenate(sizes), np.concatenate(offsets), segments


def repeated_spans(docs: DataFrame, length: int, n_bytes: int, frequent: int = FREQUENT, fan_in: int = FAN_IN) -> DataFrame:
    """_rid and spans (byte offsets start, end, ...): parts of a document's runs, from several collections."""
    segments = repeated_segments(docs, length, n_bytes)
    groups = max(6, -(-n_bytes // COLLECTION_BYTES))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches):
            parts = []
            for i, data in enumerate(chunk["segments"]):
                starts, data = kb.parted(data)
                sizes, data = kb.parted(data)
                offsets, data = kb.parted(data)
                times, data = kb.parted(data)
                starts, sizes, offsets = kb.unpacked(starts, np.int32, True), kb.unpacked(sizes, np.uint8), kb.unpacked(offsets, np.uint8)
                parts.append((
                    np.full(len(starts), i),
                    starts.astype(np.int64),
                    sizes.astype(np.int64),
                    offsets,
                    kb.unpacked(times, np.uint32),
                    np.frombuffer(data, "<u8"),
                ))
            text_of, starts, sizes, offsets, times, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            raw, rids = [t.encode("utf-8", "surrogatepass") for t in chunk["text"]], chunk["_rid"].to_numpy(np.int64)
            # a frequent anchor has collections of its own, numbered below zero
            fans = np.where(times > frequent, -(-times.astype(np.int64) // frequent), 1)
            part = np.where(fans > 1, -1 - (key >> np.uint64(1)).astype(np.int64), (key % np.uint64(groups)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            begins, counts = kb.group_sizes(part[order])
            origin = int(kb.mixed(rids[:1].view(np.uint64))[0] >> np.uint64(1))
            rows = []
            for s, n in zip(begins, counts, strict=True):
                own = order[s : s + n]
                fan = int(fans[own].max())
                texts = [raw[text_of[i]][starts[i] : starts[i] + sizes[i] + length - 1] for i in own]
                rows.append((int(part[own[0]]), fan, origin % fan, *piece(rids[text_of[own]], starts[own], sizes[own], offsets[own], texts)))
            yield pd.DataFrame(rows, columns=["part", "fan", "salt", "rids", "places", "data"])

    def collection(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part, fan, salt = (int(x) for x in key)
        rids, starts, sizes, offsets, segs = unpieced(group, length)
        which, first, last = repeated_in_collection(segs, offsets, length)
        rid, at, end = rids[which], starts[which] + first, starts[which] + last + length
        order = np.lexsort((at, rid))
        rid, at, end = rid[order], at[order], end[order]
        first = np.ones(len(at), bool)
        first[1:] = (rid[1:] != rid[:-1]) | (at[1:] > end[:-1])
        a = np.flatnonzero(first)
        ends = end[np.append(a[1:] - 1, len(at) - 1)] if len(at) else end
        begins, counts = kb.group_sizes(rid[a])
        nothing = (None,) * 6
        rows = [(rid[a[s]], np.stack([at[a[s : s + n]], ends[s : s + n]], 1).ravel().astype(np.int32), *nothing) for s, n in zip(begins, counts, strict=True)]
        if fan > 1:
            unlike = np.fromiter({x: i for i, x in enumerate(zip(segs, offsets.tolist(), strict=True))}.values(), np.int64)
            less = -(-fan // fan_in)
            rows.append((None, None, part, less, salt % less, *piece(rids[unlike], starts[unlike], sizes[unlike], offsets[unlike], [segs[i] for i in unlike])))
        columns = zip(*rows, strict=True) if rows else [()] * 8
        kinds = {"_rid": "Int64", "spans": object, "part": "Int64", "fan": "Int32", "salt": "Int32", "rids": object, "places": object, "data": object}
        give_back()
        return pd.DataFrame({name: pd.Series(list(values), dtype=kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})

    pieces = docs.join(segments, "_rid").select("_rid", "text", "segments").mapInPandas(cut, PIECES)
    spans = None
    while True:
        found = saved(pieces.groupBy("part", "fan", "salt").applyInPandas(collection, FOUND), "collections")
        own = found.where("spans is not null").select("_rid", "spans")
        spans = own if spans is None else spans.unionByName(own)
        pieces = found.where("data is not null").drop("_rid", "spans")
        if pieces.isEmpty():
            return spans


def merged(spans: list[np.ndarray]) -> list[int]:
    """Maximal runs of the union of all spans, flat."""
    flat = np.concatenate(spans).reshape(-1, 2).astype(np.int64)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    reach = np.maximum.accumulate(flat[:, 1])
    first = np.concatenate([[True], flat[1:, 0] > reach[:-1]])
    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(flat) - 1)]
    return np.stack([flat[first, 0], ends], 1).ravel().tolist()


def without(text: str | None, own: list[np.ndarray] | None) -> tuple[int, list[int], bytes]:
    """Bytes of a text, the runs that its spans make up, flat, and the bytes left."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    runs = [] if own is None or not len(own) else merged(list(own))
    kept, last = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[last:a])
        last = b
    return len(raw), runs, b"".join([*kept, raw[last:]])


def with_spans(docs: DataFrame, length: int, carry: tuple[str, ...], frequent: int, fan_in: int) -> DataFrame:
    """doc_id, text, spans of all collections (null: none), and the columns named in carry."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_rid"), *carry)
    parts = repeated_spans(with_row_key(docs), length, text_bytes(docs), frequent, fan_in)
    spans = parts.groupBy("_rid").agg(F.collect_list("spans").alias("spans"))
    # spans are far larger in memory than in their file, so their size there may not choose a broadcast
    return keyed.join(spans.hint("merge"), "_rid", "left").select("doc_id", "text", "spans", *carry)


def suffix_dedup(docs: DataFrame, length: int = 200, carry: tuple[str, ...] = (), frequent: int = FREQUENT, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed byte offsets start, end, ...), kept (the bytes left) of every
    whole text, and the string columns named in carry; one that has the name of a result is an error. frequent and fan_in only
    set how work is dealt out."""
    if clash := {"doc_id", "text", "n_bytes", "n_removed", "n_spans", "spans", "kept", "_rid"} & set(carry):
        raise ValueError(f"columns that cannot be carried: {sorted(clash)}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                size, runs, kept = without(text, own)
                out.append((size, size - len(kept), len(runs) // 2, runs, kept))
            done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])
            yield pd.concat([batch[["doc_id", *carry]].astype({"doc_id": "Int64"}).reset_index(drop=True), done], axis=1)
        give_back()

    more = "".join(f"{c} string, " for c in carry)
    schema = f"doc_id long, {more}n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary"
    return with_spans(docs, length, carry, frequent, fan_in).mapInPandas(cut, schema)


def texts_left(docs: DataFrame, length: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what suffix_dedup() leaves of it; a character that is cut in part goes whole), n_chars, and the string
    columns named in carry. Texts are cut and read in one pass, so a task keeps one Python worker busy and not two."""
    if clash := {"doc_id", "text", "n_chars", "spans", "_rid"} & set(carry):
        raise ValueError(f"columns that cannot be carried: {sorted(clash)}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [without(text, own)[2].decode("utf-8", "ignore") for text, own in zip(batch["text"], batch["spans"], strict=True)]
            left = batch[["doc_id", *carry]].astype({"doc_id": "Int64"})
            yield left.assign(text=texts, n_chars=[len(t) for t in texts])
        give_back()

    more = "".join(f"{c} string, " for c in carry)
    return with_spans(docs, length, carry, FREQUENT, FAN_IN).mapInPandas(cut, f"doc_id long, {more}text string, n_chars long")
