"""Exact n-gram Jaccard join with set-relation skipping.

A document is the set of its 5-word shingles (64-bit hashes). Two documents link when 100 |A & B| >= 75 |A or B|.

1. Shingles are counted over the corpus (keyblocks). A shingle that no other set has cannot add to an intersection, so only
   sets with enough shared shingles stay, as lists of these, rarest first. Equal sets become one class.
2. Index lists: each set is listed under its rarest shingles (prefix filter). A list's pivot is its most central set. Each
   set joins the pivot that its lists name most often, and answers are derived from the pivot's: with o(x) = |x & r|,
   |x & y| = |r| - lost(x) - lost(y) + |lost(x) & lost(y)| + |gained(x) & gained(y)|; only what differs from r is read.
   Within a cluster only sets that do not link to the pivot are held against the others.
3. Across components, lists are cut into narrow blocks by set size, and a set meets only the blocks that its position in the
   list lets it reach. Where the larger set v holds the shingle at position p, at most |v| - p shingles are left to share, so the
   smaller one has at most (|v| - p) (100 + t) / t - |v| shingles at a threshold of t percent: the deeper the position, the
   fewer blocks are left, and all others are skipped. The smaller set itself is listed only under as many of its first
   shingles as an equally large partner allows. Each pair that is left is verified on the whole sets.

Pairs inside one component are never made, so groups of copies cost their size, not its square; no link between
components is lost.

Cases: null, empty or wordless texts have the empty set and link with nothing; fewer than 5 words make one shingle;
a null doc_id has a null component and links with nothing; rows that share a doc_id are one node. Other columns are
ignored; an empty table gives an empty result. A text of any length is one set, made in one task. Ties between pivots go to
the smallest id. A chunk's rows must come in the same order when a lost task runs again, as those of a written table do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import keyblocks as kb
from evidentia.llm.common import components, only, saved, text_bytes

WIDTH = 6
#: Shingles and sets that one task takes of a cluster; larger clusters are dealt out, each part with the pivot.
CLUSTER_KEYS, CLUSTER_SETS = 1 << 21, 1 << 12
#: Blocks by set size that lie between a set and the smallest that it can link with.
BLOCKS = 2
SETS = "doc_id long, n int, s1 long, s2 long, m int, keys binary, dfs binary"


def shingle_sets(words: kb.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each text of a chunk and the text of each; sorted by text, then key."""
    keys, _, text = words.windows(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    ends = words.first[short] + words.counts[short]
    if len(short):
        own = kb.mixed(kb.rolling(words.hashes, words.first[short], ends, kb.BASE2) + words.counts[short].astype(np.uint64))
        keys, text = np.concatenate([keys, own]), np.concatenate([text, short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], text[new]


def shared_sets(docs: DataFrame, shingle: int, percent: int, n_bytes: int) -> DataFrame:
    """One row per document: n (set size), s1 and s2 (a 128-bit sum that names the set), and, where the set can have
    a partner and is the first of its kind in its chunk, keys (48 and more bits of each shared shingle, rarest first),
    dfs (document frequency of each, at most 65535) and their number m."""
    bits = kb.bits_for(n_bytes / 6)

    def make(chunk: pd.DataFrame) -> Iterator[tuple]:
        ids = chunk["doc_id"].astype("Int64")
        order = np.argsort(ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64), kind="stable")
        null = ids.isna().to_numpy()[order]
        ids = ids.fillna(-1).to_numpy(np.int64)[order]
        keys, text = shingle_sets(kb.Words([chunk["text"].iloc[i] for i in order], lowered=True), shingle)
        n = np.bincount(text, minlength=len(ids))
        ends = np.cumsum(n)
        sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(kb.mixed(keys + np.uint64(c)), dtype=np.uint64)[ends - 1] * (ends > 0)])) for c in (11, 77)] if len(keys) else [np.zeros(
            len(ids),
            np.uint64,
        )] * 2
        kinds = pd.DataFrame({"n": n, "s1": sums[0], "s2": sums[1]})
        first = ~kinds.duplicated().to_numpy() & (n > 0) & ~null
        yield -1, "docs", kb.joined(
            kb.packed(ids),
            kb.packed(null.astype(np.uint8) + 2 * first.astype(np.uint8)),
        ), kb.packed(n.astype(np.int32)), kb.joined(kb.packed(sums[0]), kb.packed(sums[1]))
        keep = first[text]
        keys, text = keys[keep], text[keep]
        for bucket, own in kb.dealt(keys, bits):
            yield bucket, "keys", kb.packed_keys(keys[own], bits, WIDTH), kb.packed_runs(text[own]), None

    def answer(bucket: int, group: pd.DataFrame) -> Iterator[tuple]:
        keys = [kb.unpacked_keys(a, bucket, bits, WIDTH) for a in group["a"]]
        sizes = [len(k) for k in keys]
        key = np.concatenate(keys)
        sort = np.argsort(key, kind="stable")
        starts, runs = kb.group_sizes(key[sort])
        df = np.empty(len(key), np.int64)
        df[sort] = np.repeat(runs, runs)
        at = 0
        for number, data, size, own in zip(group["chunk"], group["b"], sizes, keys, strict=True):
            d = df[at : at + size]
            at += size
            hit = np.flatnonzero(d > 1)
            if len(hit):
                yield int(number), "keys", kb.packed_keys(
                    own[hit],
                    0,
                    8,
                ), kb.packed(np.minimum(d[hit], 65535).astype(np.uint16)), kb.packed_runs(kb.unpacked_runs(data)[hit])

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["kind"] == "docs"].iloc[0]
        ids, marks = (kb.unpacked(x, t) for x, t in zip(kb.parted(head["a"]), (np.int64, np.uint8), strict=True))
        n, sums = kb.unpacked(head["b"], np.int32), [kb.unpacked(x, np.uint64).view(np.int64) for x in kb.parted(head["c"])]
        hits = group[group["kind"] == "keys"]
        m, keys_of, dfs_of = np.zeros(len(ids), np.int64), [None] * len(ids), [None] * len(ids)
        if len(hits):
            key = np.concatenate([np.frombuffer(a, "<u8") for a in hits["a"]])
            df = np.concatenate([kb.unpacked(b, np.uint16) for b in hits["b"]])
            text = np.concatenate([kb.unpacked_runs(c) for c in hits["c"]])
            m = np.bincount(text, minlength=len(ids))
            able = (100 * m >= percent * n) & (n > 0)
            keep = able[text]
            key, df, text = key[keep], df[keep], text[keep]
            order = np.lexsort((key, df, text))
            key, df, text = key[order], df[order], text[order]
            starts, sizes = kb.group_sizes(text)
            for s, c in zip(starts, sizes, strict=True):
                keys_of[text[s]], dfs_of[text[s]] = key[s : s + c].tobytes(), df[s : s + c].tobytes()
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": n, "s1": sums[0], "s2": sums[1], "m": m, "keys": keys_of, "dfs": dfs_of})
        out.loc[(marks & 1) == 1, "doc_id"] = pd.NA
        return out

    rows = kb.answered(kb.blocks(only(docs, "doc_id", "text"), make, bits), answer, bits)
    return kb.by_chunk(rows, put_together, SETS)


def longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8")


def cluster_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a cluster (part): rows of x and one row of its pivot; edges (u, v) to the smallest id of each component."""
    group = group.sort_values("x", kind="stable").sort_values("is_pivot", ascending=False, kind="stable").reset_index(drop=True)
    ids, n = group["x"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    if len(ids) < 2:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    sets = [np.sort(longs(k)) for k in group["keys"]]
    pivot = sets[0]
    lost = np.ones((len(ids), len(pivot)), bool)
    gained_keys, gained_of = [], []
    for i, s in enumerate(sets):
        at = np.searchsorted(pivot, s)
        inside = at < len(pivot)
        inside[inside] = pivot[at[inside]] == s[inside]
        lost[i, at[inside]] = False
        gained_keys.append(s[~inside])
        gained_of.append(np.full((~inside).sum(), i))
    with_pivot = len(pivot) - lost.sum(1)
    linked = 100 * with_pivot >= percent * (n + n[0] - with_pivot)
    label = np.where(linked, 0, np.arange(len(ids)))
    label[0] = 0
    rest = np.flatnonzero(~linked)
    if len(rest):
        gained, gained_of = np.concatenate(gained_keys), np.concatenate(gained_of)
        order = np.argsort(gained, kind="stable")
        starts, sizes = kb.group_sizes(gained[order])
        shared = np.repeat(sizes > 1, sizes)
        column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)[shared]
        owner = gained_of[order][shared]
        width = int(column.max()) + 1 if len(column) else 0
        lost_f = lost.astype(np.float32)
        n_lost = lost.sum(1)
        for a in range(0, len(rest), 256):
            own = rest[a : a + 256]
            both = len(pivot) - n_lost[own][:, None] - n_lost[None, :] + lost_f[own] @ lost_f.T
            for c in range(0, width, 4096):
                pick = (column >= c) & (column < c + 4096)
                g = np.zeros((len(ids), min(4096, width - c)), np.float32)
                g[owner[pick], column[pick] - c] = 1
                both = both + g[own] @ g.T
            both = np.rint(both).astype(np.int64)
            near = 100 * both >= percent * (n[own][:, None] + n[None, :] - both)
            for x, row in zip(own, near, strict=True):
                labels = np.unique(np.append(label[row], label[x]))
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    out = pd.DataFrame({"u": ids, "v": least[label]})
    return out[out["u"] != out["v"]]


def candidate_lists(reps: DataFrame, percent: int) -> DataFrame:
    """One row per set and prefix shingle: key, x, n, pos (position in the whole order), cen (mean frequency)."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for x, n, keys, dfs in zip(batch["x"], batch["n"], batch["keys"], batch["dfs"], strict=True):
                own = longs(keys)
                alone = n - len(own)
                take = n - (percent * n + 99) // 100 + 1 - alone
                df = np.frombuffer(dfs, np.uint16)
                parts.append(pd.DataFrame({
                    "key": own[:take].view(np.int64),
                    "x": x,
                    "n": n,
                    "pos": alone + np.arange(min(take, len(own))),
                    "cen": (int(df.sum(dtype=np.int64)) * 16) // n,
                }))
            if parts:
                yield pd.concat(parts)

    return reps.mapInPandas(listed, "key long, x long, n int, pos int, cen long")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The least intersection that sets of sizes a and b need."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def ngram_links(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) whose components are those of all linked pairs of reps (x, n, keys, dfs)."""
    lists = saved(candidate_lists(reps, percent), "lists")
    # pivots: the most central set of each list; each set takes the pivot most of its lists name
    pivots = lists.groupBy("key").agg(
        F.max(F.struct("cen", (-F.col("x")).alias("minus"), F.col("n").alias("rn"))).alias("p"),
        F.count("*").alias("size"),
    ).where("size > 1")
    named = lists.join(
        pivots.select("key", (-F.col("p.minus")).alias("r"), "p.rn"),
        "key",
    ).where("r <> x").where((F.col("rn") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("rn") * percent))
    named = named.groupBy("x", "r").agg(F.count("*").alias("c")).groupBy("x").agg(F.max(F.struct("c", (-F.col("r")).alias("minus"))).alias("p")).select(
        "x",
        (-F.col("p.minus")).alias("r"),
    )
    named = saved(named, "pivots")
    sets = reps.select("x", "n", "keys")
    parts = named.join(
        reps.select("x", "m"),
        "x",
    ).groupBy("r").agg(F.greatest(F.ceil(F.sum("m") / CLUSTER_KEYS), F.ceil(F.count("*") / CLUSTER_SETS)).cast("int").alias("parts"))
    members = named.join(parts, "r").select("x", "r", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_pivot"))
    heads = parts.select(F.col("r").alias("x"), "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_pivot"))
    clusters = members.unionByName(heads).join(sets, "x")
    links = saved(clusters.groupBy("r", "part").applyInPandas(lambda g: cluster_links(g, percent), "u long, v long"), "links")
    # across components: block by block
    known = components(links)
    lists = lists.select("key", "x", "n", "pos").join(
        known.select(F.col("id").alias("x"), "component"),
        "x",
        "left",
    ).withColumn("component", F.coalesce("component", "x"))
    width = float(np.log(100.0 / percent)) / BLOCKS
    block = lambda n: F.floor(F.log(n.cast("double")) / width).cast("int")
    n, pos = F.col("n"), F.col("pos")
    # u, the smaller set of a pair, shares at least what two sets of its size must share
    a = lists.where(n - pos >= least_overlap(n, n, percent)).select(
        "key",
        F.col("x").alias("u"),
        F.col("n").alias("un"),
        F.col("pos").alias("up"),
        F.col("component").alias("uc"),
        block(n).alias("block"),
    )
    most = F.least(n, F.floor((n - pos) * (100 + percent) / F.lit(percent) - n + 1e-9))
    least = F.ceil(n * percent / F.lit(100) - 1e-9)
    b = lists.withColumns({"most": most, "least": least}).where("most >= least AND most > 0")
    b = b.select(
        "key",
        F.col("x").alias("v"),
        F.col("n").alias("vn"),
        F.col("pos").alias("vp"),
        F.col("component").alias("vc"),
        F.explode(F.sequence(block(F.greatest("least", F.lit(1))), block(F.col("most")))).alias("block"),
    )
    fits = (F.col("uc") != F.col("vc")) & ((F.col("un") < F.col("vn")) | ((F.col("un") == F.col("vn")) & (F.col("u") < F.col("v")))) & (F.col("vn") * percent <= F.col("un") * 100)
    reach = F.least(F.col("un") - F.col("up"), F.col("vn") - F.col("vp")) >= least_overlap(F.col("un"), F.col("vn"), percent)
    pairs = a.join(b, ["key", "block"]).where(fits & reach).select("u", "v").distinct()
    u = sets.select(F.col("x").alias("u"), F.col("n").alias("un"), F.col("keys").alias("uk"))
    v = sets.select(F.col("x").alias("v"), F.col("n").alias("vn"), F.col("keys").alias("vk"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = np.array([len(np.intersect1d(longs(x), longs(y), assume_unique=True)) for x, y in zip(batch["uk"], batch["vk"], strict=True)], np.int64)
            near = 100 * both >= percent * (batch["un"].to_numpy(np.int64) + batch["vn"].to_numpy(np.int64) - both)
            yield batch.loc[near, ["u", "v"]]

    across = pairs.join(u, "u").join(v, "v").select("u", "un", "uk", "v", "vn", "vk").mapInPandas(verify, "u long, v long")
    return links.unionByName(across)


def ngram_jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = saved(shared_sets(docs, shingle, percent, text_bytes(docs)), "sets")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("x"))
    able = rows.where("keys IS NOT NULL").dropDuplicates(["doc_id", "n", "s1", "s2"])
    reps = saved(able.join(classes, ["n", "s1", "s2"]).where("doc_id = x").select("x", "n", "m", "keys", "dfs"), "reps")
    same = rows.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["n", "s1", "s2"]).where("doc_id <> x").select(
        F.col("doc_id").alias("u"),
        F.col("x").alias("v"),
    )
    found = components(ngram_links(reps, percent).unionByName(same))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
