"""Embedding near-dedup with a robust-pruned flat graph.

1. Equal vectors become one node with a number of copies. Centroids fitted on a bounded sample deal the nodes to their
   nearest shards, OVERLAP each; shards that are too large are dealt out again in pairs of blocks, so any two of their nodes
   still meet.
2. In each shard a graph is built node by node, in batches that double: a node walks the graph built so far from the medoid,
   and robust pruning of what the walk met gives its edges; edges back are pruned the same way. The adjacency lists of a node
   from all its shards are united.
3. Each node walks the united graph of its shard greedily from the medoid, then the search widens: every node found in
   range is opened until nothing new is in range. A node that its own walk does not meet is held against the whole shard.
   Every link is verified by cosine in double precision, so none below the floor is told.
4. Each node also walks the graphs of the PROBES next nearest shards, whose nodes may lie just across a border. Nodes that
   walk in a foreign shard come in blocks of about PROBE_ROWS, each with a copy of the shard, however many they are.
5. audit_recall() holds the links of a query set against brute force over all rows, pair by pair.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link with
nothing; null vec_ids have a null component and link with nothing; rows that repeat a vec_id are one vector of the
component, and each other's link. Labels and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import components, only, saved

OVERLAP, PROBES = 3, 3
SHARD_ROWS, MOST_ROWS, PROBE_ROWS = 1200, 3000, 1500
#: Bounds of the sample and of the number of centroids that are fitted on the driver: rows of the sample per centroid, and at
#: the least, where long vectors meet the bound of the sample's bytes.
SAMPLE_PER_CENTROID, LEAST_SAMPLE, SAMPLE_BYTES, MOST_CENTROIDS = 32, 4, 128 << 20, 8192
#: Candidates that are pruned, about how many of them are not of the nearest, edges of a node in one shard, how much nearer an
#: edge must be to cover another, nodes that a walk keeps, and nodes that walk at a time.
CANDIDATES, FAR, DEGREE, ALPHA, BEAM, AT_ONCE = 48, 8, 16, 1.2, 16, 256
NODES = "cid long, copies long, unit array<double>, shards array<long>, probes array<long>"
LINKS = "cid long, links long, v long"


def units(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def walked(x: np.ndarray, q: np.ndarray, table: np.ndarray, start: int, beam: int = BEAM) -> np.ndarray:
    """walks() for the rows q of x."""
    return walks(x, x[q], table, start, beam)


def walks(x: np.ndarray, v: np.ndarray, table: np.ndarray, start: int, beam: int = BEAM) -> np.ndarray:
    """Cosines of the nodes that greedy walks for the vectors v meet, -2 for the others: v x nodes. table: edges, -1 for none.
    Each walk opens the best node it has met and not yet opened, as long as that is one of its best `beam`."""
    n, m, rows = len(v), len(x), np.arange(len(v))
    met = np.full((n, m), -2.0)
    met[:, start] = v @ x[start]
    best, score = np.full((n, beam), -1), np.full((n, beam), -2.0)
    best[:, 0], score[:, 0] = start, met[:, start]
    shut = np.zeros((n, beam), bool)
    while True:
        open_ = np.where((best >= 0) & ~shut, score, -3)
        place = open_.argmax(1)
        go = np.flatnonzero(open_[rows, place] > -3)
        if not len(go):
            return met
        shut[go, place[go]] = True
        near = table[best[go, place[go]]]
        new = (near >= 0) & (met[go[:, None], np.maximum(near, 0)] == -2)
        r, c = np.nonzero(new)
        s = np.full(near.shape, -2.0)
        s[r, c] = np.einsum("ij,ij->i", v[go[r]], x[near[r, c]])
        met[go[r], near[r, c]] = s[r, c]
        all_nodes, all_scores = np.hstack([best[go], np.where(new, near, -1)]), np.hstack([score[go], s])
        all_shut = np.hstack([shut[go], np.zeros(near.shape, bool)])
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        best[go], score[go], shut[go] = (np.take_along_axis(y, top, 1) for y in (all_nodes, all_scores, all_shut))


def robustly_pruned(x: np.ndarray, q: np.ndarray, near: np.ndarray, score: np.ndarray) -> np.ndarray:
    """At most DEGREE of each row's candidates (score -2: none): the nearest, then the nearest that no chosen one covers,
    which is ALPHA times nearer to it than the row is; -1 for none."""
    order = np.argsort(-score, axis=1, kind="stable")
    near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
    between = np.sqrt(np.maximum(2 - 2 * np.einsum("qid,qjd->qij", x[near], x[near]), 0))
    distance = np.sqrt(np.maximum(2 - 2 * score, 0))
    alive, rows = score > -2, np.arange(len(q))
    chosen = np.full((len(q), DEGREE), -1)
    for d in range(DEGREE):
        first = alive.argmax(1)
        left = alive[rows, first]
        if not left.any():
            break
        chosen[left, d] = near[rows[left], first[left]]
        alive[rows, first] = False
        alive &= ALPHA * between[rows, first] > distance
    return chosen


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of each row, built from walks; the medoid is the first node."""
    m = len(x)
    table = np.full((m, DEGREE), -1)
    start = medoid(x)
    order = np.random.default_rng(m).permutation(m)
    order = np.concatenate([[start], order[order != start]])
    done, c, r = 1, min(CANDIDATES, m), np.random.default_rng(m + 1)
    while done < m:
        q = order[done : done + min(done, AT_ONCE)]
        met = walked(x, q, table, start)
        met[np.arange(len(q)), q] = -2
        # the nearest that the walk met and, for edges that lead far, some of the others
        choice = np.where(met > -2, met + 4 * (r.random(met.shape) < FAR / np.maximum((met > -2).sum(1, keepdims=True), 1)), -2)
        choice[met[:, start] > -2, start] += 4
        near = np.argpartition(-choice, c - 1, axis=1)[:, :c]
        table[q] = robustly_pruned(x, q, near, np.take_along_axis(met, near, 1))
        back(x, table, q)
        done += len(q)
    return [a[a >= 0] for a in table]


def back(x: np.ndarray, table: np.ndarray, q: np.ndarray) -> None:
    """Adds edges back to the rows q; a node that has too many is pruned."""
    src, dst = np.repeat(q, DEGREE), table[q].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, size = np.unique(dst, return_index=True, return_counts=True)
    for a in range(0, len(nodes), AT_ONCE):
        own, f, n = nodes[a : a + AT_ONCE], first[a : a + AT_ONCE], size[a : a + AT_ONCE]
        wide = np.full((len(own), DEGREE + int(n.max())), -1)
        wide[:, :DEGREE] = table[own]
        at = np.repeat(np.arange(len(own)), n)
        wide[at, DEGREE + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = src[f[0] : f[0] + n.sum()]
        score = np.where(wide >= 0, np.einsum("id,ijd->ij", x[own], x[wide]), -2)
        if wide.shape[1] > CANDIDATES:  # all edges, and the nearest of the new ones
            top = np.argpartition(-score[:, DEGREE:], CANDIDATES - DEGREE - 1, axis=1)[:, : CANDIDATES - DEGREE] + DEGREE
            wide, score = (np.hstack([v[:, :DEGREE], np.take_along_axis(v, top, 1)]) for v in (wide, score))
        table[own] = robustly_pruned(x, own, np.maximum(wide, 0), score)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def edge_table(adjacency: list[np.ndarray]) -> np.ndarray:
    """Edges of each row, -1 for none."""
    table = np.full((len(adjacency), max(1, max(map(len, adjacency)))), -1)
    for i, a in enumerate(adjacency):
        table[i, : len(a)] = a
    return table


def widen(x: np.ndarray, v: np.ndarray, table: np.ndarray, met: np.ndarray, opened: np.ndarray, floor: float) -> None:
    """Opens all nodes in range of each vector until nothing new is in range, in pieces, as a group of near copies opens all of
    its pairs. met, opened: v x nodes, changed in place."""
    while True:
        r, c = np.nonzero((met >= floor) & ~opened)
        if not len(r):
            return
        opened[r, c] = True
        for b in range(0, len(r), 1 << 15):
            near = table[c[b : b + (1 << 15)]]
            new = np.zeros(met.shape, bool)
            new[np.repeat(r[b : b + (1 << 15)], near.shape[1])[near.ravel() >= 0], near[near >= 0]] = True
            rr, cc = np.nonzero(new & (met == -2))
            for e in range(0, len(rr), 1 << 16):
                i, j = rr[e : e + (1 << 16)], cc[e : e + (1 << 16)]
                met[i, j] = np.einsum("ij,ij->i", v[i], x[j])


def in_range(x: np.ndarray, adjacency: list[np.ndarray], floor: float) -> np.ndarray:
    """m x m booleans: the other rows at a cosine of floor or more, as the walks and the widened search meet them."""
    m, table = len(x), edge_table(adjacency)
    start, found = medoid(x), np.zeros((m, m), bool)
    for a in range(0, m, AT_ONCE):
        q = np.arange(a, min(m, a + AT_ONCE))
        rows = np.arange(len(q))
        met = walked(x, q, table, start)
        lost = np.flatnonzero(met[rows, q] == -2)  # the graph does not lead to these nodes
        if len(lost):
            met[lost] = x[q[lost]] @ x.T
        opened = np.zeros((len(q), m), bool)
        opened[lost] = True
        widen(x, x[q], table, met, opened, floor)
        found[q] = met >= floor
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def reached(x: np.ndarray, adjacency: list[np.ndarray], v: np.ndarray, floor: float) -> np.ndarray:
    """v x nodes booleans: the rows of x in range of vectors that are not in the graph, as their walks and the widened search meet them."""
    table, start, found = edge_table(adjacency), medoid(x), np.zeros((len(v), len(x)), bool)
    for a in range(0, len(v), AT_ONCE):
        own = v[a : a + AT_ONCE]
        met = walks(x, own, table, start)
        widen(x, own, table, met, np.zeros(met.shape, bool), floor)
        found[a : a + AT_ONCE] = met >= floor
    return found


def shard_found(group: pd.DataFrame, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a shard's nodes, sorted as the rows are sorted, and which pairs are in range."""
    group.sort_values("cid", kind="stable", inplace=True, ignore_index=True)
    return group["cid"].to_numpy(np.int64), in_range(units(group["unit"]), adjacency_of(group), floor)


def adjacency_of(group: pd.DataFrame) -> list[np.ndarray]:
    """The united edges of a shard's nodes that stay in the shard, by place of the row."""
    place = {v: i for i, v in enumerate(group["cid"].tolist())}
    return [np.array([place[int(v)] for v in own if int(v) in place], np.int64) for own in group["near"]]


def shard_links(group: pd.DataFrame, shard: int, floor: float) -> pd.DataFrame:
    """Rows of a shard: cid, links (copies linked, of the pairs that this shard owns) and v, the least id of its component.
    A pair is owned by the first shard that both nodes are in."""
    ids, found = shard_found(group, floor)
    copies = group["copies"].to_numpy(np.int64)
    label = np.arange(len(ids))
    for i in range(len(ids)):
        merge(label, i, np.flatnonzero(found[i]))
    earlier = rows_by_shard(group["shards"], shard)
    leave_out(found, earlier, earlier)  # pairs that an earlier shard owns
    return pd.DataFrame({"cid": ids, "links": found @ copies, "v": ids[label]})


def merge(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Gives i, the others and all that share a label with one of them the least of their labels."""
    if len(others):
        labels = np.unique(np.append(label[others], label[i]))
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]


def rows_by_shard(lists: pd.Series, before: int | None = None) -> dict[int, list[int]]:
    """The rows that name each shard; only shards before the given one."""
    out: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for s in own:
            if before is None or s < before:
                out.setdefault(int(s), []).append(i)
    return out


def leave_out(found: np.ndarray, left: dict[int, list[int]], right: dict[int, list[int]]) -> None:
    """Takes pairs of rows that name a shard in common out of found."""
    for s in left.keys() & right.keys():
        found[np.ix_(left[s], right[s])] = False


def probe_found(home: pd.DataFrame, probing: pd.DataFrame, floor: float) -> np.ndarray:
    """probing x home booleans: pairs in range, without those that are in one shard both."""
    found = reached(units(home["unit"]), adjacency_of(home), units(probing["unit"]), floor)
    leave_out(found, rows_by_shard(probing["shards"]), rows_by_shard(home["shards"]))
    return found


def probe_links(home: pd.DataFrame, probing: pd.DataFrame, shard: int, floor: float) -> pd.DataFrame:
    """LINKS of a shard's nodes and of nodes that walk in it from elsewhere. A pair that shares no shard is owned by the first one
    where one of the two is at home and the other walks; rows without a link are left out."""
    found = probe_found(home, probing, floor)
    n, ids = len(probing), np.concatenate([probing["cid"].to_numpy(np.int64), home["cid"].to_numpy(np.int64)])
    label = np.arange(len(ids))
    for i in np.flatnonzero(found.any(1)).tolist():
        merge(label, i, n + np.flatnonzero(found[i]))
    linked = np.concatenate([found.any(1), found.any(0)])
    at_home, walking = ([rows_by_shard(g[c], shard) for g in (probing, home)] for c in ("shards", "probes"))
    leave_out(found, walking[0], at_home[1])
    leave_out(found, at_home[0], walking[1])
    links = np.concatenate([found @ home["copies"].to_numpy(np.int64), found.T @ probing["copies"].to_numpy(np.int64)])
    return pd.DataFrame({"cid": ids[linked], "links": links[linked], "v": ids[label][linked]})


def bound(value, f):
    """f(value), with value worked out once and not at each place where f uses it."""
    return F.transform(F.array(value), f)[0]


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cid, copies) of the rows that can link, and (cid, copies, unit) of each distinct vector."""
    rows = only(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").withColumn(
        "embedding",
        F.col("embedding").cast("array<double>"),
    )
    rows = rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (size["n"] if size else 0)).withColumn("h", F.xxhash64("embedding"))
    kinds = rows.groupBy("h", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    scaled = bound(F.array_max(F.transform("embedding", F.abs)), lambda top: F.transform("embedding", lambda v: v / top))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    unit = bound(scaled, lambda x: bound(norm(x), lambda n: F.transform(x, lambda v: v / n)))
    nodes = saved(kinds.select("h", "embedding", "cid", "copies", unit.alias("unit")), "nodes")
    members = rows.join(nodes.select("h", "embedding", "cid", "copies"), ["h", "embedding"]).select("vec_id", "cid", "copies")
    return members, nodes.select("cid", "copies", "unit")


def sharded(nodes: DataFrame) -> DataFrame:
    """NODES: each node with its shards, and those that it walks in besides."""
    spark, n = nodes.sparkSession, nodes.count()
    first = nodes.select(F.size("unit").alias("n")).first()
    most = SAMPLE_BYTES // (8 * (first["n"] if first else 1))  # rows of the sample
    k = max(1, min(MOST_CENTROIDS, most // LEAST_SAMPLE, -(-OVERLAP * n // SHARD_ROWS)))
    few = nodes.withColumn(
        "o",
        F.xxhash64("cid").bitwiseAND(F.lit((1 << 40) - 1)),
    ).where(F.col("o") < int(min(1.0, min(most, SAMPLE_PER_CENTROID * k) / max(n, 1)) * (1 << 40))).select("o", "cid", "unit")
    few = few.toPandas().sort_values(["o", "cid"])
    if k == 1 or len(few) < k:
        return nodes.withColumns({"shards": F.array(F.lit(0).cast("long")), "probes": F.array().cast("array<bigint>")})
    centres = spark.sparkContext.broadcast(centroids(units(few["unit"]), k))
    overlap, width = min(OVERLAP, k), min(OVERLAP + PROBES, k)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = units(batch["unit"]) @ centres.value.T
                best = np.argpartition(-score, width - 1, axis=1)[:, :width]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
                yield batch.assign(shards=list(np.sort(best[:, :overlap], 1)), probes=list(np.sort(best[:, overlap:], 1)))

    near = saved(nodes.mapInPandas(nearest, NODES), "shards")
    # shards over MOST_ROWS: blocks of half that size, one shard per pair of blocks
    sizes = {r["s"]: -(-2 * r["count"] // MOST_ROWS) for r in near.select(F.explode("shards").alias("s")).groupBy("s").count().where(F.col("count") > MOST_ROWS).collect()}  # at most k rows
    if not sizes:
        return near
    parts = F.create_map(*(F.lit(v) for pair in sizes.items() for v in (int(pair[0]), int(pair[1]))))

    def split(s):
        b = F.element_at(parts, s)
        own = F.pmod(F.xxhash64("cid", s), b)
        pairs = F.transform(
            F.sequence(F.lit(0).cast("long"), b.cast("long") - 1),
            lambda j: s + (F.least(own, j) * b + F.greatest(own, j) + 1) * F.lit(1 << 20),
        )
        return F.when(b.isNull(), F.array(s)).otherwise(pairs)

    def blocks(s):  # a shard for each block, which holds all of its nodes
        b = F.element_at(parts, s).cast("long")
        each = F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda j: s + (j * b + j + 1) * F.lit(1 << 20))
        return F.when(b.isNull(), F.array(s)).otherwise(each)

    dealt = {c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, f)))) for c, f in (("shards", split), ("probes", blocks))}
    return near.withColumns(dealt)


def shards_and_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NODES with their shards, and the united adjacency (cid, near) of the graphs of all shards."""
    near = saved(sharded(nodes), "shards")
    dealt = near.select("*", F.explode("shards").alias("shard"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["cid"].to_numpy(np.int64)
        return pd.DataFrame({"cid": ids, "near": [ids[a] for a in pruned_graph(units(group["unit"]))]})

    graph = dealt.groupBy("shard").applyInPandas(build, "cid long, near array<long>")
    return near, saved(graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")


def across(near: DataFrame, graph: DataFrame, search, schema: str) -> DataFrame:
    """search(shard, home, probing) for every shard and block of the nodes that walk in it from elsewhere."""
    probing = near.select("*", F.explode("probes").alias("shard"))
    blocks = probing.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).alias("blocks"))  # a row per shard
    probing = probing.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("cid", "shard"), F.col("blocks")))
    home = near.join(graph, "cid").select("*", F.explode("shards").alias("shard")).join(blocks, "shard")
    home = home.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("walks", F.lit(False))
    both = home.unionByName(probing.withColumns({"near": F.array().cast("array<bigint>"), "walks": F.lit(True)}))
    columns = [name.split()[0] for name in schema.split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid", ignore_index=True)
        home, probing = (group[group["walks"] == w].reset_index(drop=True) for w in (False, True))
        if not len(home) or not len(probing):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        return search(int(key[0]), home, probing)

    return both.groupBy("shard", "block").applyInPandas(run, schema)


def embedding_dedup(vectors: DataFrame, min_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    members, nodes = nodes_of(vectors)
    near, graph = shards_and_graph(nodes)
    searched = near.join(graph, "cid").select("*", F.explode("shards").alias("shard"))

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return shard_links(group, int(key[0]), min_cosine)

    def probe(shard: int, home: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        return probe_links(home, probing, shard, min_cosine)

    found = searched.groupBy("shard").applyInPandas(search, LINKS).unionByName(across(near, graph, probe, LINKS))
    found = saved(found, "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    component = components(found.where("cid <> v").select(F.col("cid").alias("u"), "v")).withColumnRenamed("id", "cid")
    own = members.join(links, "cid").join(component, "cid", "left").groupBy("vec_id").agg(
        F.max(F.col("links") + F.col("copies") - 1).alias("links"),
        F.min(F.coalesce("component", "cid")).alias("component"),
    )
    out = only(vectors, "vec_id").join(own, "vec_id", "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"),
    )


def shard_pairs(near: DataFrame, graph: DataFrame, min_cosine: float) -> DataFrame:
    """cid, other: the links between nodes that the shards and the walks across them tell, each once."""
    searched = near.join(graph, "cid").select("*", F.explode("shards").alias("shard"))

    def pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, found = shard_found(group, min_cosine)
        a, b = np.nonzero(found)
        return pd.DataFrame({"cid": ids[a], "other": ids[b]})

    def probe(shard: int, home: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        a, b = np.nonzero(probe_found(home, probing, min_cosine))
        a, b = probing["cid"].to_numpy(np.int64)[a], home["cid"].to_numpy(np.int64)[b]
        return pd.DataFrame({"cid": np.concatenate([a, b]), "other": np.concatenate([b, a])})

    schema = "cid long, other long"
    return searched.groupBy("shard").applyInPandas(pairs, schema).unionByName(across(near, graph, probe, schema)).distinct()


def audit_recall(vectors: DataFrame, min_cosine: float = 0.95, every: int = 100, block: int = 2048) -> DataFrame:
    """One row: n_true, the links between distinct vectors of the query nodes (cid divisible by `every`) by brute force;
    n_found, how many of these very pairs the graph tells; n_false, pairs that it tells and brute force does not. Queries go
    in blocks, joined with all nodes by the number of the block, so neither side is broadcast or collected."""
    _, nodes = nodes_of(vectors)
    near, graph = shards_and_graph(nodes)
    told = shard_pairs(near, graph, min_cosine).where(F.col("cid") % every == 0)
    queries = nodes.where(F.col("cid") % every == 0).select("cid", "unit")
    blocks = max(1, -(-queries.count() // block))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)))
    parts = 64
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    against = nodes.select(F.col("cid").alias("other"), F.col("unit").alias("vector")).withColumn(
        "part_",
        F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int"),
    )
    against = against.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros(0, int), np.zeros(0, int)
        if len(left) and len(right):
            close = units(left["unit"]) @ units(right["vector"]).T >= min_cosine
            a, b = np.nonzero(close & (left["cid"].to_numpy()[:, None] != right["other"].to_numpy()[None, :]))
        return pd.DataFrame({"cid": left["cid"].to_numpy(np.int64)[a], "other": right["other"].to_numpy(np.int64)[b]})

    true = asked.groupBy("block", "part").cogroup(against.groupBy("block_", "part_")).applyInPandas(compare, "cid long, other long")
    both = true.withColumn("t", F.lit(1)).join(told.withColumn("f", F.lit(1)), ["cid", "other"], "full_outer")
    return both.agg(
        F.count("t").alias("n_true"),
        F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("n_found"),
        F.count_if(F.col("t").isNull()).alias("n_false"),
    )
