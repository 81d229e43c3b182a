"""The graph of embedding dedup over several shards, held against brute force pair by pair."""

import numpy as np
import pytest

from evidentia.llm import embedding_dedup as ed


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["groups", "three", "tight", "alone"])
def test_walks_find_what_brute_force_finds(kind):
    r = np.random.default_rng(8)
    if kind == "groups":
        c = r.standard_normal((150, 32))
        x = np.array([c[k % 150] + r.standard_normal(32) * 0.2 for k in range(900)])
    elif kind == "three":
        c = r.standard_normal((3, 32))
        x = np.array([c[k % 3] + r.standard_normal(32) * 0.2 for k in range(600)])
    elif kind == "tight":
        b = np.linalg.qr(r.standard_normal((32, 3)))[0]
        ends = [b[:, 0], 0.97 * b[:, 0] + np.sqrt(1 - 0.97**2) * b[:, 1], b[:, 2]]
        x = np.array([ends[min(k // 100, 2)] + r.standard_normal(32) * 0.003 for k in range(400)])
    else:
        x = r.standard_normal((500, 32))
    x = unit(x)
    graph = ed.pruned_graph(x)
    found, true = ed.in_range(x, graph, 0.95), x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert not (found & ~true).sum() and (found & true).sum() >= 0.99 * true.sum()
    assert max(map(len, graph)) <= ed.DEGREE
    # the walks do the work, but for crowds: they meet a part of the pairs, and lead nearly every node to itself
    table = np.full((len(x), ed.DEGREE), -1)
    for i, a in enumerate(graph):
        table[i, : len(a)] = a
    met = ed.walked(x, np.arange(len(x)), table, ed.medoid(x))
    assert kind in ("three", "tight") or ((np.diag(met) > 0.999).mean() > 0.95 and (met > -2).mean() < 0.8)


def test_small_graphs():
    for n in (1, 2, 3):
        x = unit(np.random.default_rng(n).standard_normal((n, 4)))
        assert ed.in_range(x, ed.pruned_graph(x), -1.0).sum() == n * (n - 1)


def test_recall_over_many_shards(spark):
    """4,000 vectors in groups of 1 to 60, in shards of about 300 that are split beyond 500."""
    r = np.random.default_rng(5)
    centres, x = r.standard_normal((400, 32)), []
    while len(x) < 4000:
        c = centres[r.integers(0, 400)]
        x += [c + r.standard_normal(32) * r.uniform(0.02, 0.2) for _ in range(r.integers(1, 12))]
    hub = r.standard_normal(32)  # more nodes near one place than a shard takes
    x += [hub + r.standard_normal(32) * 0.1 for _ in range(700)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    held = ed.SHARD_ROWS, ed.MOST_ROWS
    ed.SHARD_ROWS, ed.MOST_ROWS = 300, 500
    try:
        audit = ed.audit_recall(df, every=10, block=100).first()
    finally:
        ed.SHARD_ROWS, ed.MOST_ROWS = held
    u = unit(np.array(x))
    true = u[::10] @ u.T >= 0.95
    assert audit["n_true"] == true.sum() - len(true) > 10000
    print("recall", audit["n_found"] / audit["n_true"])
    assert audit["n_found"] >= 0.98 * audit["n_true"] and audit["n_false"] == 0


def hard_sets():
    r = np.random.default_rng(1)
    yield "groups", unit(np.repeat(r.standard_normal((500, 64)), 4, 0) + r.standard_normal((2000, 64)) * 0.2)
    yield "few dimensions", unit(r.standard_normal((3000, 8)))
    a, n = unit(r.standard_normal((1500, 64))), r.standard_normal((1500, 64))
    n = unit(n - (n * a).sum(1, keepdims=True) * a)
    yield "lone pairs", np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * n])


@pytest.mark.parametrize("overlap, least", [(3, 0.999), (1, 0.99)])
@pytest.mark.parametrize("name, x", list(hard_sets()))
def test_links_across_shards(spark, monkeypatch, name, x, overlap, least):
    """Links of nodes that share no shard are found by walks in foreign ones, each counted once. With one shard a node (production: 3) there
    are many of them."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ed, "SHARD_ROWS", 200)
    monkeypatch.setattr(ed, "PROBE_ROWS", 150)  # several blocks of walking nodes a shard
    monkeypatch.setattr(ed, "OVERLAP", overlap)
    true = (x @ x.T >= 0.95).sum(1) - 1
    got = np.array([r["n_links"] for r in ed.embedding_dedup(df).orderBy("vec_id").collect()])
    home = {r["cid"]: set(r["shards"]) for r in ed.sharded(ed.nodes_of(df)[1]).collect()}
    apart = sum(not home[a] & home[b] for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True))
    print(name, "links", true.sum() // 2, "missed", (true - got).sum() // 2, "apart", apart)
    assert (got <= true).all() and got.sum() >= least * true.sum()
    assert overlap > 1 or apart > 10 * ((true - got).sum() // 2)


def test_a_pair_has_one_owner():
    """Two nodes that walk in each other's shard are counted in one of the two tasks."""
    x = unit(np.array([[1.0, 0.1], [1.0, 0.0]]))
    rows = [{"cid": i, "copies": 1, "unit": x[i], "shards": np.array([i]), "probes": np.array([1 - i]), "near": np.zeros(0, np.int64)} for i in (0, 1)]
    a, b = (ed.pd.DataFrame([row]) for row in rows)
    first, second = ed.probe_links(a, b, 0, 0.95), ed.probe_links(b, a, 1, 0.95)
    assert first["links"].tolist() == [1, 1] and second["links"].tolist() == [0, 0]
    assert len(set(first["v"])) == len(set(second["v"])) == 1


def test_long_vectors_have_few_centroids(spark, monkeypatch):
    monkeypatch.setattr(ed, "SAMPLE_BYTES", 8 * 16 * 12)  # 12 sample rows of 16 dimensions, 3 centroids
    monkeypatch.setattr(ed, "SHARD_ROWS", 30)
    x = unit(np.random.default_rng(2).standard_normal((200, 16)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = ed.sharded(ed.nodes_of(df)[1])
    assert near.count() == 200 and max(max(r["shards"]) for r in near.collect()) < 3
