"""Decontamination against brute force over all pairs of rows and all stretches."""

import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import decontaminate as de


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(docs, items):
    out = Counter()
    for doc_id, text in docs:
        w = words_of(text)
        for item_id, item in items:
            own = words_of(item)
            if not own or not w:
                continue
            answer = words_of(item[de.answer_start(item) :])
            span, best = len(own) + len(own) // 3 + 4, None
            for a in range(len(w)):
                part = w[a : a + span]
                if len(set(part) & set(own)) == 0:
                    continue
                share = longest(own, part) / len(own)
                said = longest(answer, part) / max(1, len(answer))
                if share >= 0.6 - 1e-9 and (said >= 0.5 or share >= 0.85):
                    best = max(best or (0, 0), (share, said))
            if best:
                out[doc_id, item_id, round(best[0], 9), round(best[1], 9)] += 1
    return out


def found(spark, docs, items):
    rows = de.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(-1e-6 <= r["cosine"] <= 1 for r in rows)
    return Counter((r["doc_id"], r["item_id"], round(r["lcs_share"], 9), round(r["answer_share"], 9)) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    """Items of 1 to 90 words over a small vocabulary, and documents with verbatim, cut, shuffled and thinned-out copies."""
    r = np.random.default_rng(4)
    pool = [f"w{k}" for k in range(90)]
    often = 1 / np.arange(1, 91)
    often /= often.sum()
    items = [(k, " ".join(r.choice(pool, n, p=often)) + ". " + " ".join(r.choice(pool, max(1, n // 4), p=often))) for k, n in enumerate((1, 2, 5, 8, 12, 16, 20, 30, 40, 70))]
    items += [(90, "Photosynthesis"), (91, None), (92, " .. "), (None, "nothing has this name but one text"), (93, items[5][1])]
    docs = []
    for k in range(60):
        own = words_of(items[int(r.integers(0, 10))][1])
        kept = [w if r.random() < 0.5 + 0.5 * r.random() else f"x{k}" for w in own]
        if k % 5 == 0:
            r.shuffle(kept)
        text = list(r.choice(pool, r.integers(0, 80), p=often)) + kept + list(r.choice(pool, r.integers(0, 60), p=often))
        docs.append((k, " ".join(text)))
    docs += [
        (100, "photosynthesis"),
        (101, "and PHOTOSYNTHESIS, too"),
        (102, None),
        (103, ""),
        (None, items[6][1]),
        (104, "nothing has this name but one text"),
        (104, "nothing has this name but one text"),
    ]
    return docs, items


def test_leaks_equal_brute_force(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert {(100, 90), (101, 90), (None, 6), (104, None)} <= {k[:2] for k in want} and len(want) > 60


def test_small_slices_and_batches_give_the_same(corpus):
    docs, items = corpus
    for at_once, dense in ((3, 2), (1, 0)):
        held = de.AT_ONCE, de.DENSE
        de.AT_ONCE, de.DENSE = at_once, dense
        try:
            got = searched_here(docs, items)
        finally:
            de.AT_ONCE, de.DENSE = held
        assert got == brute(docs, items)
    words = [np.arange(k, k + 5) for k in range(0, 40, 2)]
    held = de.MOST_ITEMS, de.MOST_WORDS
    de.MOST_ITEMS, de.MOST_WORDS = 4, 9
    try:
        batches = list(de.batches_of(words))
    finally:
        de.MOST_ITEMS, de.MOST_WORDS = held
    assert sum(batches, []) == list(range(20)) and max(map(len, batches)) == 3


def searched_here(docs, items):
    """The search of one task, without Spark."""
    kept = [(i, t) for i, t in items if words_of(t)]
    tokens, answers = de.Tokens([t for _, t in kept]), de.Tokens([t[de.answer_start(t) :] for _, t in kept])
    vocabulary = de.Vocabulary(np.unique(tokens.hashes))
    rule, n = de.Rule(0.6, 0.5, 0.85), len(vocabulary.words)
    number = lambda t, i: np.searchsorted(vocabulary.words, t.hashes[t.first[i] : t.first[i + 1]]).tolist()
    own = [de.Item(i, number(tokens, k), number(answers, k)) for k, (i, _) in enumerate(kept)]
    r = np.random.default_rng(0)
    idf = r.uniform(0.1, 9, n)
    bands = [de.Band.of(
        b,
        [x for x in own if de.block_for(de.stretch(len(x.words))) == b],
        idf,
        np.linalg.qr(r.standard_normal((n, 3)))[0],
        rule,
    ) for b in sorted({de.block_for(de.stretch(len(x.words))) for x in own})]
    t = de.Tokens([d for _, d in docs])
    at, num = vocabulary.find(t.hashes)
    words = de.Passages(t.first, at, num, np.searchsorted(t.first, at, side="right") - 1)
    out = Counter()
    for band in bands:
        for (k, i), (share, answer, _) in band.search(words, rule).items():
            out[docs[k][0], band.items[i].item_id, round(share, 9), round(answer, 9)] += 1
    return out


def test_a_paraphrase_that_keeps_the_common_words(spark):
    """28 of 40 words in order, those that the corpus uses most; the rare ones are replaced."""
    r = np.random.default_rng(11)
    common = [f"c{k}" for k in range(28)]
    rare = [f"rare{k}" for k in range(12)]
    item = [w for k in range(28) for w in ([common[k], rare[k // 2]] if k % 2 and k // 2 < 12 else [common[k]])]
    passage = [w if w in common else f"other{i}" for i, w in enumerate(item)]
    noise = lambda n: [str(x) for x in r.choice(common, n)]
    docs = [(0, " ".join(noise(100) + passage + noise(100)))] + [(k, " ".join(noise(400))) for k in range(1, 30)]
    items = [(0, " ".join(item)), (1, " ".join(f"z{k}" for k in range(40)))]
    assert len(item) == 40
    got = found(spark, docs, items)
    assert got == brute(docs, items) and (0, 0) in {k[:2] for k in got}


def test_a_long_text_and_extra_columns(spark):
    r = np.random.default_rng(2)
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(r.choice([f"i{k}" for k in range(30)] + [f"y{k}" for k in range(900)], 150000)) + " " + item + " tail"
    df = spark.createDataFrame([(5, long, "x", 1), (6, "i1 i2", None, None)], "doc_id long, text string, ids string, number int")
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string")
    assert [(x["doc_id"], x["item_id"], x["lcs_share"]) for x in de.leaks(df, bench).collect()] == [(5, 1, 1.0)]
    with pytest.raises(ValueError, match="bytes"):
        held, de.MOST_BYTES = de.MOST_BYTES, 10
        try:
            de.leaks(df, bench)
        finally:
            de.MOST_BYTES = held


def test_latent_space_finds_the_leading_directions(spark):
    """Against a full SVD of the weighted passage matrix with one dominant topic."""
    r = np.random.default_rng(3)
    topic, other = [f"t{k}" for k in range(8)], [f"o{k}" for k in range(40)]
    docs = [(k, " ".join(r.choice(topic if k % 2 else other, 32))) for k in range(200)]
    vocabulary = de.Vocabulary(np.unique(de.Tokens([" ".join(topic + other)]).hashes))
    table = de.compact_passages(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary)
    n = len(vocabulary.words)
    idf, got = de.latent_space(table, np.arange(n, dtype=np.int32), n, 16)
    a = np.zeros((len(docs), n))
    for k, (_, t) in enumerate(docs):
        np.add.at(a[k], np.searchsorted(vocabulary.words, de.Tokens([t]).hashes), 1)
    want_idf = np.maximum(np.log1p(len(docs)) - np.log1p((a > 0).sum(0)), 0.1)
    assert np.allclose(idf, want_idf)
    want = np.linalg.svd(a * idf, full_matrices=False)[2][0]
    assert np.linalg.norm(got.T @ want) > 0.99
