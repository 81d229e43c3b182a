"""Operators 11 to 13 against brute force, finite differences and held-out accuracy."""

import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import importance, spelling, toxicity

CLASHING = "doc_id long, text string, word string, n long, row long, rank long, score double, toxic int, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11


def one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(docs, every=199, least_length=6, least_count=5, times=5):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root))
    return rows


def edited(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abcéß")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def variant_docs(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéß") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), len(stems) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                w = edited(rng, w) if len(w) > 1 else w
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(2000 + i, "hijklm " * 40 + "hijklo " * 6 + "hijkoo ") for i in range(10)]  # a form of a form
    return [*rows, rows[3], (7, None), (8, ""), (9, "123 !"), (10, "x" * 30 + " É×÷ÿéé " * 9)]


@pytest.mark.parametrize(("tile", "block"), [(4096, 256), (16, 8)])
def test_variants_equal_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = variant_docs(block)
    df = spark.createDataFrame([(*r, "w", 1, 2, 3, 0.5, 1, "en") for r in docs], CLASHING).repartition(3)
    got = spelling.spelling_variants(df, every=19).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(docs, every=19)
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want) > 100
    assert any(r[3] for r in want) and any(r[5] != r[0] and r[5] != r[3] for r in want)


def test_tiles_find_every_pair_once():
    """Without Spark: blocks of any size over sorted groups."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(200)})
    assert {spelling.slipped(1, w, 0, 1 << 40) for w in words} == set(words)
    for x in words[:40]:
        for y in words[:40]:
            b = max(len(x), len(y))
            a, c = spelling.matrix([x, y], False), spelling.matrix([x, y], True)
            prefix = int(spelling.common(a[:, :1], a[:, 1:], range(b))[0, 0])
            suffix = int(spelling.common(c[:, :1], c[:, 1:], range(b - 1, -1, -1))[0, 0])
            assert (x != y and abs(len(x) - len(y)) <= 1 and prefix + suffix >= b - 1) == one_edit(x, y)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Wörter, wörter und Wort " * 400 + "a" * 5000 + "é"
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "PIECE_CHARS", 37)
    assert spelling.runs_of(text) == whole
    whole = importance.bucket_counts(text, 100, 3)
    monkeypatch.setattr(importance, "PIECE_BYTES", 29)
    again = importance.bucket_counts(text, 100, 3)
    assert whole[0] == again[0] and (whole[1] == again[1]).all() and (whole[2] == again[2]).all()


def test_variants_of_an_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], CLASHING)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
    # words of one group, none of them near another
    far = spark.createDataFrame([(1, "abcdef " * 5 + "abcxyz " * 6)], "doc_id long, text string")
    assert {tuple(r) for r in spelling.spelling_variants(far, every=1 << 40).select("word", "n_near", "root").collect()} == {("abcdef", 0, "abcdef"), ("abcxyz", 0, "abcxyz")}


# --- 13


def brute_draw(docs, target, buckets, ngrams, percent=10, least_words=20):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def draw_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(50)] + ["Alpha", "beta9", "漢字", "ß"]
    docs = []
    for i in range(300):
        docs.append((i if i % 40 else None, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 60, 300])))))
    return [*docs, docs[4], docs[4], docs[5], (1000, None), (1001, ""), (1002, "!? \x00")], [" ".join(rng.choices(vocabulary[:9], k=30)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize(("buckets", "ngrams", "percent"), [(10000, 1, 10), (70, 2, 100), (7, 3, 33)])
def test_draw_equals_brute_force(spark, buckets, ngrams, percent):
    docs, target = draw_docs(buckets)
    df = spark.createDataFrame([(*r, "w", 1, 2, 3, 0.5, 1, "en") for r in docs], CLASHING).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    got = importance.importance_resample(df, aim, buckets, ngrams, percent).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(docs, target, buckets, ngrams, percent)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(2)
    for buckets in (1, 63, 64, 65, 1000):
        own = np.sort(rng.choice(buckets, min(buckets, 40), replace=False))
        counts = rng.integers(1, 1 << 30, len(own))
        gain = rng.integers(-(1 << 20), 1 << 20, buckets)
        planes = importance.planes_of(own, counts, buckets)
        assert importance.gain_sums([b"", planes], importance.gain_planes(gain), buckets) == [0, int((counts * gain[own]).sum())]


def test_draw_of_empty_tables(spark):
    empty = spark.createDataFrame([], CLASHING)
    assert importance.importance_resample(empty, empty).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance.importance_resample(one, empty, percent=100).collect()] == [1]


# --- 12


def toxic_docs(seed, n=600):
    rng = random.Random(seed)
    words = {"en": [f"{a}{b}" for a in ("the", "on", "ing", "er") for b in ("an", "st", "re", "ly", "ou")], "de": [f"{a}{b}" for a in ("ein", "sch", "ung") for b in ("ver", "be", "zu", "tz")]}
    bad = {"en": ["vile", "rotten"], "de": ["mistkerl", "mistding", "mistvieh"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = rng.choices(words[lang], k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 3)):
            text[rng.randrange(len(text))] = rng.choice(bad[lang])
        rows.append((i, " ".join(text) + ".", lang, toxic))
    return rows


def test_held_out_labels_are_told(spark):
    rows = toxic_docs(3)
    docs = spark.createDataFrame([(*r[:3], -1, 9.0) for r in rows], "doc_id long, text string, lang string, predicted int, score double").repartition(3)
    docs = docs.union(spark.createDataFrame([(9001, None, None, 1, 0.0), (9002, "", "en", 1, 0.0), (None, "vile", None, 1, 0.0), (9003, "1 2 3", "xx", 1, 0.0)], docs.schema))
    labels = spark.createDataFrame([(r[0], r[3], "x") for r in rows] + [(None, 1, "x"), (5, None, "x"), (77777, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if by_id[r[0]]["held_out"]]
    right = [by_id[r[0]]["predicted"] == r[3] for r in held]
    assert sum(right) >= 0.95 * len(right) and {r[3] for r in held} == {0, 1}
    assert by_id[9001]["score"] == by_id[9002]["score"] == by_id[9003]["score"]


def test_labels_of_held_out_rows_and_language_labels_change_no_score(spark):
    rows = toxic_docs(4, 200)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").coalesce(1)
    marks = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int").coalesce(1)
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out_rows(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.when(toxicity.held_out_rows(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(d, m).collect()} for d, m in ((docs, marks), (other, flipped)))
    assert a == b


def test_one_label_and_no_label(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, ones).collect()} == {1.0}
    assert toxicity.toxicity(docs.limit(0), ones).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh(rng)
    net.table = net.table.astype(np.float64)
    net.kernels, net.dense = [k.astype(np.float64) for k in net.kernels], net.dense.astype(np.float64)
    slots = rng.integers(0, 50, (9, 3))

    def loss():
        pooled = np.zeros(len(net.dense))
        net.pooled(net.embedded(slots), pooled)
        return math.log1p(math.exp(-net.logit(pooled)))  # label 1

    rows, steps, kernels, _, dense, wrong = net.gradients(slots, 1.0)
    table = np.zeros_like(net.table)
    np.add.at(table, rows, steps)
    for value, grad in ((net.table, table), (net.dense, dense), *zip(net.kernels, kernels, strict=True)):
        for at in list(zip(*np.nonzero(grad), strict=True))[:12]:
            before, here = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = before + d
                here.append(loss())
            value[at] = before
            assert abs((here[0] - here[1]) / 2e-5 - grad[at]) < 1e-4
    assert wrong < 0


def test_a_text_is_scored_whole_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh(rng)
    langs = toxicity.Languages(["a", "b"], rng.normal(0, 1, (toxicity.SLOTS, 2)).astype(np.float32))
    text = " ".join(f"w{i % 97}é b{i % 13}" for i in range(900))
    whole = toxicity.Reader(net, langs).read(text)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 50)
    monkeypatch.setattr(toxicity, "VOCABULARY", 20)
    parts = toxicity.Reader(net, langs).read(text)
    assert abs(whole[0] - parts[0]) < 1e-4 and whole[1] == parts[1]
    assert toxicity.Reader(net, langs).read(None) == toxicity.Reader(net, langs).read(" 12 ") == (net.bias, -1)


def test_all_labelled_rows_and_whole_texts_teach(spark):
    """More rows than a sample would hold; each is in one block, whole."""
    rows = toxic_docs(6, 5600)
    rows.append((7001, " ".join(f"ab{chr(97 + i % 26)}" for i in range(30000)), None, 0))
    marks = [(r[0], r[3]) for r in rows] + [(1, 1 - rows[1][3]), (99999, 1), (None, 0)]
    docs = spark.createDataFrame([*[r[:3] for r in rows], (2, "again", "en")], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    want = sorted(
        (toxic, len(re.findall("[a-z]+", text))) for i, toxic in marks for j, text in [*[r[:2] for r in rows], (2, "again")] if i == j and zlib.crc32(str(i).encode()) % 5
    )
    blocks = toxicity.blocks_of(docs, labels, 1600).collect()
    got = [(int(t), int(n)) for b in blocks for t, n in zip(np.frombuffer(b["toxic"], np.int8), np.frombuffer(b["lengths"], np.int64), strict=True)]
    assert sorted(got) == want and len(want) > 4400 and len(blocks) == 3
    assert all(len(b["slots"]) == 6 * np.frombuffer(b["lengths"], np.int64).sum() and len(b["langs"]) == len(b["toxic"]) for b in blocks)
    # copies that are averaged tell the labels, however the input is dealt
    found = [{(r["doc_id"], r["score"]): r for r in toxicity.toxicity(d, labels, 1600).collect()} for d in (docs, docs.repartition(7))]
    assert set(found[0]) == set(found[1])
    toxic = {r[0]: r[3] for r in rows if r[0] != 2}
    held = [r for r in found[0].values() if r["held_out"] and r["doc_id"] in toxic]
    assert len(held) > 1000 and sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_labels_of_long_texts_are_learned(spark):
    """Texts of 6,000 words; the toxic ones have one word that tells them."""
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice(("other", "words", "here", "stand")) for _ in range(6000)]) for i in range(60)]
    for _, toxic, words in rows:
        words[rng.randrange(6000)] = "vile" if toxic else "mild"
    docs = spark.createDataFrame([(i, " ".join(w), "en") for i, _, w in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert found == {r[0]: r[1] for r in rows}


def test_stretches_change_no_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh(rng)
    slots = rng.integers(0, toxicity.SLOTS, (500, 3)).astype(np.uint16)
    whole, pooled = net.best(slots), np.zeros(len(net.dense), np.float32)
    net.pooled(net.embedded(slots), pooled)
    assert np.allclose(whole[0], pooled, atol=1e-5)
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    parts = net.best(slots)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and all((a == b).all() for a, b in zip(whole[1], parts[1], strict=True))
    cells = toxicity.pd.DataFrame({"lang": [0, 0, 1, 1], "cell": [-512, 511, -256, 1023], "ones": [0, 90, 0, 30], "zeros": [90, 0, 30, 0]})
    common, each = toxicity.calibrated(cells, 3)
    assert common == (-256 + 511 + 1) / 512 and abs(each[0] - 0.1 * common) < 1e-9 and each[2] == common


def test_words_are_hashed_side_by_side(monkeypatch):
    """Calls of Python functions do not grow with the words of a text, new ones included."""
    net = toxicity.Network.fresh(np.random.default_rng(4))
    reader = toxicity.Reader(net, toxicity.Languages(["a"], np.zeros((toxicity.SLOTS, 1), np.float32)))

    def calls(n):
        text, seen = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}é" for i in range(n)), [0]

        def count(*_):
            seen[0] += 1

        sys.setprofile(count)
        try:
            reader.read(text)
        finally:
            sys.setprofile(None)
        return seen[0]

    calls(10)
    assert calls(6000) < calls(10) + 1500


@pytest.mark.parametrize(("words", "chars", "short"), [(1 << 16, 1 << 18, 64), (7, 40, 5)])
def test_slots_are_crc32_of_words_and_stems(monkeypatch, words, chars, short):
    monkeypatch.setattr(toxicity, "VOCABULARY", words)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", chars)
    monkeypatch.setattr(toxicity, "SHORT", short)
    long = "x" * 64 + " " + "é" * 33 + " " + "ab" * 5000
    texts = [None, "", "12 _", "Ärger a_b x²½ İstanbul ΣΑΣ", long, "漢字かな \U00010400\U00010428b \U0001f600a \ud800z", "ab", *["Wort word mot " * 30] * 5, " "]
    got = [[] for _ in texts]
    for i, slots in toxicity.slots_of_texts(texts):
        got[i] += slots.tolist()

    def of(part, first=0):
        return zlib.crc32(part.encode("utf-8", "surrogatepass"), first) % toxicity.SLOTS

    assert got == [[[of(w), *(of(w[:k], k) for k in toxicity.STEMS)] for w in re.findall(r"[^\W\d_]+", (t or "").lower())] for t in texts]


def test_gradients_of_a_batch_are_the_weighted_sum():
    rng = np.random.default_rng(6)
    net = toxicity.Network.fresh(rng)
    texts = [rng.integers(0, 90, (n, 3)).astype(np.uint16) for n in (1, 2, 3, 40, 1500)]
    labels, weights = rng.integers(0, 2, 5).astype(float), rng.random(5) + 0.5
    rows, steps, *got = net.batch_gradients(texts, labels, weights)
    table, want = np.zeros((2, *net.table.shape)), 0
    np.add.at(table[0], rows, steps)
    for slots, label, weight in zip(texts, labels, weights, strict=True):
        own_rows, own_steps, *own = net.gradients(slots, label)
        np.add.at(table[1], own_rows, own_steps * weight)
        want = want + weight * np.concatenate([np.ravel(v) for v in (*own[0], *own[1], own[2], own[3])])
    assert np.allclose(table[0], table[1], atol=1e-6)
    assert np.allclose(np.concatenate([np.ravel(v) for v in (*got[0], *got[1], got[2], got[3])]), want, atol=1e-5)
