"""Stages of the corpus pipeline on small tables, against brute force."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import brute

import corpus_pipeline
from evidentia.llm import language_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghiklmnoprstu"), r.integers(2, 9))) for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_near(rows):
    """One row of each group of rows; rows of equal doc_id and text are one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, row in zip(group, rows):
        first.setdefault(g, row)
    return Counter(first.values())


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c, d, e = (prose(k, 80) for k in range(5))
    near = a.replace(a.split()[40], "changed")
    # repeated rows, nulls with and without a named copy, one doc_id of two texts, texts of their own
    rows = [
        (7, a),
        (7, a),
        (3, near),
        (None, a),
        (None, a),
        (5, b),
        (5, b),
        (5, b),
        (None, c),
        (None, c),
        (9, d),
        (9, a),
        (2, e),
        (4, "two words"),
        (4, "two words"),
    ]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(rows)], DOCS).repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == brute_near(rows) == Counter([
        (3, near),
        (5, b),
        (None, c),
        (9, d),
        (2, e),
        (4, "two words"),
    ])
    # the copy that stays is not cut by the next stage
    after = corpus_pipeline.repeated_passages(spark, kept, "")
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == brute_near(rows)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def syllables(r, parts, n):
    return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(n)).capitalize() + "."


def test_language_keeps_clean_texts_of_any_length(spark):
    r = np.random.default_rng(0)
    parts = {"en": ["the", "ing", "er", "an", "re", "tion", "ou", "th"], "de": ["sch", "ein", "ung", "ich", "keit", "von", "au", "ge"]}
    rows = [(i, syllables(r, parts[lang], 150), lang) for i in range(120) for lang in [("en", "de")[i % 2]]]
    short = [(1000 + i, syllables(r, parts[lang], n), lang) for i, (n, lang) in enumerate((n, lang) for n in range(1, 21) for lang in parts)]
    long = [(2000 + i, syllables(r, parts[lang], 20000), lang) for i, lang in enumerate(parts)]
    foreign = [(3000 + n, "".join(chr(c) for c in r.integers(0x3041, 0x9000, n)), None) for n in (5, 20, 100)]
    model = language_id.fitted([t for _, t, _ in rows], [lang for _, _, lang in rows])
    df = spark.createDataFrame([(i, t, lang, "x", len(t)) for i, t, lang in rows + short + long + foreign], DOCS)
    kept = {x["doc_id"] for x in language_id.recognised(df, model, corpus_pipeline.MIN_SCORE).collect()}
    assert kept == {i for i, _, _ in rows + short + long}


def brute_cut(texts):
    """Every 200-byte string that starts more than once goes; a character that is cut in part goes whole."""
    raws = [t.encode() for t in texts]
    count = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(np.frombuffer(r, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def test_all_stages_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(1)
    parts = {"en": ["the", "ing", "er", "an", "re", "tion", "ou", "th"], "de": ["sch", "ein", "ung", "ich", "keit", "von", "au", "gé"]}
    text = lambda lang, n: syllables(r, parts[lang], n)
    rows = [(i, text("en" if i % 2 else "de", int(r.integers(5, 120))), "en" if i % 2 else "de") for i in range(60)]
    passage, item = text("en", 60), text("de", 30)
    rows += [(100, rows[3][1], "en"), (101, rows[3][1].replace(" ", "  ", 3), "en"), (102, rows[4][1], "de"), (None, rows[5][1], "en"), (5, rows[5][1], "en")]
    rows += [(200 + k, text("en", 20) + " " + passage + " " + text("en", 25), "en") for k in range(5)]
    rows += [
        (300, text("de", 30) + " " + item + " " + text("de", 30), "de"),
        (301, " ".join("neu" if k % 6 == 0 else w for k, w in enumerate(item.split())), "de"),
    ]
    # a leak without an id, and a clean row that shares the id of a leak
    other = text("de", 30)
    rows += [(None, text("de", 40) + " " + other + " " + text("de", 20), "de"), (300, text("de", 70), "de")]
    rows += [(400, "漢字仮名交文" * 9, None), (401, None, "en"), (402, "12 34", "de"), (403, "", None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, item), (2, text("en", 25)), (3, None), (4, other)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    known = [(i, t) for i, t, _ in rows if t and any(c.isascii() and c.isalpha() for c in t)]
    kept = sorted(brute_near(known), key=lambda x: (x[0] is None, x[0] or 0))
    cut = list(zip([i for i, _ in kept], brute_cut([t for _, t in kept])))
    leaks = {k[0] for k in brute([(n, t) for n, (_, t) in enumerate(cut)], items)}
    named = [cut[n][0] for n in leaks]
    assert {300, 301, None} <= set(named) and named.count(300) == 1 < [i for i, _ in cut].count(300)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for n, (i, t) in enumerate(cut):
        if n not in leaks:
            ids = coder.encode_ordinary(t)
            want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())] += 1
    assert got == want and len(want) > 50 and any(len(t) < 500 for i, t in cut if i and 200 <= i < 205)


def test_languages_found_first_reach_the_last_stage(spark, tmp_path):
    """Labels that are missing or wrong; what the text tells goes on through all stages."""
    r = np.random.default_rng(3)
    parts = {"en": ["the", "ing", "er", "an", "re", "tion", "ou", "th"], "de": ["sch", "ein", "ung", "ich", "keit", "von", "au", "gé"]}
    truth = {i: ("en", "de")[i % 2] for i in range(60)}
    texts = {i: syllables(r, parts[lang], 80) for i, lang in truth.items()}
    wrong = {i: ("de", "en")[i % 2] for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}  # rows that are not learned from
    labels = truth | {i: None for i in range(40, 50)} | wrong
    assert len(wrong) > 5
    rows = [(i, texts[i], labels[i], "s", len(texts[i])) for i in truth]
    rows += [(1000, texts[44] + " more", None, "s", 1), (1001, "漢字仮名交文" * 9, "en", "s", 54)]  # a near copy, and no known language
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, syllables(r, parts["en"], 25))], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = {x["doc_id"]: x for x in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert {i: x["lang"] for i, x in found.items()} == truth | {1000: "en"}
    assert all((x["text"], x["source"], x["n_chars"]) == (t, s, n) for i, t, _, s, n in rows if (x := found.get(i)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["lang"] for x in got} == truth and len(got) == 60
