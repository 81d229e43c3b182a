"""Language ID: the kernel against sets, the regression against dense algebra, and accuracy on rows it never learned from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import language_id as li


def grams(text):
    b = text.lower().encode()
    return {(n, b[i : i + n]) for n in range(1, 5) for i in range(len(b) - n + 1)}


def test_kernel_equals_sets_of_grams():
    """Short texts seldom collide in the slots, so hashed sets are close to the sets of n-grams."""
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcdé "), r.integers(1, 40))) for _ in range(30)]
    x = li.unit_rows(li.rows_of(texts))
    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    off = np.abs(x @ x.T - want)
    assert off.mean() < 0.01 and off.max() < 0.1 and np.allclose(np.diag(x @ x.T), 1, atol=1e-5)


def test_regression_equals_dense_algebra():
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcdefg "), 60)) for _ in range(20)] + ["".join(r.choice(list("uvwxyz "), 60)) for _ in range(20)]
    langs = ["a"] * 20 + ["b"] * 20
    model = li.fitted(texts, langs, landmarks=8, ridge=1e-2)
    x = li.unit_rows(li.rows_of(texts)).astype(np.float64)
    marks = x[[*range(4), *range(20, 24)]]
    root = np.linalg.cholesky(np.linalg.pinv(marks @ marks.T))  # any square root gives the same predictions
    phi = x @ marks.T @ root
    y = np.array([[lang == "a", lang == "b"] for lang in langs], float)
    want = phi @ np.linalg.solve(phi.T @ phi + 1e-2 * 40 * np.eye(8), phi.T @ y)
    assert np.allclose(model.scores(texts), want, atol=1e-3)


def test_distributed_training_equals_that_of_rows_at_hand(spark):
    r = np.random.default_rng(3)
    rows = [(
        k,
        "".join(r.choice(list("abcdefg " if k % 3 else "mnopqrs "), 80)),
        "x" if k % 3 else "y",
    ) for k in range(60)] + [(90, "12", "x"), (91, None, "y"), (92, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df, F.lit(True), per_language=15, landmarks=6)
    few = [(x["lang"], x["rank"], x["text"]) for x in li.sample(df, F.lit(True), 15).collect()]
    assert len(few) == 30 and {x[0] for x in few} == {"x", "y"}
    few.sort()
    at_hand = li.fitted([t for *_, t in few], [lang for lang, *_ in few], landmarks=6)
    texts = [t for _, t, _ in rows[:60]]
    assert model.languages == ["x", "y"] and np.allclose(model.scores(texts), at_hand.scores(texts), atol=1e-4)


def test_accuracy_on_held_out_rows(spark):
    """Of the driver's own small table: rows that were never learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_edges(spark):
    assert [li.has_letter(t) for t in (None, "", "12 ²½ _", "é", "日", "1a")] == [False, False, False, True, True, True]
    long = "the quick brown fox " * 100000
    df = spark.createDataFrame(
        [(1, long, "en", 0), (2, "der schnelle fuchs und so", "de", 0), (3, "", None, 0), (None, None, None, None)],
        "doc_id long, text string, lang string, score int",
    )
    got = {x["doc_id"]: x["lang_pred"] for x in li.predict(df, li.train(df, F.lit(True))).collect()}
    assert got == {1: "en", 2: "de", 3: "und", None: "und"}
    held, li.MOST_LANGUAGES = li.MOST_LANGUAGES, 1
    try:
        with pytest.raises(ValueError, match="languages"):
            li.train(df, F.lit(True))
    finally:
        li.MOST_LANGUAGES = held


def test_ties_take_the_first_language(spark):
    df = spark.createDataFrame([(1, "same text here", "b"), (2, "same text here", "a")], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in li.predict(df, li.train(df, F.lit(True))).collect()} == {"a"}
