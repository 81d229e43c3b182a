"""Language ID by string kernels.

Kernel: blended-spectrum presence kernel. A text is the set of its hashed byte n-grams (n = 1 to 4, lower-cased);
k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|). A Nystrom map on landmark texts and one-versus-rest kernel ridge
regression give one weight per landmark and language; a batch of texts is scored by two matrix products.

Training never brings a text to the driver: tasks turn the sample into landmark bitmaps and into the sums of the normal
equations, whose size depends on the landmarks and languages alone.

Cases: a text that is null or has no letter, and any text when nothing can be learned, is `und` with score 0; so an empty
table gives an empty result. Rows whose lang is null are never learned from. Of languages whose scores tie, the first by name
is taken. A text of any length is one set of at most 37,120 slots; its whole bytes are read. Extra columns of the input are
ignored. Repeated rows count as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, only, saved, summed

#: Slots per n-gram length (n = 1, 2, 3, 4); n = 1 is exact.
SLOTS = (256, 4096, 16384, 16384)
STARTS = np.concatenate([[0], np.cumsum(SLOTS)])
WORDLIKE = re.compile(r"[^\W\d_]")
BATCH = 64
#: More languages than this are an error: each has a landmark of 148 KB in the model that is broadcast.
MOST_LANGUAGES = 500


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def presence(text: str, row: np.ndarray) -> None:
    """Sets row (all zero) to 1 at every n-gram of the whole text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    row[b] = 1
    code = b.astype(np.uint32)
    for n in range(2, len(SLOTS) + 1):
        if len(b) < n:
            return
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(SLOTS[n - 1])))
        row[STARTS[n - 1] + hashed] = 1


def rows_of(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), int(STARTS[-1])), np.float32)
    for i, t in enumerate(texts):
        presence(t, x[i])
    return x


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x slots, each row divided by its norm
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        x = rows_of(texts)
        k = (x @ self.landmarks.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return k @ self.weights

    def closeness(self, texts: list[str]) -> np.ndarray:
        return self.told(texts)[0]

    def told(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The closeness of each text and the place of its language, that of the highest score.

        Closeness: the largest share |S(x) & S(y)| / min(|S(x)|, |S(y)|) of each text with a landmark, less what a presence vector as
        full as the text's shares by chance. It depends neither on the text's length nor on the number of languages."""
        x = rows_of(texts)
        level = self.landmarks.max(1)
        size = level.astype(np.float64) ** -2
        use = size >= np.median(size) / 2  # nearly any text holds a tiny landmark
        n = x.sum(1, dtype=np.float64)[:, None]
        product = x @ self.landmarks.T
        share = product[:, use] / level[use] / np.maximum(np.minimum(n, size[use]), 1)
        full = (n / x.shape[1]).ravel()
        scores = (product / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))) @ self.weights
        return np.where(full < 1, (share.max(1) - full) / np.maximum(1 - full, 1e-9), 1.0), scores.argmax(1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def features(marks: np.ndarray) -> np.ndarray:
    """The Nystrom map: from kernel values with the landmarks to features."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def equations(texts: list[str], langs: list[str], marks: np.ndarray, languages: list[str]) -> np.ndarray:
    """K'K beside K'Y of some training rows: K their kernel values with the landmarks, Y their languages as 0 and 1."""
    number = {lang: j for j, lang in enumerate(languages)}
    total = np.zeros((len(marks), len(marks) + len(languages)))
    for at in range(0, len(texts), BATCH):
        k = (unit_rows(rows_of(texts[at : at + BATCH])) @ marks.T).astype(np.float64)
        y = np.zeros((len(k), len(languages)))
        y[np.arange(len(k)), [number[lang] for lang in langs[at : at + BATCH]]] = 1
        total += k.T @ np.hstack([k, y])
    return total


def solved(marks: np.ndarray, languages: list[str], total: np.ndarray, n: int, ridge: float) -> Model:
    """One-versus-rest ridge regression from the normal equations of n rows."""
    to_features, m = features(marks), len(marks)
    gram, right = to_features.T @ total[:, :m] @ to_features, to_features.T @ total[:, m:]
    beta = np.linalg.solve(gram + ridge * n * np.eye(len(gram)), right)
    return Model(languages, marks, (to_features @ beta).astype(np.float32))


def fitted(texts: list[str], langs: list[str], landmarks: int = 64, ridge: float = 1e-3) -> Model | None:
    """Of rows at hand. Landmarks are dealt evenly over the languages, in the order given."""
    languages = sorted(set(langs))
    if not languages:
        return None
    share = max(1, landmarks // len(languages))
    marks = unit_rows(rows_of([texts[i] for lang in languages for i in [j for j, own in enumerate(langs) if own == lang][:share]]))
    return solved(marks, languages, equations(texts, langs, marks, languages), len(texts), ridge)


def sample(docs: DataFrame, may_learn, per_language: int) -> DataFrame:
    """lang, text and rank (from 1) of the `per_language` rows of each language with the smallest hash of doc_id and text that have
    a letter. may_learn: a condition on the rows."""
    rows = only(docs, "doc_id", "text", "lang").where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return rows.select("lang", "text", F.lit(1).alias("rank")).limit(0)
    order = F.xxhash64("doc_id", F.length("text")).bitwiseAND(F.lit((1 << 40) - 1))
    # a share of the hash range that holds enough rows of each language; the exact cut follows on the few rows kept
    share = {r["lang"]: int(min(1.0, (1.3 * per_language + 60) / r["count"]) * (1 << 40)) for r in counts}
    limit = F.create_map(*(F.lit(v) for pair in share.items() for v in pair))[F.col("lang")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    return rows.withColumn("o", order).where(F.col("o") <= limit).withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text", "rank")


def train(docs: DataFrame, may_learn, per_language: int = 200, landmarks: int = 64, ridge: float = 1e-3) -> Model | None:
    """Fits on the bounded sample of `per_language` rows a language; every language of the rows can be predicted."""
    rows = saved(sample(docs, may_learn, per_language), "language-sample")
    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]  # MOST_LANGUAGES at most
    if not languages:
        return None
    share = max(1, landmarks // len(languages))

    def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "rank": batch["rank"], "bits": [np.packbits(rows_of([t])[0] > 0).tobytes() for t in batch["text"]]})

    marks = rows.where(F.col("rank") <= share).mapInPandas(bitmaps, "lang string, rank int, bits binary").toPandas().sort_values(["lang", "rank"])
    marks = unit_rows(np.stack([np.unpackbits(np.frombuffer(x, np.uint8))[: STARTS[-1]] for x in marks["bits"]]).astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield equations(batch["text"].tolist(), batch["lang"].tolist(), shared.value, languages)

    total = summed(rows.select("lang", "text"), sums, (len(marks), len(marks) + len(languages)))
    return solved(marks, languages, total, rows.count(), ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            pred, best = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if m and has_letter(t)]
            for at in range(0, len(known), BATCH):
                own = known[at : at + BATCH]
                s = m.scores([texts[i] for i in own])
                for i, j, v in zip(own, s.argmax(1), s.max(1), strict=True):
                    pred[i], best[i] = m.languages[j], float(np.clip(v, 0, 1))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": pred, "score": best})

    return only(docs, "doc_id", "text").mapInPandas(score, "doc_id long, lang_pred string, score double")


def held_out_rows():
    """The rows kept from training: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, per_language: int = 200, landmarks: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    model = train(docs, ~held_out_rows(), per_language, landmarks=landmarks)
    return predict(docs, model).select("doc_id", held_out_rows().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The rows of docs whose text has a closeness of min_score or more to a landmark; lang is the language predicted from the
    text, whatever it was, all else is unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good, langs = np.zeros(len(texts), bool), [None] * len(texts)
            known = [i for i, t in enumerate(texts) if m and has_letter(t)]
            for at in range(0, len(known), BATCH):
                own = known[at : at + BATCH]
                closeness, places = m.told([texts[i] for i in own])
                good[own] = closeness >= min_score
                for i, j in zip(own, places, strict=True):
                    langs[i] = m.languages[j]
            columns = [pa.array(langs, pa.string()) if n == "lang" else batch.column(k) for k, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(good))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
