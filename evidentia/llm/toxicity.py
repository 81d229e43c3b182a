"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy by Spark tasks.

A text is its words (runs of letters, lower-cased). A word is embedded as the sum of hashed embeddings: of itself and of
its first code points, so that compounds of one stem are alike. Filters of several widths run over the words and are max-pooled over the
whole text; a linear layer gives a logit. As pooling takes the largest value wherever it stands, a text of any length is
learned and scored whole, stretch by stretch, with the stretches overlapping by the widest filter less one.

All labelled rows that may be learned from teach the network, the languages and the thresholds, with their whole texts. The
rows, as word numbers, are dealt by a hash into blocks of some `block_rows` rows (fewer where texts are long), a written row each. In a round, tasks train
a copy of the network on each block, and the copies are averaged: a slot over the blocks that changed it, all else over all
blocks. What comes to the driver has the size of the network. Averages are of fixed-point numbers, so that they do not
depend on how blocks meet in tasks. One block needs no rounds: its task makes all passes.
Then a threshold is calibrated for each language, from counts of all rows by label and logit (in cells of 1 / CELLS): the one that tells
labels apart best, taken as the middle of the best gap and drawn towards the common one where a language has few rows. A text's
language is what a word-frequency model of the rows with non-null languages makes of its words; a language label never reaches a score. The
score is the logistic function of logit less threshold.

Cases: null, empty and wordless texts have no words: all filters pool to 0, and the score is that of the last bias. Rows with null
labels or ids are never learned from; a doc_id with several labels counts once for each. If no row or only one label can be
learned from, the score of every text is the share of that label (0 without any). More than MOST_LANGUAGES languages are an
error, as each takes 128 KB of the model that is broadcast. An empty table gives an empty result. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, only, saved, summed

WORD = re.compile(r"[^\W\d_]+")
#: Whether a code point of up to 16 bits is part of a word.
LETTERS = np.array([WORD.match(chr(c)) is not None for c in range(1 << 16)])
#: Slots of the embedding table, its width, filters of each width, and code points of the stems that are hashed.
SLOTS, DIM, FILTERS, WIDTHS, STEMS = 1 << 15, 16, 16, (1, 2, 3), (4, 6)
#: Words that are hashed at once, characters of text that are split at once.
VOCABULARY, PIECE_CHARS = 1 << 16, 1 << 18
#: Bytes of a word at most that are hashed beside those of other words; the steps of crc32 by byte.
SHORT, CRC = 64, np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
#: Words of a text that the filters run over at once; what they give fits into a core's cache.
STRETCH = 1 << 10
#: Bytes of text, about, that a block of learned rows holds at most; languages at most.
BLOCK_BYTES, MOST_LANGUAGES = 1 << 26, 500
#: Cells of logits for each unit, the largest logit told apart, and the units of averages.
CELLS, LARGEST, UNITS = 256, 32, 1 << 24
#: Texts seen in training, all passes together, and the fewest and most passes.
VISITS, PASSES = 14000, (4, 40)
BATCH, RATE, DROP, DECAY = 32, 0.06, 0.2, 1e-4


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """zlib.crc32(data[start : start + length], first) of each stretch of bytes (all longer than 0), many side by side."""
    out = np.empty(len(starts), np.uint32)
    for begin in range(0, len(starts), VOCABULARY):
        at, length, crc = (x[begin : begin + VOCABULARY] for x in (starts, lengths, out))
        order = np.argsort(np.minimum(length, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
        more = len(order) - np.cumsum(np.bincount(np.minimum(length, SHORT + 1), minlength=SHORT + 1))  # stretches longer than i
        long = int(more[SHORT])
        here, state = at[order], np.full(len(order), first ^ 0xFFFFFFFF, np.uint32)
        for i in range(SHORT):
            if more[i] == long:
                break
            own = state[long : more[i]]
            own[:] = CRC.take((own ^ data.take(here[long : more[i]] + i)) & 255) ^ (own >> 8)
        crc[order] = ~state
        for k in order[:long]:
            crc[k] = zlib.crc32(data[at[k] : at[k] + length[k]], first)
    return out


def slots_of(pieces: list[str]) -> list[np.ndarray]:
    """Slots of each word of lower-cased pieces of text and of its stems (a row a word); each kind is hashed apart."""
    joined = " ".join(pieces)
    if len(joined) > 2 * PIECE_CHARS:  # one piece that ends in a very long word: no arrays of its code points
        kinds = [[zlib.crc32(w[:k].encode("utf-8", "surrogatepass"), k or 0) for k in (None, *STEMS)] for w in WORD.findall(joined)]
        return [np.array(kinds, np.int64).reshape(-1, 1 + len(STEMS)) % SLOTS]
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = LETTERS.take(codes, mode="clip")
    for i in np.flatnonzero(codes >= len(LETTERS)):
        letter[i] = WORD.match(chr(codes[i])) is not None
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    at = np.zeros(len(codes) + 1, np.int64)  # the byte at which each code point starts
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64), out=at[1:])
    begin = at[starts]
    kinds = [crc32s(data, begin, at[ends] - begin, 0)]
    kinds += [crc32s(data, begin, at[np.minimum(starts + k, ends)] - begin, k) for k in STEMS]
    slots = (np.array(kinds, np.int64) % SLOTS).T
    return np.split(slots, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces[:-1]])))


def pieces_of(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """The texts, lower-cased, in pieces that end between words, each with the place of its text."""
    for i, text in enumerate(texts):
        lowered, start = (text or "").lower(), 0
        while start < len(lowered):
            end = min(len(lowered), start + PIECE_CHARS)
            while end < len(lowered) and WORD.match(lowered, end - 1, end + 1):
                end += 1
            yield i, lowered[start:end]
            start = end


def slots_of_texts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Slots (words x kinds) of all words of the texts, by piece, each with the place of its text; short pieces are hashed together."""
    held, size = [], 0
    for i, piece in pieces_of(texts):
        if held and size + len(piece) > PIECE_CHARS:
            yield from zip([i for i, _ in held], slots_of([p for _, p in held]), strict=True)
            held, size = [], 0
        held.append((i, piece))
        size += len(piece)
    if held:
        yield from zip([i for i, _ in held], slots_of([p for _, p in held]), strict=True)


@dataclass
class Network:
    table: np.ndarray  # SLOTS x DIM
    kernels: list[np.ndarray]  # for each width w: w x DIM x FILTERS
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        table = rng.normal(0, 0.1, (SLOTS, DIM)).astype(np.float32)
        kernels = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(table, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def embedded(self, slots: np.ndarray) -> np.ndarray:
        """A row per word, from its row of slots."""
        x = self.table.take(slots[:, 0], 0)
        for kind in range(1, slots.shape[1]):
            x += self.table.take(slots[:, kind], 0)
        return x

    def responses(self, words: np.ndarray) -> list[np.ndarray | None]:
        """Of a stretch of consecutive words (rows of embedded()), for each width, the filters' values without their biases: a row per
        filter and a column per place (None where the stretch is too short)."""
        every = np.concatenate([k[j] for w, k in zip(WIDTHS, self.kernels, strict=True) for j in range(w)], axis=1).T
        each, first, found = every @ words.T, 0, []  # places along rows, where sums and maxima are fast
        for w in WIDTHS:
            parts = [each[(first + j) * FILTERS : (first + j + 1) * FILTERS, j : len(words) - w + 1 + j] for j in range(w)] if len(words) >= w else [None]
            z = parts[0]
            for part in parts[1:]:
                z = z + part
            found.append(z)
            first += w
        return found

    def pooled(self, words: np.ndarray, out: np.ndarray) -> None:
        """Raises out to the filters' largest values over consecutive words (rows of embedded()), at least 0."""
        for start in range(0, len(words), STRETCH):
            for k, z in enumerate(self.responses(words[start : start + STRETCH + WIDTHS[-1] - 1])):
                if z is not None:
                    own = out[k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(own, z.max(1) + self.biases[k], out=own)

    def logit(self, pooled: np.ndarray) -> float:
        return float(pooled @ self.dense) + self.bias

    def best(self, slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The pooled values of a whole text, and for each width the place at which each filter's largest value starts."""
        out = np.zeros(len(self.dense), np.float32)
        top = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        where = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
        for start in range(0, len(slots), STRETCH):
            for k, z in enumerate(self.responses(self.embedded(slots[start : start + STRETCH + WIDTHS[-1] - 1]))):
                if z is not None:
                    at = z.argmax(1)
                    value = z[np.arange(FILTERS), at]
                    where[k] = np.where(value > top[k], at + start, where[k])
                    top[k] = np.maximum(value, top[k])
        for k in range(len(WIDTHS)):
            out[k * FILTERS : (k + 1) * FILTERS] = np.maximum(top[k] + self.biases[k], 0)
        return out, where

    def gradients(self, slots: np.ndarray, label: float) -> tuple:
        """Those of one text."""
        return self.batch_gradients([slots], np.array([label]), np.ones(1))

    def batch_gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple:
        """Of the weighted sum of the texts' cross entropies: (slots of words, a row of steps for each word), kernels, biases, dense, bias.
        Only the windows that were pooled matter."""
        found = [self.best(slots) for slots in texts]
        out, where = np.stack([o for o, _ in found]), np.stack([np.concatenate(w) for _, w in found])
        logits = np.array([float(o @ self.dense) + self.bias for o in out])
        wrong = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels
        back = np.where(out > 0, wrong[:, None] * self.dense, 0).astype(np.float32)
        # the words of all pooled windows of a text: by width, place in the window and filter
        rows = np.stack([slots.take(at[FILTER_OF] + PLACE_OF, 0, mode="clip") for slots, at in zip(texts, where, strict=True)])
        used = back.reshape(len(texts), len(WIDTHS), FILTERS).any(2)[:, FILTER_OF // FILTERS]
        own = back[:, FILTER_OF, None]
        words = self.embedded(rows.reshape(-1, rows.shape[2])).reshape(*own.shape[:2], DIM)
        every = np.concatenate([k[j].T for w, k in zip(WIDTHS, self.kernels, strict=True) for j in range(w)])
        steps = every * own * weights[:, None, None]
        total = (words * own * weights[:, None, None]).sum(0)
        ends = np.cumsum([w * FILTERS for w in WIDTHS])
        kernels = [total[end - w * FILTERS : end].reshape(w, FILTERS, DIM).transpose(0, 2, 1) for w, end in zip(WIDTHS, ends, strict=True)]
        biases = np.split((back * weights[:, None]).sum(0), len(WIDTHS))
        dense = (wrong[:, None] * out * weights[:, None]).sum(0)
        return rows[used], steps[used][:, None], kernels, biases, dense, float((wrong * weights).sum())


#: For each word of the windows that all filters pool: the filter, and the word's place in the window.
FILTER_OF = np.array([k * FILTERS + f for k, w in enumerate(WIDTHS) for _ in range(w) for f in range(FILTERS)])
PLACE_OF = np.array([j for w in WIDTHS for j in range(w) for _ in range(FILTERS)])


@dataclass
class State:
    """A network in training, and the sums of its squared steps: of each slot, of the other parameters."""

    net: Network
    seen: list[np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> State:
        net = Network.fresh(np.random.default_rng(seed))
        return cls(net, [np.full(SLOTS, 1e-3, np.float32), *(np.full_like(v, 1e-3) for v in (*net.kernels, *net.biases, net.dense)), np.full(1, 1e-3)])

    def copy(self) -> State:
        net = self.net
        own = Network(net.table.copy(), [k.copy() for k in net.kernels], [b.copy() for b in net.biases], net.dense.copy(), net.bias)
        return State(own, [s.copy() for s in self.seen])

    def flat(self) -> np.ndarray:
        """All but the slots as one row: parameters, then their sums."""
        net = self.net
        return np.concatenate([np.ravel(v).astype(np.float64) for v in (*net.kernels, *net.biases, net.dense, [net.bias], *self.seen[1:])])

    def take(self, flat: np.ndarray) -> None:
        """Sets what flat() gives."""
        net, at = self.net, 0
        for value in (*net.kernels, *net.biases, net.dense, None, *self.seen[1:]):
            if value is None:
                net.bias, at = float(flat[at]), at + 1
            else:
                value[...] = flat[at : at + value.size].reshape(value.shape)
                at += value.size


def learn(state: State, texts: list[np.ndarray], labels: np.ndarray, share: float, passes: int, seed: int) -> np.ndarray:
    """Adaptive gradient steps over mini-batches, in place; the rarer label weighs more (share: of label 1 among all rows), and
    some words are left out of each pass. Gives the slots that were changed."""
    rng, net, seen = np.random.default_rng(seed), state.net, state.seen
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    touched = np.zeros(SLOTS, bool)

    def step(value: np.ndarray, grad: np.ndarray, square: np.ndarray) -> None:
        grad = grad / BATCH + DECAY * value
        square += grad * grad
        value -= RATE * grad / np.sqrt(square)

    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = []
            for i in order[at : at + BATCH]:
                slots = texts[i]
                if len(slots) > 1:
                    slots = slots[rng.random(len(slots), np.float32) >= DROP]
                if len(slots):
                    batch.append((i, slots))
            if not batch:
                continue
            own = [i for i, _ in batch]
            rows, steps, *grads, bias = net.batch_gradients([slots for _, slots in batch], labels[own], weight[own])
            totals = (*grads[0], *grads[1], grads[2])
            by_slot = np.argsort(rows, axis=None, kind="stable")
            ordered = rows.ravel()[by_slot]
            starts = np.flatnonzero(np.diff(ordered, prepend=-1))
            used = ordered[starts]
            grad = np.add.reduceat(steps[by_slot // rows.shape[1], 0], starts) / np.float32(BATCH) if len(starts) else np.zeros((0, DIM))
            seen[0][used] += (grad * grad).mean(1)
            net.table[used] -= RATE * grad / np.sqrt(seen[0][used])[:, None]
            touched[used] = True
            for value, total, square in zip((*net.kernels, *net.biases, net.dense), totals, seen[1:-1], strict=True):
                step(value, total.astype(np.float32), square)
            bias /= BATCH
            seen[-1] += bias * bias
            net.bias -= RATE * bias / float(seen[-1][0]) ** 0.5
    return touched


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # SLOTS x languages: log of the share of each slot

    def likelihoods(self, slots: np.ndarray) -> np.ndarray:
        """Of a text in each language, as a log."""
        total = np.zeros(len(self.names))
        for start in range(0, len(slots), STRETCH):
            total += self.logs.take(slots[start : start + STRETCH, 0], 0).sum(0, dtype=np.float64)
        return total


def threshold(values: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The middle of the gap at which as few labels as possible are told wrong, both labels weighing alike; of several, the widest.
    values: distinct and ascending logits; ones, zeros: rows of each label there."""
    # the cut after place i: ones up to it are missed, zeros beyond it are false alarms, which count twice
    wrong = np.cumsum(ones)[:-1] / max(ones.sum(), 1) + 2 * (zeros.sum() - np.cumsum(zeros)[:-1]) / max(zeros.sum(), 1)
    if not len(wrong):
        return float(values.mean()) if len(values) else 0.0
    gap = np.diff(values)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = best[gap[best].argmax()]
    return float((values[i] + values[i + 1]) / 2)


@dataclass
class Model:
    share: float  # of label 1 among the learned rows; the score of all texts where there is no network
    network: Network | None
    languages: Languages | None
    common: float
    thresholds: np.ndarray  # one per language


@dataclass
class Reader:
    """Reads whole texts with a model."""

    network: Network
    languages: Languages

    def read_all(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """Of each text the logit, and the place of the likeliest language by its words (-1 without words or languages)."""
        out, nothing = [], np.zeros((0, 1 + len(STEMS)), np.int64)
        pooled, total, tail = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(self.languages.names)), nothing

        def close() -> None:
            nonlocal pooled, total, tail
            out.append((self.network.logit(pooled), int(total.argmax()) if len(tail) and len(total) else -1))
            pooled, total, tail = np.zeros_like(pooled), np.zeros_like(total), nothing

        for i, slots in slots_of_texts(texts):
            while len(out) < i:
                close()
            if len(slots):
                whole = np.concatenate([tail, slots]) if len(tail) else slots
                self.network.pooled(self.network.embedded(whole), pooled)
                total += self.languages.likelihoods(slots)
                tail = whole[-(WIDTHS[-1] - 1) :]
        while len(out) < len(texts):
            close()
        return out

    def read(self, text: str | None) -> tuple[float, int]:
        return self.read_all([text])[0]


def scores(model: Model, texts: list[str | None], reader: Reader | None) -> list[float]:
    if model.network is None:
        return [model.share] * len(texts)
    out = []
    for z, lang in reader.read_all(texts):
        z -= model.thresholds[lang] if lang >= 0 else model.common
        out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return out


#: Rows of a label that a language needs before its own threshold counts as much as the common one.
FEW = 10


def held_out_rows():
    """The rows kept from training: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def blocks_of(docs: DataFrame, labels: DataFrame, block_rows: int) -> DataFrame:
    """All labelled rows that may be learned from, dealt into blocks by a hash of doc_id and text, a row each: block, ones and zeros (rows of
    each label), toxic (a byte a row), lengths (words of each row), slots (of all words, in order) and langs."""
    marks = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out_rows()).distinct()
    rows = only(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL").where(~held_out_rows())
    n = marks.count()
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-n // block_rows), -(-n * size["bytes"] // max(size["rows"], 1) // BLOCK_BYTES))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = [[] for _ in range(len(batch))]
            for i, found in slots_of_texts(batch["text"].tolist()):
                slots[i].append(found.astype(np.uint16).tobytes())
            yield batch.drop(columns="text").assign(slots=[b"".join(x) for x in slots])
        give_back()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "slots", "toxic"])
        toxic = rows["toxic"].to_numpy(np.int8)
        lengths = np.array([len(s) // (2 + 2 * len(STEMS)) for s in rows["slots"]], np.int64)
        langs = [[x if isinstance(x, str) else None for x in rows["lang"]]]
        parts = {"block": rows["block"].iloc[:1].to_numpy(), "ones": [int(toxic.sum())], "zeros": [int((1 - toxic).sum())], "toxic": [toxic.tobytes()]}
        return pd.DataFrame(parts | {"lengths": [lengths.tobytes()], "slots": [b"".join(rows["slots"])], "langs": langs})

    rows = rows.withColumn("o", F.xxhash64("doc_id", "text")).join(marks.hint("merge"), "doc_id")
    rows = rows.select("o", F.pmod("o", F.lit(blocks)).cast("int").alias("block"), F.col("toxic").cast("int").alias("toxic"), "lang", "text")
    rows = rows.mapInPandas(count, "o long, block int, toxic int, lang string, slots binary")
    packed = rows.groupBy("block").applyInPandas(pack, "block int, ones long, zeros long, toxic binary, lengths binary, slots binary, langs array<string>")
    return saved(packed, "toxic-blocks")


def texts_of(block) -> list[np.ndarray]:
    """Slots of the texts of a block."""
    slots = np.frombuffer(block.slots, np.uint16).reshape(-1, 1 + len(STEMS))
    return np.split(slots, np.cumsum(np.frombuffer(block.lengths, np.int64))[:-1])


def trained(blocks: DataFrame, n: int, share: float) -> Network:
    """Rounds of a pass over each block; n rows in all."""
    sc, state, passes = blocks.sparkSession.sparkContext, State.fresh(), int(np.clip(VISITS // n, *PASSES))
    flat, alone = len(state.flat()), blocks.count() == 1
    wide = -(-flat // (DIM + 2))
    columns = blocks.select("block", "toxic", "lengths", "slots")
    for turn in range(1 if alone else passes):
        shared = sc.broadcast(state)  # its size is set by SLOTS

        def copies(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            for batch in batches:
                for block in batch.itertuples():
                    own, out = shared.value.copy(), np.zeros((SLOTS + wide + 1, DIM + 2))
                    labels = np.frombuffer(block.toxic, np.int8).astype(np.float64)
                    used = learn(own, texts_of(block), labels, share, passes if alone else 1, [7, turn, int(block.block)])
                    out[:SLOTS][used] = np.hstack([own.net.table[used], own.seen[0][used, None], np.ones((used.sum(), 1))])
                    out[SLOTS:-1].flat[:flat] = own.flat()
                    out[:, : DIM + 1], out[-1, 0] = np.rint(out[:, : DIM + 1] * UNITS), 1
                    out[SLOTS:-1, DIM + 1] = np.rint(out[SLOTS:-1, DIM + 1] * UNITS)
                    yield out
            give_back()

        total = summed(columns, copies, (SLOTS + wide + 1, DIM + 2))
        times = total[:SLOTS, DIM + 1]
        used = times > 0
        mean = total[:SLOTS, : DIM + 1][used] / times[used, None] / UNITS
        state.net.table[used], state.seen[0][used] = mean[:, :DIM], mean[:, DIM]
        state.take(total[SLOTS:-1].ravel()[:flat] / total[-1, 0] / UNITS)
    return state.net


def languages_of(blocks: DataFrame) -> Languages:
    """Shares of each slot of whole words in the texts of each language."""
    found = blocks.select(F.explode("langs").alias("lang")).where("lang IS NOT NULL").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(r["lang"] for r in found)
    if not names:
        return Languages([], np.zeros((SLOTS, 0), np.float32))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for batch in batches:
            for block in batch.itertuples():
                out, words = np.zeros((SLOTS, len(names))), np.frombuffer(block.slots, np.uint16)[:: 1 + len(STEMS)]
                of = np.repeat([names.index(x) if x is not None else -1 for x in block.langs], np.frombuffer(block.lengths, np.int64))
                for k in range(len(names)):
                    out[:, k] = np.bincount(words[of == k], minlength=SLOTS)
                yield out

    total = summed(blocks.select("lengths", "slots", "langs"), counts, (SLOTS, len(names))) + 0.1
    return Languages(names, np.log(total / total.sum(0)).astype(np.float32))


def cells_of(blocks: DataFrame, net: Network, known: Languages) -> pd.DataFrame:
    """Rows of each label (ones, zeros) by likeliest language (-1: none) and cell of logits; there are no more of these than languages and cells."""
    shared = blocks.sparkSession.sparkContext.broadcast((net, known))  # its size is set by SLOTS and MOST_LANGUAGES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, known = shared.value
        for batch in batches:
            for block in batch.itertuples():
                found = []
                for slots in texts_of(block):
                    logit = np.clip(net.logit(net.best(slots)[0]), -LARGEST, LARGEST)
                    lang = int(known.likelihoods(slots).argmax()) if len(slots) and known.names else -1
                    found.append((lang, int(np.floor(logit * CELLS))))
                toxic = np.frombuffer(block.toxic, np.int8).astype(np.int64)
                rows = pd.DataFrame(found, columns=["lang", "cell"]).assign(ones=toxic, zeros=1 - toxic)
                yield rows.groupby(["lang", "cell"], as_index=False).sum()
        give_back()

    cells = blocks.select("toxic", "lengths", "slots").mapInPandas(read, "lang int, cell int, ones long, zeros long")
    return cells.groupBy("lang", "cell").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toPandas()


def calibrated(cells: pd.DataFrame, languages: int) -> tuple[float, np.ndarray]:
    """The common threshold and that of each language."""

    def cut(rows: pd.DataFrame) -> float:
        rows = rows.groupby("cell", as_index=False)[["ones", "zeros"]].sum().sort_values("cell")
        return threshold((rows["cell"].to_numpy() + 0.5) / CELLS, rows["ones"].to_numpy(), rows["zeros"].to_numpy())

    common, each = cut(cells), []
    for k in range(languages):
        rows = cells[cells["lang"] == k]
        few = min(rows["ones"].sum(), rows["zeros"].sum())
        trust = few / (few + FEW)
        each.append(trust * cut(rows) + (1 - trust) * common if few else common)
    return common, np.array(each)


def train(docs: DataFrame, labels: DataFrame, block_rows: int = 4000) -> Model:
    """Fits on all labelled rows that may be learned from, in blocks of `block_rows`."""
    blocks = blocks_of(docs, labels, block_rows)
    of = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ones", "zeros"))).first()
    n = of["ones"] + of["zeros"]
    share = of["ones"] / n if n else 0.0
    if share in (0.0, 1.0):
        return Model(share, None, None, 0.0, np.zeros(0))
    net, known = trained(blocks, n, share), languages_of(blocks)
    return Model(share, net, known, *calibrated(cells_of(blocks, net, known), len(known.names)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by SLOTS and MOST_LANGUAGES

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        reader = Reader(m.network, m.languages) if m.network else None
        for batch in batches:
            found = scores(m, batch["text"].tolist(), reader)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": found, "predicted": [int(s >= 0.5) for s in found]})
        reader = None
        give_back()

    found = only(docs, "doc_id", "text").mapInPandas(score, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out_rows().alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, block_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    return predict(docs, train(docs, labels, block_rows))
