"""Byte-level BPE with tiktoken and a local rank file.

Long texts are cut before the regex split at boundaries where the pattern always starts a new match, so the ids are
those of the whole text. A long run of white space is one match, less its last blank where more text follows; the library's regex
engine fails on runs of about a million, so such a match is cut out by the same rule and its bytes are merged by the ranks without
the regex. Runs of letters, numbers or marks, however long, need no such help. A null or empty text has no
ids. Ids decode to raw bytes, so any id sequence decodes. Extra columns of the input are ignored; repeated rows give repeated
results; an empty table gives an empty result. Nothing is chosen among equals, so there are no ties but those that the ranks
settle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame

from evidentia.llm.common import give_back, only

#: A text longer than this is encoded piece by piece.
PIECE_CHARS = 1 << 16
#: A new match always starts at one space that stands between a letter and a letter: the letter run ends before it, and
#: the space is the optional first character of the next run.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

#: White space as the pattern has it, in runs that go past the regex split.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")

_encoders: dict[str, tiktoken.Encoding] = {}


def encoding(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file's content; one per Python worker."""
    key = hashlib.sha256(rank_bytes + pattern.encode()).hexdigest()
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_bytes.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def release() -> None:
    """Drops the encoder: a worker that goes on to other stages needs none of its memory."""
    _encoders.clear()
    give_back()


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of the text, cut at the first safe boundary after each `limit` characters."""
    start = 0
    while len(text) - start > limit and (m := SAFE.search(text, start + limit)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, coder: tiktoken.Encoding) -> list[int]:
    ids, start, text = [], 0, text or ""
    for run in BLANKS.finditer(text):
        # the last blank of a run starts the next match, unless the text ends with the run
        end = run.end() - (run.end() < len(text))
        ids += [i for p in pieces(text[start : run.start()]) for i in coder.encode_ordinary(p)]
        ids += coder._encode_single_piece(text[run.start() : end])
        start = end
    return ids + [i for p in pieces(text[start:]) for i in coder.encode_ordinary(p)]


def read_ranks(path: str, most: int = 64 << 20) -> bytes:
    """The rank file, read once on the driver; it is broadcast, so a file over `most` bytes is refused."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return data


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the bytes that the ids stand for) of every whole text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            ids = [encode(t, coder) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids, "decoded": [coder.decode_bytes(x) for x in ids]})

    return only(docs, "doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken beside the encoder, so ids stay in the task.
    carry: further columns of docs, handed on unchanged."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = encode(text, coder)
                out.append((
                    doc_id,
                    len(ids),
                    hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest(),
                    hashlib.sha256(coder.decode_bytes(ids)).hexdigest(),
                ))
            found = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield found.assign(**{c: batch[c].to_numpy() for c in carry})
        release()

    schema = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return only(docs, "doc_id", "text", *carry).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + schema)


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of rows (doc_id, ids); null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "decoded": [coder.decode_bytes([] if x is None else list(map(int, x))) for x in batch["ids"]],
            })

    return only(encoded, "doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")
