"""Words and runs with structure that weak hashes and the regex engine stumble over."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from evidentia.llm import byte_bpe, decontaminate, keyblocks, set_join, substring_dedup

TEXTS = "doc_id long, text string"


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 64, 1024, 2048])
def test_complements_have_different_hashes(n):
    x, y = thue_morse(n), thue_morse(n, "ba")
    words = keyblocks.Words([f"{x} {y} {x}{y} {y}{x} {x}", f"{y} {x}a {x}"], twice=True)
    names = [x, y, x + y, y + x, x, y, x + "a", x]
    for hashes in (words.hashes, words.others):
        assert len(set(hashes.tolist())) == len(set(names))
        for i in range(len(names)):
            for j in range(len(names)):
                assert (hashes[i] == hashes[j]) == (names[i] == names[j])


def test_hash_is_of_the_word_alone():
    rng = np.random.default_rng(0)
    names = ["".join(rng.choice(list("abé"), k)) for k in (*range(1, 40), 255, 256, 511, 512, 513, 5000)]
    alone = [int(keyblocks.Words([w]).hashes[0]) for w in names]
    assert keyblocks.Words([" \n".join(names)]).hashes.tolist() == alone
    assert keyblocks.Words(names).hashes.tolist() == alone and len(set(alone)) == len(names)


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_complements_apart(spark, n):
    x, y = thue_morse(n), thue_morse(n, "ba")
    head = " ".join(f"w{k}" for k in range(49))
    df = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}")], TEXTS)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 50}
    df = spark.createDataFrame([(1, x), (2, y), (3, x)], TEXTS)
    assert {r["doc_id"]: r["component_id"] for r in set_join.ngram_jaccard_join(df).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, y)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(df, items).collect()} == {2}


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return byte_bpe.encoding(f.read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize("run", [" " * 9000, "\n" * 5000, " \n\t" * 2000, "　\xa0 " * 1700, "\x1c" * 5000, " " * 4095, " " * 4096, "a" * 9000, "7" * 9000, "́" * 5000, "#" * 9000])
def test_long_runs_equal_the_library(coder, run):
    for text in (run, "ab" + run, run + "cd", "ab" + run + "'s cd", "1" + run + "2", "é." + run + "…x" + run + run[:7], run + "\x1c" + run):
        assert byte_bpe.encode(text, coder) == coder.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n"])
@pytest.mark.parametrize("after", ["", "letters", "!marks"])
def test_millions_of_blanks_decode_to_the_text(coder, blank, after):
    text = "start" + blank * 3_000_000 + after
    ids = byte_bpe.encode(text, coder)
    assert coder.decode_bytes(ids) == text.encode()


def test_ranks_are_those_of_the_file(coder):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert own.encode_ordinary("Ein Satz,  é\n") == byte_bpe.encode("Ein Satz,  é\n", coder)
