import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelloom.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [*"abcdefghIİΣσςÀé  \n\t\x1c\x1f\x85\xa0'sé日本語🎉12²Ⅷ!?.,_-<>|éͅǅK", "<|endoftext|>", "<|startoftext|>", "'S", "'ll"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_same_counts_as_the_library(library):
    pick = random.Random(1)
    texts = ["".join(pick.choice(ODD) for _ in range(n)) for n in [0, 1, 3, 10, 40, 300] * 100]
    assert token_counts.Counter.load(PATH).count(texts) == library(texts)


def test_long_pieces(library):
    texts = ["a" * 3000, "ab" * 2000, "!" * 700, "".join(random.Random(2).choice("abcdefghijklmnop") for _ in range(5000))]
    assert token_counts.Counter.load(PATH).count(texts) == library(texts)


def test_odd_rows(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "same same", None), (3, "same same", None), (None, "no id", 5), (5, "long " * 40000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = token_counts.token_counts(docs, PATH, 2048).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
