import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelloom.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = list("abcdefgh  \n\t\x1c\x1f\x85\xa0'sé日本語🎉12²Ⅷ!?.,_-")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec.load(PATH, public_tokenizers.PATTERN)


def test_same_ids_as_the_library(library, codec):
    pick = random.Random(1)
    for size in [0, 1, 2, 3, 10, 40, 300] * 60:
        text = "".join(pick.choice(ODD) for _ in range(size))
        assert codec.encode(text) == library.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 1000, "!" * 700, "".join(random.Random(2).choice("abcdefghijklmnop") for _ in range(5000))])
def test_long_pieces(library, codec, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_heap_and_matrix_agree(codec):
    pick = random.Random(3)
    for _ in range(50):
        piece = "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 400)))
        codec.known.clear()
        assert np.frombuffer(codec._long(piece.encode()), "<u4").tolist() == codec.encode(piece) or piece.encode() in codec.ranks


def test_pieces_remembered_are_bounded_and_frequent_ones_kept(monkeypatch, library):
    """Whatever the corpus holds, two generations stay; a piece of every text is merged once."""
    codec = bpe_codec.Codec(PATH, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 300)
    merged, kept = [], codec.encode_pieces
    codec.encode_pieces = lambda pieces: merged.extend(pieces) or kept(pieces)
    pick = random.Random(4)
    for turn in range(60):
        words = ["".join(pick.choice("bcdfghjkmnpq") for _ in range(9)) for _ in range(50)]
        texts = [" everywhere " + " ".join(words), "z" * 3200 if turn == 30 else None]
        assert codec.encode_packed(texts) == [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
        assert len(codec.known) + len(codec.elder) <= 2 * 300 + 2 * 60 and not codec.known.keys() & codec.elder.keys()
    assert len(merged) > 3000 and merged.count(" everywhere") == 1
    codec.encode_packed(["q" * 32 * 301])
    codec.encode_packed(["q"])
    codec.encode_packed(["z" * 32 * 301])
    codec.encode_packed(["q"])
    assert sum(map(len, codec.known)) + sum(map(len, codec.elder)) < 2 * 32 * 301


def test_odd_rows(spark, codec, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same same", None), (3, "same same", None), (None, "no id", "x"), (5, "long " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_codec.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for (doc_id, text, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, dict((a, b) for a, b, _ in rows)[r.doc_id]))), strict=True):
        ids = library.encode_ordinary(text or "")
        assert r.doc_id == doc_id and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_codec.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
