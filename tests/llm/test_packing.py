import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelloom.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"abc déÉſ'\x85\x1c\n\t  日🎉12²Ⅷ!?_-", "'s", "'LL", "<|endoftext|>", "word "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_as_the_library(library):
    pick = random.Random(2)
    texts = ["", *("".join(pick.choice(ODD) for _ in range(n)) for n in (1, 4, 30, 300) * 25), "a" * 4000, "<|endoftext|>" * 50]
    assert [pk.Encoder.load(PATH).ids(t).tolist() for t in texts] == [library(t) for t in texts]


def test_white_space_beyond_the_pattern_s_stack(library):
    text = "x<|endoftext|>" + " " * 1_500_000 + "\n" * 5 + "y"
    with pytest.raises(ValueError):
        pk.Encoder.load(PATH).library.encode(" " * 1_500_000 + "y")
    assert pk.Encoder.load(PATH).ids(text).tolist() == library(text)


def fewest(lengths, capacity):
    """Sequences of the best packing, by trying all sets for the longest piece."""

    @lru_cache(None)
    def least(rest):
        if not rest:
            return 0
        best, others = len(rest), rest[1:]

        def choose(i, room, left):
            nonlocal best
            best = min(best, 1 + least(left))
            for k in range(i, len(left)):
                if left[k] <= room:
                    choose(k, room - left[k], left[:k] + left[k + 1 :])

        choose(0, capacity - rest[0], others)
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def unrolled(plan):
    return [x for contents, times in plan for x in [contents] * times]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_best_plan_in_reach(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 17, 24])
    lengths = [pick.randint(pick.choice([1, 2, 4]), capacity) for _ in range(pick.randint(1, 9))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    fixed, left = pk.reduced(counts, capacity)
    rest = [n for n in range(capacity + 1) for _ in range(left[n])]
    best = fewest(lengths, capacity)
    assert sum(n for _, n in fixed) + fewest(rest, capacity) == best
    plan = unrolled(pk.planned(counts, capacity))
    assert best <= len(plan) <= best + 1 and pk.least_sequences(counts, capacity) <= best
    assert all(sum(a * b for a, b in contents) <= capacity for contents in plan)
    assert sorted(n for contents in plan for n, copies in contents for _ in range(copies)) == sorted(lengths)


def test_best_fit_of_counts_is_best_fit_of_pieces():
    pick = random.Random(8)
    for _ in range(40):
        capacity = 50
        lengths = sorted((pick.randint(1, capacity) for _ in range(60)), reverse=True)
        rooms = []
        for n in lengths:
            fits = [k for k, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= n
            else:
                rooms.append(capacity - n)
        made = unrolled(pk.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity))
        assert sorted(capacity - sum(a * b for a, b in c) for c in made) == sorted(rooms)


def check(rows, got, library, capacity, end=2):
    """Every piece is the right part of its document, and sequences are gapless and in bounds."""
    want = []
    for doc_id, text in rows:
        ids = [*library(text or ""), end]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in held.values():
        ends = 0
        for offset, length in sorted(found):
            assert offset == ends
            ends += length
        assert ends <= capacity
    counts = np.bincount([r.length for r in got], minlength=capacity + 1)
    assert len(held) == sum(n for _, n in pk.planned(counts, capacity))


def table():
    pick = random.Random(6)
    rows = [(i, "".join(pick.choice(ODD) for _ in range(pick.randint(0, 120)))) for i in range(200)]
    return rows + [(500 + i, "the same short text") for i in range(120)] + [(1, None), (2, ""), (None, "no id"), (None, None), (3, "same"), (3, "same"), (700, "long text " * 20_000)]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_pieces_and_places(spark, library, monkeypatch, broadcast):
    monkeypatch.setattr(pk, "BROADCAST", broadcast)
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(rows, pk.packed(docs, PATH, capacity=64).collect(), library, 64)


def test_sequences_hold_the_ids(spark, library):
    rows = table()[:60]
    got = pk.sequences(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacity=64).collect()
    assert max(len(r.ids) for r in got) <= 64
    assert sorted(i for r in got for i in r.ids) == sorted(i for _, t in rows for i in [*library(t or ""), 2])
    one = next(r for r in got if len(r.starts) == 1)
    assert one.starts == [0]


def test_odd_tables(spark, library):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, None, 7, 8)], "doc_id long, text string, length int, offset int")
    got = pk.packed(docs, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check([(1, "a b"), (2, None)], got.collect(), library, 1024)
    assert pk.packed(docs.limit(0), PATH).count() == 0
