import hashlib
import random
from collections import Counter

import pytest

from panelloom.llm import suffix_dedup


def brute(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    times = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    found = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if times[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return found


def cases(seed):
    pick = random.Random(seed)
    letters = "abcdé \n"
    word = lambda n: "".join(pick.choice(letters) for _ in range(n))
    shared = [word(n) for n in (150, 190, 197, 199, 200, 201, 205, 240, 300, 420, 900)]
    texts = []
    for _ in range(120):
        text = word(pick.randint(0, 250))
        for _ in range(pick.randint(0, 3)):
            s = pick.choice(shared)
            cut = pick.randint(0, 30)
            text += s[cut:] + word(pick.randint(0, 60))
        texts.append(text)
    return texts + [None, "", "short", texts[0], texts[0], texts[5] + "!", "a" * 1000, "a" * 450, "ab" * 300, "xyz" * 90, shared[-1], shared[-1][1:-1]]


@pytest.mark.parametrize(("seed", "hot"), [(1, 10_000), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    """With ``hot`` 3 nearly all anchors go the way of those that very many texts hold."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = cases(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(docs).collect()}
    want = brute(texts)
    assert [(i, got[i], w) for i, w in enumerate(want) if got[i] != w] == []


def test_passage_in_very_many_surroundings(spark):
    """100 bytes in 20,000 surroundings repeat nothing of 200 bytes; 190 and foreign bytes neither; 260 bytes in 12,000 go from all."""
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abcdefghijklmnop ") for _ in range(n))
    short, almost, long = word(100), word(190), word(260)
    texts = [word(150) + short + word(150) for _ in range(20_000)] + [word(80) + almost + word(80) for _ in range(11_000)] + [word(90) + long + word(90) for _ in range(12_000)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, m1 string").repartition(8)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(docs).collect()}
    for i, t in enumerate(texts):
        gone = (max(0, got[i][1]), got[i][2])
        if i < 31_000:
            assert gone == (0, 0), i
        else:
            # neighbours may agree in a byte or two with another text's by chance
            assert 260 <= gone[0] <= 272 and gone[1] == 1, (i, gone)


def test_merge_order_and_shared_lengths():
    pick = random.Random(3)
    runs = []
    for _ in range(5):
        strings = sorted("".join(pick.choice("ab") for _ in range(pick.randint(1, 12))).encode() for _ in range(40))
        runs.append([suffix_dedup.Entry(s, b"", 0, [(0, 0, 0)]) for s in strings])
    got = list(suffix_dedup.merged([suffix_dedup.unpacked(suffix_dedup.packed(r)) for r in runs]))
    assert [e.right for _, e in got] == sorted(e.right for r in runs for e in r)
    assert all(n == suffix_dedup._shared(a.right, b.right) for (_, a), (n, b) in zip(got, got[1:], strict=False))


def test_slices_and_repeated_rows(spark, monkeypatch):
    pick = random.Random(4)
    long = "".join(pick.choice("abcdefgh") for _ in range(30000))
    texts = [long, "start" + long[1000:29000] + "end", "x" + long[:5000]]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(None, "q" * 10)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in suffix_dedup.removed(docs).collect())
    assert got == sorted(brute([*texts, "q" * 10]))
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
