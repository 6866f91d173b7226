import math
import random
import re
from collections import Counter

from panelloom.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def test_statistics_against_brute_force(spark):
    pick = random.Random(4)
    texts = [None, "", " \n\t", "one", "x " * 300, "a b c d e f g h " * 3, "\x1c  word"]
    texts += [pick.choice(" \n\t").join(pick.choice(["é", "#$", "ab", "c\nc", "\x85", "日本"]) for _ in range(pick.randint(1, 120))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ratio long")
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:7] == brute(t), repr(t)
        assert not (got[i].kept and got[i].base_failed)
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_bands(spark):
    pick = random.Random(5)
    syllables = ["".join(pick.choice("etaoinshrdlucmfw") for _ in range(pick.randint(2, 3))) for _ in range(60)]
    prose = " ".join("".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(900))
    noise = " ".join("".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(200))
    table = " | ".join(f"row {i % 7} cell {i % 11}" for i in range(400))
    docs = spark.createDataFrame([(0, prose), (1, noise), (2, table)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality(docs).collect()}
    assert kept == {0: True, 1: False, 2: False}


def verdict(text):
    """Whole text and chunks one by one against their bands, in plain words."""
    import zstandard

    data, size = text.encode(), quality_rules.CHUNK
    pieces = [data[i : i + size] for i in range(0, len(data), size)] if len(data) > size else []
    if pieces and len(pieces[-1]) < size // 4:
        last = pieces.pop()
        pieces[-1] += last
    assert b"".join(pieces) in (data, b"")

    def inside(piece):
        x = math.log2(len(piece))
        rows = [(math.log2(n), lo, hi) for n, lo, hi in quality_rules.BANDS]
        if x <= rows[0][0]:
            low, high = rows[0][1:]
        elif x >= rows[-1][0]:
            low, high = rows[-1][1:]
        else:
            a, b = next((a, b) for a, b in zip(rows, rows[1:]) if a[0] <= x <= b[0])
            low, high = (a[k] + (b[k] - a[k]) * (x - a[0]) / (b[0] - a[0]) for k in (1, 2))
        return low <= len(piece) / len(zstandard.ZstdCompressor(level=3).compress(piece)) <= high

    return inside(data) and 2 * sum(not inside(p) for p in pieces) <= len(pieces)


def test_kept_against_brute_force(spark):
    """Prose, templates and noise of all lengths; many end in a short piece, which counts."""
    pick = random.Random(8)
    syllables = ["".join(pick.choice("etaoinshrdlucmfw") for _ in range(pick.randint(2, 3))) for _ in range(60)]
    prose = lambda n: " ".join("".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(n))
    table = lambda n: " | ".join(f"row {i % 7} cell {i % 11}" for i in range(n))
    texts = [pick.choice([prose, noise, table])(pick.choice([5, 30, 100, 700, 900, 1500])) for _ in range(120)]
    texts += [prose(640) + " " + noise(n) for n in (1, 10, 20, 120)] + [prose(90000), prose(700), prose(700)]
    docs = spark.createDataFrame([(i % 90, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, ratio double")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality_rules.quality(docs).collect())
    assert got == sorted((i % 90, brute(t)[0], not brute(t)[-1] and verdict(t)) for i, t in enumerate(texts))
    assert 20 < sum(k for *_, k in got) < 110
