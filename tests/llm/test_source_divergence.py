import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelloom.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, ranks=200):
    """Every term of every pair, by Python's integers."""
    groups, held, within = defaultdict(Counter), defaultdict(Counter), {(lang or "", source or "") for *_, lang, source in rows}
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in within}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        sources = sorted((s for x, s in within if x == lang), key=str.encode)
        p = {s: price(groups[lang, s]) for s in sources}
        whole = price(sum((groups[lang, s] for s in sources), Counter()))
        value = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(value(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(value(p[s][t], whole[t]), t) for t in kept if groups[lang, s][t] and p[s][t] > whole[t]]
            for kind, found, most in (("pair", pairs, None), ("term", own, ranks)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, kind, item, v, rank))
    return out


def table(seed=3):
    pick = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["Ünïcode", "ünïcode", "ÉTÉ", "日本", "x"]
    rows = []
    for i in range(150):
        source = "hot" if i % 3 == 0 else f"s{pick.randint(0, 6)}"
        text = " ".join(pick.choice(words).upper() if pick.random() < 0.2 else pick.choice(words) for _ in range(pick.randint(0, 60)))
        rows.append((i, text.replace(" ", pick.choice([" ", "-", "7", "_"])), pick.choice(["en", "en", "de"]), source))
    rows += [(i, "rare pair of words", "fr", "one" if i % 2 else "two") for i in range(2)]  # no kept term
    return rows + [(900, None, None, None), (901, "", "en", None), (902, "lone " * 30000, None, "x"), (902, "lone " * 30000, None, "x"), (None, "lone", None, "y")]


@pytest.mark.parametrize("terms", [4, 2048])
def test_against_brute_force(spark, monkeypatch, terms):
    monkeypatch.setattr(sd, "TERMS", terms)
    rows = table()
    got = sd.divergences(spark.createDataFrame(rows, SCHEMA).repartition(5), ranks=9).collect()
    assert {tuple(r) for r in got} == brute(rows, ranks=9) and len(got) == len({tuple(r) for r in got})


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST", 0)
    rows = table(5)
    assert {tuple(r) for r in sd.divergences(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_gallop_finds_the_first_place_not_less():
    pick = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 9), (7, 3), (200, 60), (3000, 11)):
        long, wanted = np.unique(pick.integers(0, 4 * n + 1, n)), np.unique(pick.integers(-3, 4 * n + 9, m))
        assert (sd.gallop(long, wanted) == np.searchsorted(long, wanted)).all()
        skewed = np.unique(long**3)
        assert (sd.gallop(skewed, wanted) == np.searchsorted(skewed, wanted)).all()


def test_prices_don_t_overflow():
    counts = np.array([0, 5, 3 * 10**12, 8 * 10**14], np.int64)
    total = int(counts.sum()) + 4
    assert sd.prices(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, 2), (2, "a b", "en", "t", 1, 2), (3, "a", "en", "t", 1, 2)], SCHEMA + ", term int, n int")
    assert sd.divergences(docs).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in sd.divergences(docs).collect()} == brute([(1, "a b", "en", "s"), (2, "a b", "en", "t"), (3, "a", "en", "t")])
    assert sd.divergences(docs.limit(0)).count() == 0
