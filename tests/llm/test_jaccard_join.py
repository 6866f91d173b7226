import random

from panelloom.llm import jaccard_join
from panelloom.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, n, percent):
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def table():
    pick = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[pick.choice(words) for _ in range(pick.choice([30, 60, 120]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for d in range(420):
        w = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            w[pick.randrange(len(w))] = pick.choice(words)
        if d % 4 == 0:
            w = passage + [pick.choice(words) for _ in range(pick.randint(1, 40))]
        docs.append((d, " ".join(w).upper() if d % 9 == 0 else "\n".join(w)))
    return docs + [(600, None), (601, ""), (602, " \t"), (603, "one"), (604, "ONE"), (605, "a b c"), (606, "a b c d"), (607, "é É"), (608, "word " * 50000)]


def test_against_brute_force(spark):
    docs = table()
    want = brute(docs, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 100


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "A b c d e f")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:2] + (r.component_id,) for r in jaccard_join.linked(docs).collect())))
    assert got == sorted(map(str, [(None, 3, 1), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 3, 1)]))
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()) == ["1", "2"]  # one row of the group of five-word copies, and the null text
    assert jaccard_join.linked(docs.limit(0)).count() == 0


def test_repeated_doc_ids_with_different_texts(spark):
    pick = random.Random(2)
    x, y = (" ".join(f"{k}{pick.randrange(1000)}" for _ in range(60)) for k in "xy")
    docs = spark.createDataFrame([(5, x), (5, y), (6, x + " more"), (7, y + " more"), (None, x + " less"), (8, "other words")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard_join.linked(docs).collect())
    assert got == sorted([("5", 5), ("5", 5), ("6", 5), ("7", 5), ("None", 5), ("8", 8)])
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == [5, 5, 8]  # x and y don't link


def test_many_near_copies_and_a_passage_common_to_all(spark):
    pick = random.Random(21)
    words = [f"v{i}" for i in range(5000)]
    base = [pick.choice(words) for _ in range(100)]
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for d in range(300):
        w = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            w[pick.randrange(100)] = pick.choice(words)
        docs.append((d, " ".join(w)))
    docs += [(d, " ".join([*passage, *(pick.choice(words) for _ in range(pick.choice([10, 30, 90])))])) for d in range(300, 500)]
    for n, percent in ((4, 85), (5, 80)):
        want = brute(docs, n, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), n, percent).collect()}
        assert got == want
        assert len({c for d, (_, c) in want.items() if d < 300}) > 20


def test_one_of_each_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 1, None), (2, "a b c d e f", "y", 2, None), (1, "a b c d e f", "z", 3, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string, mark long, `row` string")
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_sketches_never_exclude_a_link():
    import numpy as np

    pick = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(pick.integers(0, 1 << 63, pick.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([pick.choice(x, pick.integers(0, len(x) + 1), replace=False), pick.integers(0, 1 << 63, pick.integers(1, 300)).astype(np.uint64)]))
        bound = jaccard_join.least_difference([jaccard_join.parities(x)], [jaccard_join.parities(y)])[0]
        assert bound <= len(np.setxor1d(x, y))


def test_templates_make_no_pairs_to_verify(spark, monkeypatch):
    """Documents of ten out of thirty shared segments: each shingle is common, no pair links, and what is verified doesn't grow."""
    segments = [[f"s{i}w{k}" for k in range(50)] for i in range(30)]
    verified = []
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: verified.append(pairs.count()) or whole(pairs, *a))
    for n in (150, 300):
        pick = random.Random(n)
        docs = [(d, " ".join(w for s in pick.sample(segments, 10) for w in s)) for d in range(n)]
        got = jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
        assert {r.component_id for r in got} == set(range(n))
        stars, thin, full = verified[-3:]
        assert thin <= n / 10 and full <= thin and stars <= 3 * n
