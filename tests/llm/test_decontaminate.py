import random
import re
from collections import Counter

from panelloom.llm import decontaminate


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(docs, items, least=0.8):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            n = len(words(item))
            for s in range(max(1, len(w) - n + 1)) if w and n else ():
                a, b = Counter(shingles(w[s : s + n])), Counter(shingles(words(item)))
                value = sum((a & b).values()) / sum((a | b).values())
                if value >= least:
                    found[d, i] = max(value, found.get((d, i), 0))
    return found


def test_against_brute_force(spark):
    pick = random.Random(8)
    vocabulary = [f"w{i}é" for i in range(300)]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([3, 5, 15, 40, 40])))) for i in range(30)] + [(98, ""), (99, None)]
    docs = []
    for d in range(250):
        w = [pick.choice(vocabulary) for _ in range(pick.randint(0, 120))]
        if d % 2:
            passage = items[pick.randrange(30)][1].split()
            if d % 5 == 0:
                passage[pick.randrange(len(passage))] = "changed"
            if d % 7 == 0:
                passage = passage[1:]
            at = pick.randint(0, len(w))
            w[at:at] = passage
        docs.append((d, pick.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w)))
    docs += [(300, None), (301, ""), (302, "!!! ..."), (303, items[3][1] + " filler" * 2000)]
    want = brute(docs, items)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 90


def test_clean_keeps_the_rest(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One two three, four five six seven", "a"), (2, "other words", "b"), (None, None, "c"), (1, "y", "d")], "doc_id long, text string, wanted_id string")
    # the other text of doc_id 1 holds no item
    assert sorted(r.wanted_id for r in decontaminate.clean(docs, items).collect()) == ["b", "c", "d"]
    assert decontaminate.clean(docs.limit(0), items).count() == 0
    clash = docs.withColumnRenamed("wanted_id", "leak_id")
    assert sorted(r.leak_id for r in decontaminate.clean(clash, items).collect()) == ["b", "c", "d"]
    assert decontaminate.clean(docs, items.limit(0)).count() == 4


def test_documents_shorter_than_the_item(spark):
    pick = random.Random(3)
    items = [(i, " ".join(f"w{pick.randrange(900)}" for _ in range(40))) for i in range(12)]
    docs = []
    for i, item in items:
        w = item.split()
        docs += [(100 * i + n, " ".join(w[n:])) for n in range(0, 10)] + [(100 * i + 50 + n, " ".join(w[: 40 - n])) for n in range(1, 10)]
    want = brute(docs, items)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert {(5, 0), (55, 0)} <= set(want) and (9, 0) not in want


def test_null_doc_ids_are_documents_of_their_own(spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"unrelated words {i} of a text without any leak", i) for i in range(18)] + [(None, item, 90), (None, "x " + item, 91), (7, item, 92), (7, "other", 93), (7, item, 94)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    assert sorted(r.k for r in decontaminate.clean(docs, items).collect()) == [*range(18), 93]
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.start_word) for r in found) == [("7", 0), ("None", 0), ("None", 1)]


def test_recall_of_the_radius(spark):
    """Of real windows at similarities from 0.8 up, the share whose fingerprints lie within the radius."""
    pick, pairs = random.Random(12), []
    for _ in range(2500):
        n = pick.choice([13, 22, 40, 104])
        w = [f"w{pick.randrange(5000)}" for _ in range(n)]
        v = list(w)
        while True:
            at = pick.randrange(n)
            v[at] = f"x{pick.randrange(5000)}" if pick.random() < 0.5 else v[at - 1]
            a, b = Counter(shingles(w)), Counter(shingles(v))
            if sum((a & b).values()) < 0.8 * sum((a | b).values()):
                break
            pairs.append((shingles(w), shingles(v)))
            if pick.random() < 0.4:
                break
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    hashed = lambda c: decontaminate.simhash(F.transform(c, lambda x: F.xxhash64(x)))
    near = rows.select((F.bit_count(hashed("a").bitwiseXOR(hashed("b"))) <= decontaminate.RADIUS).alias("near")).collect()
    print("within the radius", sum(r.near for r in near), "of", len(near))
    assert len(near) > 1000 and sum(r.near for r in near) >= 0.998 * len(near)
