import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from panelloom.llm import filter_audit as fa

ODD = [*"aZ#\t\n\x0b\x0c\r  é日🎉 \x1c\x85", "word", "WORD", "wordword", "x" * 9]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_one_pass_counts_whatever_the_pieces(monkeypatch, piece):
    monkeypatch.setattr(fa, "PIECE", piece)
    monkeypatch.setattr(fa, "_POWERS", [])
    pick = random.Random(piece)
    texts = ["", " ", "a", "  a  a ", "A#", *("".join(pick.choice(ODD) for _ in range(n)) for n in (1, 3, 30, 200) * 8), "ab " * 500, "y" * 700 + " " + "y" * 700 + " " + "y" * 699]
    assert fa.counts([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_words_that_only_share_the_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    table = fa.WordTable(data)
    start, size = np.array([0, 3, 6, 9, 12]), np.full(5, 2)
    same = np.zeros(5, np.int64)
    assert len(table.insert(start, size, same, same)) == 3 and len(table.insert(start, size, same, same)) == 0
    assert len(table.insert(start, size, same, np.ones(5, np.int64))) == 3  # another document's


def test_many_words_make_the_table_grow():
    words = [f"w{i}" for i in range(60_000)]
    text = " ".join(words + words[:100]).encode()
    assert fa.counts([text])[0, :2].tolist() == [60_100, 60_000]


def brute(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    sets = []
    for doc_id, text, lang, *_ in rows:
        words, distinct, capitals, points, symbols = plain(text or "")
        fails = {k for k, x in zip("ABCDE", (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, doc_id is not None and doc_id > first[text or ""]), strict=True) if x}
        sets.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = [], Counter()
    for part in {s[0] for s in sets}:
        for order in permutations("ABCDE"):
            live = [s for s in sets if s[0] == part]
            every = list(live)
            for step, x in enumerate(order, 1):
                gone = [s for s in live if x in s[1]]
                live = [s for s in live if x not in s[1]]
                shapley[part, x] += len(gone)
                out.append([part, "".join(order), step, len(live), len(gone), sum(x in s[1] for s in every) - len(gone), sum(s[1] == {x} for s in every), sum(s[2] for s in gone), sum(s[3] for s in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def table():
    pick = random.Random(4)
    rows = []
    for i in range(160):
        words = [pick.choice(["alpha", "Beta", "g#", "DELTA", f"u{i}", *(f"v{k}" for k in range(80))]) for _ in range(pick.choice([5, 99, 100, 160]))]
        rows.append((i, " ".join(words), pick.choice(["en", "de", None])))
    rows += [(200 + i, rows[3][1], "en") for i in range(60)] + [(i, rows[0][1], "de") for i in (0, 0)]
    return rows + [(300, None, "en"), (301, "", "en"), (None, rows[3][1], "fr"), (None, None, None), (302, "long word " * 50_000, "fr")]


def test_against_brute_force(spark):
    rows, pick = table(), random.Random(5)
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = fa.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute(rows, labels)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, 2), (2, "a", "en", 3, 4)], "doc_id long, text string, lang string, quality int, mark int")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = fa.audit(docs, labels)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute([(1, "a", "en"), (2, "a", "en")], [(1, 1, 1)])
    assert fa.audit(docs.limit(0), labels).count() == 0
    assert fa.audit(docs, labels.limit(0)).count() == 120 * 5
