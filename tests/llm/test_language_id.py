import math
import random

import numpy as np
import pytest

from panelloom.llm import language_id

WORDS = {"aa": ["the", "of", "thing", "whether", "shore"], "bb": ["der", "und", "keit", "über", "zwisch"], "cc": ["que", "les", "eaux", "été", "oiseau"]}


def text(lang, n, pick):
    return " ".join(pick.choice(WORDS[lang]) + pick.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    pick = random.Random(6)
    rows = [(i, text(lang, pick.randint(3, 80), pick), lang, "und") for i in range(600) for lang in [pick.choice("abc") * 2]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy(table):
    model = language_id.learn(table.filter("doc_id < 400"), per_lang=100)
    got = language_id.identified(table.filter("doc_id >= 400"), model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 200
    assert sum(r.lang_pred == r["lang"] for r in got) >= 196
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 2


def test_odd_rows(spark, table):
    model = language_id.learn(table, per_lang=100)
    rows = [(1, None), (2, ""), (3, "123 !? 456"), (None, "the thing"), (5, "der keit " * 60000), (5, "der keit " * 60000), (6, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identified(docs, model).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (None, "aa", False), (5, "bb", False)} <= got
    assert language_id.kept(docs, model).count() == 4 - sum(r[0] == 6 and r[2] for r in got)
    assert language_id.identified(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language_id.identified(docs, language_id.learn(docs)).first().lang_pred == "und"


def plain(text, model):
    """One stretch of bytes at a time, as the module's text says."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    kept = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    data = (" " + " ".join(kept.split(" ")) + " ").encode()
    data = b" " + b" ".join(data.split()) + b" "
    total, n = [0.0] * len(model.languages), 0
    for size in (3, 4):
        for i in range(len(data) - size + 1):
            x = int.from_bytes(data[i : i + size], "little")
            bucket = ((x ^ 0x5BD1E995) * 2654435761 if size == 3 else x * 2246822519) % 2**32 >> 17
            n += 1
            for k in range(len(total)):
                total[k] += float(model.table[k][bucket])
    z = [(t / max(n, 1) + float(b)) * model.sharpness for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e)), key=e.__getitem__)
    return model.languages[best], e[best] / sum(e)


def test_against_brute_force(spark, table):
    model = language_id.learn(table.filter("doc_id < 300"), per_lang=100)
    rows = [(r.doc_id, r.text) for r in table.filter("doc_id >= 300").collect()] + [(900, "É"), (901, "a"), (902, "Ab, 12 über!\n\tthe"), (903, "1 2"), (904, None), (905, "日本"), (906, "the thing " * 3000)]
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for i, text in rows:
        lang, score = plain(text, model)
        assert got[i][0] == lang and math.isclose(got[i][1], score, rel_tol=1e-5), (i, text[:40] if text else text, got[i], lang, score)
        assert got[i][2] == (lang == "und" or score < model.least)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_the_sample_is_bounded(spark, doc_id):
    rows = [(doc_id, f"thing number {i % 5}", "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, per_lang=20)
    assert model.languages in (["aa"], [])


def test_examples_lie_in_two_buffers():
    """Four bytes for each bucket of a text, and the same shares as from its own arrays."""
    examples, texts = language_id.Examples(), [b" one two three ", b" x ", b" " + b"ab " * 30_000]
    for k, text in enumerate(texts):
        examples.add(text, k)
    assert len(examples) == 3 and examples.buckets.itemsize + examples.times.itemsize == 4
    for k, text in enumerate(texts):
        h = np.concatenate(language_id._hashes(np.frombuffer(text + b" " * max(0, 5 - len(text)), np.uint8)))
        where, n = np.unique(h, return_counts=True)
        buckets, share, label = examples[k]
        assert label == k and (buckets == where).all() and np.array_equal(share, (n / n.sum()).astype(np.float32))
