import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.llm import lm_scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    found = []
    for i in range(700):
        words = pick.choice([a, b])
        found.append((i, " ".join(pick.choice(words) if pick.random() < 0.95 else f"rare{pick.randrange(3000)}" for _ in range(pick.randint(0, 90)))))
    return found + [(900, None), (901, ""), (None, "a1 A1 a2"), (903, "a1 " * 60000), (904, "twice never"), (904, "twice never")]


@pytest.mark.parametrize("frequent", [300_000, 40])
def test_counts_base_and_gain(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "VOCABULARY", frequent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm_scoring.scored(docs, *lm_scoring.fit(docs.filter(~out))).collect()
    counts = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def random_model(counts, total, distinct):
    v = lm_scoring.Vocabulary({b"w%d" % i: i for i in range(len(counts))}, np.array(counts), total, distinct)
    m = lm_scoring.Model.start(v)
    m.rows += np.random.default_rng(0).normal(size=m.rows.shape).astype(np.float32)
    return v, m


def test_probabilities_sum_to_one():
    v, m = random_model(sorted(range(1, 60), reverse=True), 1900, 80)
    assert len(m.edges) > 5
    for last, before in ((0, 3), (59, 60), (60, 60), (7, 58)):
        p = np.exp(m.log_probabilities(np.arange(60), np.full(60, last), np.full(60, before)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)
    # the tokens of the shared vector, and unknown ones
    assert math.isclose((v.total - v.counts.sum() + v.distinct - 59 + 1) / v.rest, 1)


def test_score_token_by_token(spark, rows):
    """Scores against a plain computation, one token and one softmax at a time."""
    docs = spark.createDataFrame([r for r in rows if r[0] != 903], "doc_id long, text string").repartition(3)
    v, m, counts = lm_scoring.fit(docs)
    table = {bytes(r.token): r.n for r in counts.collect()}
    got = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.scored(docs, v, m, counts).collect()}
    w, many = lm_scoring.WIDTH, len(v.number)
    scores = lambda h, part: np.array([float(h @ r[:w].astype(float) + r[w]) for r in part])
    for doc_id, text in [r for r in rows if r[0] != 903][::40] + rows[-6:-3]:
        before, last, want = many + 1, many + 1, 0.0
        for token in tokens(text):
            h = m.context[last, :w].astype(float) * m.scales[0, :w] + m.context[before, :w].astype(float) * m.scales[1, :w]
            k = v.number.get(token, many)
            c = int(np.searchsorted(m.edges, k, side="right")) - 1
            of, own = scores(h, m.classes), scores(h, m.output[m.edges[c] : m.edges[c + 1]])
            want += of[c] - math.log(np.exp(of).sum()) + own[k - m.edges[c]] - math.log(np.exp(own).sum())
            if k == many:
                want += math.log((table.get(token, 0) + 1) / v.rest)
            before, last = last, k
        assert math.isclose(got[doc_id, len(tokens(text))], want / math.log(10), rel_tol=1e-4, abs_tol=1e-3), doc_id


def test_texts_that_share_an_id_and_a_crc(spark):
    """Two texts of one doc_id whose CRC and length agree, and twenty texts without an id."""
    rows = [(5, "gaffdcdh ahf"), (5, "chgffhdabffc"), *((None, "w " * n) for n in range(20))]
    assert len({zlib.crc32(t.encode()) for d, t in rows if d}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.scored(docs, *lm_scoring.fit(docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), len(tokens(t))) for d, t in rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text some", 4, None), (2, None, 5, "x")], "doc_id long, text string, n long, token string")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in lm_scoring.scored(docs, *lm_scoring.fit(docs)).collect()}
    assert got == {1: (4, 4), 2: (1, 1)}


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert lm_scoring.scored(docs.limit(0), *lm_scoring.fit(docs)).count() == 0
    r = lm_scoring.scored(docs, *lm_scoring.fit(docs.limit(0))).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def test_a_step_takes_a_fixed_number_of_products(monkeypatch):
    """All classes' tokens are multiplied in tiles, whatever their number, with the results of a product for each class."""
    pick = np.random.default_rng(2)
    counts = np.sort(pick.zipf(1.3, 4000) % 5000 + 1)[::-1]
    v = lm_scoring.Vocabulary({str(i).encode(): i for i in range(4000)}, counts, int(counts.sum()) + 500, 4400)
    start = lm_scoring.Model.start(v)
    start.rows[:] += pick.normal(0, 0.1, start.rows.shape)
    n = 700
    many = np.diff(lm_scoring._runs(np.sort(start.of_class[pick.integers(0, 4001, n)]))[0], append=n)
    place, of, first = lm_scoring._tiles(many)
    assert place.shape == (len(of), lm_scoring.TILE) and (place[place < n] == np.arange(n)).all() and (of[first] == np.arange(len(many))).all()
    assert all((place[of == r][place[of == r] < n] == np.arange(many[:r].sum(), many[: r + 1].sum())).all() for r in range(len(many)))

    calls, kept = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: calls.append(1) or kept(*a, **k))
    x, y, t = (pick.integers(0, 4001, n) for _ in range(3))
    trainer = lm_scoring.Trainer(start, v, 5)
    trainer._step(x, y, t)
    assert len(calls) == 3

    # the output rows of one step, by a loop over the tokens
    again, m, edges = np.random.default_rng(5), start, start.edges
    t, x, y = (z[np.argsort(t)] for z in (t, x, y))
    again.random(lm_scoring.DRAWN)
    h = m.predicted(x, y).astype(float)
    keep = [i for i in range(n) if edges[m.of_class[t[i]] + 1] - edges[m.of_class[t[i]]] > 1]
    met = sorted({int(m.of_class[t[i]]) for i in keep})
    noise = dict(zip(met, (again.random((len(met), lm_scoring.WORD_NOISE)) * np.array([edges[c + 1] - edges[c] for c in met])[:, None]).astype(int), strict=True))
    grad, sigma = np.zeros(m.output.shape), lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for i in keep:
        c = int(m.of_class[t[i]])
        off = np.log(lm_scoring.WORD_NOISE / (edges[c + 1] - edges[c]))
        grad[t[i]] += (1 - sigma(m.output[t[i]] @ h[i] - off)) * h[i]
        for w in edges[c] + noise[c]:
            grad[w] -= sigma(m.output[w] @ h[i] - off) * h[i]
    moved = grad * (lm_scoring.RATE / np.sqrt(1 + (grad**2).sum(1) / (lm_scoring.WIDTH + 1)))[:, None]
    assert np.allclose(trainer.model.output - m.output, moved, atol=2e-5)


def test_gradients_of_a_row_are_summed_at_once():
    """In any order, and without losing small ones behind large ones."""
    rows, values = np.array([7, 3, *[7] * 1000, 3]), np.ones((1003, 17), np.float32)
    values[0] = 2.0**24
    at, sums, times = lm_scoring._summed(rows, values, np.full(1003, 2.0))
    assert at.tolist() == [3, 7] and times.tolist() == [4, 2002]
    assert sums.dtype == np.float32 and (sums == [[2] * 17, [2.0**24 + 1000] * 17]).all()
    assert len(lm_scoring._summed(rows[:0], values[:0], rows[:0])[0]) == 0


ODD = [None, "", " ", "\n\n", " A\tb\x0bB\x0c\r\n", "\x1ca\x1fb\x85 Ä ä É é", "\x00 \x00\x00", "word", "  İI ", *(f"w{i} w{i} rare{i % 3}" for i in range(50))]


def test_words_of_a_block_as_in_plain_python():
    """White space at the ends and of other alphabets, control characters, empty texts; also in a slice."""
    for texts in (pa.array(ODD, pa.string()), pa.array(["before", *ODD, "after"], pa.string()).slice(1, len(ODD)), pa.array(ODD, pa.large_string()), pa.array([], pa.string())):
        words, lengths = lm_scoring._words(texts)
        want = [tokens(t) for t in texts.to_pylist()]
        assert lengths.tolist() == [len(w) for w in want] and words.to_pylist() == [t for w in want for t in w[:-1]]


@pytest.mark.parametrize("known", [[b"w1", b"\n", b"b", b"a"], [b"w2", b"b"], []])
def test_numbers_and_rare_tokens_of_a_block(known):
    """With the end of a text known and among the rare tokens."""
    v = lm_scoring.Vocabulary({t: i for i, t in enumerate(known)}, np.ones(len(known), np.int64), 100, 50)
    words, ids, last, before, lengths, starts = lm_scoring._numbered(v, pa.array(ODD))
    many, want = len(known), [tokens(t) for t in ODD]
    number = [[v.number.get(t, many) for t in w] for w in want]
    assert ids.tolist() == sum(number, []) and starts.tolist() == [0, *np.cumsum([len(w) for w in want])[:-1]]
    assert last.tolist() == sum(([many + 1, *n][:-1] for n in number), []) and before.tolist() == sum(([many + 1, many + 1, *n][: len(n)] for n in number), [])
    of, found, times = lm_scoring._rare(words, np.flatnonzero(ids == many), lengths, starts)
    got = dict(zip(zip(of.tolist(), found.to_pylist(), strict=True), times.tolist(), strict=True))
    assert len(got) == len(of) and got == Counter((i, t) for i, w in enumerate(want) for t in w if t not in v.number)


def test_words_are_looked_up_without_python_objects(monkeypatch):
    """The look-up of a block's words asks Python's dictionary for nothing but the end."""
    asked = []

    class Asked(dict):
        def get(self, *a):
            asked.append(a[0])
            return super().get(*a)

    v = lm_scoring.Vocabulary(Asked({b"w1": 0, b"\n": 1}), np.ones(2, np.int64), 100, 50)
    assert len(lm_scoring._numbered(v, pa.array(["w1 w2 " * 1000]))[1]) == 2001 and asked == [b"\n"]


def test_counts_that_are_sent_on_early(spark, monkeypatch):
    """Counts are the same when a task can hold few of them."""
    monkeypatch.setattr(lm_scoring, "HELD", 5)
    monkeypatch.setattr(lm_scoring, "BLOCK", 10)
    docs = spark.createDataFrame(list(enumerate(ODD * 3)), "doc_id long, text string").repartition(2)
    got = {bytes(r.token): r.n for r in lm_scoring.token_counts(docs).collect()}
    assert got == Counter(t for x in ODD * 3 for t in tokens(x))
