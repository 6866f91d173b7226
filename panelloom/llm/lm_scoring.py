"""Log-bilinear language model: trained in numpy by noise-contrastive estimation, scored by batched matrix products.

Tokens are words, ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end for each text. The
``VOCABULARY`` most frequent tokens have vectors of their own, all rarer ones share one. The vector of the
next token is predicted as the sum of the two previous tokens' vectors, each scaled by its position's
weights. The softmax has two levels: tokens in order of frequency are cut into classes, about as many as
the sum of the roots of the tokens' shares, which makes the products per token fewest; products with all classes' vectors and then with
those of the class's tokens, each normalised, give the token's probability. A token of the shared vector is
then drawn by its count plus one among those, one more standing for all unknown tokens. So
probabilities of tokens sum to one.

Training is by noise-contrastive estimation on both levels, with noise drawn from the classes' shares and evenly from the
tokens of the class, for all tokens of a step that need it. Counts are taken over all training texts. Training is data-parallel over
all of them: in each round every task runs stochastic steps on its share from the common parameters and
sends what it changed in the rows it met; each row becomes the mean over those tasks, weighted by how
often they met it. So scores depend a little on how the table is dealt. Counts of the frequent tokens go to
every task; the rarer ones are joined by a shuffle. Nothing else than those and the parameters passes the driver,
both of a size that ``VOCABULARY`` bounds.

A null or empty text has only its end. Rows that repeat a doc_id and text are scored alike; rows with one doc_id, or none, and
different texts are told apart by a digest of the text; a null
doc_id is never held out. Without training texts all tokens are unknown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import durable, slices

#: Tokens with vectors and with counts in every task, width of vectors, bytes of text at once.
VOCABULARY, WIDTH, BLOCK = 150_000, 16, 2_000_000
#: Tokens of a step, noise for each token on either level (drawn once for a class and step), classes drawn for all tokens of a step, step size, and rounds.
BATCH, NOISE, WORD_NOISE, DRAWN, RATE, ROUNDS = 4096, 16, 12, 64, 0.2, 2
#: Tokens that a task learns from in a round, about: smaller partitions are taken together, for a mean over many short runs learns little.
TASK_TOKENS = 1_000_000
#: Parameter rows that travel together, and elements of one matrix product's result, which stays in a core's cache.
ROWS, ELEMENTS = 4096, 1 << 17
#: Tokens of one class that are multiplied together in training, and distinct tokens that a task counts before it sends them on.
TILE, HELD = 16, 400_000
END = b"\n"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and how many tokens each text has, its end included."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    words, lengths = split.flatten().cast(pa.binary()), pa.compute.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False)
    full = pa.compute.greater(pa.compute.binary_length(words), 0)  # white space at the ends of a text leaves empty words
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(lengths)
    return words.filter(full), before[ends] - before[ends - lengths] + 1


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK):
    for batch in batches:
        text = batch.column(1)
        sizes = pa.compute.binary_length(text).fill_null(0).to_pylist()
        for a, b in slices(sizes, limit):
            yield batch.column(0).slice(a, b - a), text.slice(a, b - a)


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary) and n over all texts; counted in tasks first."""

    def run(batches):
        held = []
        for _, texts in _blocks(batches, 4 * BLOCK):
            words, _ = _words(texts)
            held += [_counts(words.value_counts()), _counts([(END, len(texts))])]
            if sum(map(len, held)) > 2 * HELD:
                held = [_summed_counts(held)]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed_counts(held).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _counts(pairs) -> pa.Table:
    """From Arrow's counts, or from pairs."""
    if isinstance(pairs, pa.StructArray):
        return pa.table({"token": pairs.field(0), "n": pairs.field(1)})
    return pa.table({"token": pa.array([t for t, _ in pairs], pa.binary()), "n": pa.array([n for _, n in pairs], pa.int64())})


def _summed_counts(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])


@dataclass
class Vocabulary:
    """Number of each frequent token by falling count; the number after the last is all others."""

    number: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int

    @property
    def shares(self) -> np.ndarray:
        """Of all tokens with a vector, then of the others together."""
        own = self.counts.astype(float)
        own = np.append(own, self.total - own.sum()) + 1
        return own / own.sum()

    @property
    def edges(self) -> np.ndarray:
        """Where the classes begin, and the end; the last class is all other tokens.

        With classes of s tokens of share p a token costs p * s products, and 1 / s classes: least where s goes as the root of 1 / p.
        """
        many = len(self.counts)
        roots = np.cumsum(np.sqrt(self.shares[:-1]))
        n = max(1, round(float(roots[-1]))) if many else 0
        cuts = np.unique(np.searchsorted(roots, np.arange(n) * (roots[-1] / n))) if many else np.zeros(0, np.int64)
        return np.concatenate([cuts, [many, many + 1]]).astype(np.int64)

    @property
    def rest(self) -> float:
        """What the tokens without a vector are divided by."""
        return float(self.total - self.counts.sum() + self.distinct - len(self.counts) + 1)

    @cached_property
    def words(self) -> pa.Array:
        """The frequent tokens in order of their numbers."""
        return pa.array(list(self.number), pa.binary())


class Model:
    """Parameters in one matrix: vectors of contexts (the last for the place before a text), of tokens with their biases, of classes
    with theirs, and the scales of the last token and of the last but one."""

    def __init__(self, rows: np.ndarray, edges: np.ndarray):
        self.rows, self.edges = rows, edges
        self.tokens = int(edges[-1])
        self.of_class = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        a, b = self.tokens + 1, 2 * self.tokens + 1
        self.context, self.output, self.classes, self.scales = rows[:a], rows[a:b], rows[b:-2], rows[-2:]

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> "Model":
        """The unigram model: outputs are 0 and biases the log shares."""
        share, edges = vocabulary.shares, vocabulary.edges
        tokens, classes = len(share), len(edges) - 1
        rows = np.zeros((2 * tokens + 1 + classes + 2, WIDTH + 1), np.float32)
        model = cls(rows, edges)
        model.context[:, :WIDTH] = np.random.default_rng(3).normal(0, 0.3, (tokens + 1, WIDTH))
        of = np.add.reduceat(share, edges[:-1])
        model.output[:, WIDTH] = np.log(share / of[model.of_class])
        model.classes[:, WIDTH] = np.log(of)
        model.scales[:] = 1
        return model

    def predicted(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The vector of the next token, and 1 for its bias."""
        h = np.ones((len(last), WIDTH + 1), np.float32)
        np.multiply(self.context.take(last, axis=0)[:, :WIDTH], self.scales[0, :WIDTH], out=h[:, :WIDTH])
        h[:, :WIDTH] += self.context.take(before, axis=0)[:, :WIDTH] * self.scales[1, :WIDTH]
        return h

    def log_probabilities(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability after the two tokens before it."""
        pairs, back = np.unique(last.astype(np.int64) * (self.tokens + 1) + before, return_inverse=True)
        h = self.predicted(pairs // (self.tokens + 1), pairs % (self.tokens + 1))
        order = np.argsort(target)  # classes are runs of tokens
        target, back = target[order], back[order]
        of = self.of_class[target]
        found = _scores(h.take(back, axis=0), self.classes.take(of, axis=0)) - _log_sums(h, self.classes)[back]
        ends = np.searchsorted(of, np.arange(len(self.edges)))
        for c in np.flatnonzero((np.diff(self.edges) > 1) & (np.diff(ends) > 0)).tolist():
            here = slice(ends[c], ends[c + 1])
            x = h.take(back[here], axis=0)
            found[here] += _scores(x, self.output.take(target[here], axis=0)) - _log_sums(x, self.output[self.edges[c] : self.edges[c + 1]])
        out = np.empty_like(found)
        out[order] = found
        return out


def _scores(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", h, rows)


def _log_sums(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log of the sum over ``rows`` of the exponentials of their scores, for each of ``h``."""
    # Most often no score can be so large that its exponential overflows, by the lengths of the vectors; then two passes are saved.
    longest = np.sqrt(_scores(h, h).max() * _scores(rows, rows).max())
    step, ones, sums = max(1, ELEMENTS // len(rows)), np.ones(len(rows), np.float32), np.empty(len(h), np.float32)
    held = np.empty((min(step, len(h)), len(rows)), np.float32)
    for a in range(0, len(h), step):
        x = h[a : a + step]
        z = np.matmul(x, rows.T, out=held[: len(x)])
        most = None if longest < 60 else z.max(axis=1)
        if most is not None:
            z -= most[:, None]
        sums[a : a + step] = np.log(np.exp(z, out=z) @ ones) + (0 if most is None else most)
    return sums


def _data(z: np.ndarray) -> np.ndarray:
    """The probability that a token is data and not noise, from the difference of its log odds, in whose place it is put."""
    odds = np.clip(z, -30, 30, out=z)
    np.exp(np.negative(odds, out=odds), out=odds)
    odds += 1
    return np.reciprocal(odds, out=odds)


class Trainer:
    """Stochastic steps with noise-contrastive estimation, with step sizes that fall as gradients add up."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int):
        self.model = Model(model.rows.copy(), model.edges)
        self.seen = np.ones(len(model.rows), np.float32)
        self.met = np.zeros(len(model.rows), np.float32)
        share = vocabulary.shares
        of = np.add.reduceat(share, model.edges[:-1])
        self.class_ends = np.cumsum(of)
        self.class_noise = np.log(NOISE * of).astype(np.float32)
        self.word_noise = np.log(WORD_NOISE / np.diff(model.edges)).astype(np.float32)
        self.pick = np.random.default_rng(seed)

    def add(self, last, before, target) -> None:
        """One pass over a block in random order."""
        order = self.pick.permutation(len(target))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            self._step(last[rows], before[rows], target[rows])

    def _step(self, x, y, t) -> None:
        m, edges = self.model, self.model.edges
        order = np.argsort(t)  # equal tokens come together, and so do those of a class
        x, y, t = x[order], y[order], t[order]
        c = m.of_class[t]
        s0, s1 = m.scales[:, :WIDTH].copy()
        rx, ry = m.context.take(x, axis=0)[:, :WIDTH], m.context.take(y, axis=0)[:, :WIDTH]
        h = np.ones((len(t), WIDTH + 1), np.float32)
        h[:, :WIDTH] = rx * s0 + ry * s1
        # classes: the true one of each token against classes drawn once for all tokens of the step
        drawn = np.searchsorted(self.class_ends, self.pick.random(DRAWN) * self.class_ends[-1]).clip(max=len(self.class_ends) - 1)
        heads, many = _runs(c)
        own, others = m.classes.take(c, axis=0), m.classes.take(drawn, axis=0)
        up = 1 - _data(_scores(h, own) - self.class_noise[c])
        z = h @ others.T
        z -= self.class_noise[drawn]
        down = _data(z)
        down *= np.float32(-NOISE / DRAWN)
        back = up[:, None] * own + down @ others
        classes = np.append(c[heads], drawn), np.concatenate([np.add.reduceat(up[:, None] * h, heads), down.T @ h]), np.append(many, np.ones(DRAWN))
        # tokens: the true one against tokens drawn from its class, for each class of more than one
        here = np.flatnonzero(edges[c + 1] - edges[c] > 1)
        tokens = t[:0], h[:0], many[:0]
        if len(here):
            k, tt, ch = h.take(here, axis=0), t[here], c[here]
            heads, many = _runs(ch)
            low, sizes = edges[ch[heads]], np.diff(edges)[ch[heads]]
            noise = low[:, None] + (self.pick.random((len(heads), WORD_NOISE)) * sizes[:, None]).astype(np.int64)
            own, others = m.output.take(tt, axis=0), m.output.take(noise, axis=0)
            # A class's tokens in tiles of the same height, so that all tiles are multiplied in one call; in places beyond a class's last token nothing is to learn.
            place, tile_of, tiles = _tiles(many)
            tokens_at = np.append(k, np.zeros((1, WIDTH + 1), np.float32), axis=0).take(place, axis=0)
            drawn_at = others.take(tile_of, axis=0)
            z = np.matmul(tokens_at, drawn_at.transpose(0, 2, 1))
            z -= np.append(self.word_noise[ch], np.float32(0)).take(place)[:, :, None]
            up = 1 - _data(_scores(k, own) - self.word_noise[ch])
            down = _data(z)
            np.negative(down, out=down)
            down[place == len(k)] = 0
            pulled = np.matmul(down, drawn_at).reshape(-1, WIDTH + 1).take(np.flatnonzero(place.ravel() < len(k)), axis=0)
            pushed = np.add.reduceat(np.matmul(down.transpose(0, 2, 1), tokens_at), tiles, axis=0)
            back[here] += up[:, None] * own + pulled
            grads = np.concatenate([up[:, None] * k, pushed.reshape(-1, WIDTH + 1)])
            tokens = np.append(tt, noise), grads, np.append(np.ones(len(tt), many.dtype), np.repeat(many, WORD_NOISE))
        back[:, WIDTH] = 0  # contexts have no bias
        s0, s1 = np.append(s0, np.float32(0)), np.append(s1, np.float32(0))
        contexts = np.concatenate([x, y]), np.concatenate([back * s0, back * s1]), np.ones(2 * len(x))
        scales = np.arange(2), np.zeros((2, WIDTH + 1), np.float32), np.full(2, len(x))
        scales[1][:, :WIDTH] = np.einsum("nd,nd->d", back[:, :WIDTH], rx), np.einsum("nd,nd->d", back[:, :WIDTH], ry)
        base = 0
        for part, sent in zip((m.context, m.output, m.classes, m.scales), (contexts, tokens, classes, scales), strict=True):
            ids, total, n = _summed(*sent)
            self._move(ids + base, total, n)
            base += len(part)

    def _move(self, rows, grad, n) -> None:
        # one step size for a row: its gradients' mean squares add up
        seen = self.seen[rows] + np.einsum("nd,nd->n", grad, grad) / (WIDTH + 1)
        self.seen[rows] = seen
        grad *= (RATE / np.sqrt(seen))[:, None]
        grad += self.model.rows.take(rows, axis=0)
        self.model.rows[rows] = grad
        self.met[rows] += n

    def changes(self, before: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """block, places in it, how often they were met, and by how much they changed, for the rows that were met."""
        for block in range(0, len(before), ROWS):
            at = np.flatnonzero(self.met[block : block + ROWS])
            if len(at):
                moved = (self.model.rows[block + at] - before[block + at]).astype("<f2")
                yield block // ROWS, at.astype("<u2").tobytes(), self.met[block + at].tobytes(), moved.tobytes()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return heads, np.diff(np.append(heads, len(values)))


def _tiles(many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of these lengths, end to end: TILE places in each tile, the number of all rows where a run has no more; the run of each tile; where runs' tiles begin."""
    number = -(-many // TILE)
    first = np.cumsum(number) - number
    of = np.repeat(np.arange(len(many)), number)
    inside = (np.arange(len(of)) - first[of])[:, None] * TILE + np.arange(TILE)
    starts = np.cumsum(many) - many
    return np.where(inside < many[of][:, None], starts[of][:, None] + inside, many.sum()), of, first


def _summed(rows: np.ndarray, values: np.ndarray, times: np.ndarray):
    """Distinct rows, and the sums of their values and of their times, added in double precision."""
    if not len(rows):
        return rows, values, times
    distinct = np.sort(rows.astype(np.int32))  # numbers sort in a tenth of the time that their order takes
    distinct = distinct[_runs(distinct)[0]]
    table = np.empty(distinct[-1] + 1, np.int64)
    table[distinct] = np.arange(len(distinct))
    place = table.take(rows)
    # bincount takes half the time of reduceat, which is slow on short runs of short rows
    cells = np.arange(len(distinct) * values.shape[1]).reshape(len(distinct), -1)
    sums = np.bincount(cells.take(place, axis=0).ravel(), values.ravel()).reshape(cells.shape)
    return distinct, sums.astype(values.dtype), np.bincount(place, times)


def _numbered(vocabulary: Vocabulary, texts: pa.Array):
    """Words of all texts end to end, and over all their tokens: their numbers, and the numbers of the two tokens before; lengths of texts, and where they begin."""
    many = len(vocabulary.number)
    words, lengths = _words(texts)
    starts = np.cumsum(lengths) - lengths
    is_word = np.ones(lengths.sum(), bool)
    is_word[starts + lengths - 1] = False
    ids = np.full(len(is_word), vocabulary.number.get(END, many), np.int32)
    ids[is_word] = pa.compute.index_in(words, value_set=vocabulary.words).fill_null(many).to_numpy()
    last = np.append(np.int32(many + 1), ids[:-1])
    last[starts] = many + 1
    before = np.append(np.int32(many + 1), last[:-1])
    before[starts] = many + 1
    return words, ids, last, before, lengths, starts


def _rare(words: pa.Array, rare: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text, token and number of times of each text's distinct tokens among those in the places ``rare``."""
    of = np.searchsorted(starts, rare, side="right") - 1
    # Each text before has one token that is no word.
    place = np.where(rare == starts[of] + lengths[of] - 1, len(words), rare - of)
    found = pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(place)).dictionary_encode()
    distinct = max(1, len(found.dictionary))
    pairs, times = np.unique(of * distinct + found.indices.to_numpy(), return_counts=True)
    return pairs // distinct, found.dictionary.take(pa.array(pairs % distinct)), times


def _mean_changes(sent: DataFrame, n_rows: int) -> np.ndarray:
    """Over tasks, weighted by how often each met the row. Sums by block of rows, which a partition takes one after another."""
    schema = "block int, moved binary"

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, met, moved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(block, np.zeros((ROWS, WIDTH + 2)))
                n = np.frombuffer(met, np.float32)[:, None]
                held[np.frombuffer(at, "<u2")] += np.concatenate([n, n * np.frombuffer(moved, "<f2").reshape(len(n), -1)], axis=1)
        data = [(x[:, 1:] / np.maximum(x[:, :1], 1)).astype("<f4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["block", "moved"])

    blocks = -(-n_rows // ROWS)
    parts = min(blocks, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = np.zeros((blocks * ROWS, WIDTH + 1), np.float32)
    for r in sent.repartition(parts, "block").mapInArrow(run, schema).toLocalIterator():  # a fixed number of rows
        found[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.moved, "<f4").reshape(ROWS, -1)
    return found[:n_rows]


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Model, DataFrame]:
    """Counts over all of ``docs``, the model, and the table of counts."""
    counts = durable(token_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(VOCABULARY).toArrow()  # a bounded number of rows
    number = {token: i for i, token in enumerate(top.column("token").to_pylist())}
    vocabulary = Vocabulary(number, top.column("n").to_numpy(), int(total), int(distinct))
    model = Model.start(vocabulary)
    if not number:
        return vocabulary, model, counts
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vocabulary)
    for turn in range(rounds):  # each round takes the texts of one hash class, so that every text is used once
        held = context.broadcast(model.rows)

        def run(batches, turn=turn, held=held):
            trainer = None
            for _, texts in _blocks(batches):
                v = words.value
                trainer = trainer or Trainer(Model(held.value, v.edges), v, seed=turn)
                _, ids, last, before, _, _ = _numbered(v, texts)
                trainer.add(last, before, ids)
            if trainer:
                columns = zip(*trainer.changes(held.value), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["block", "at", "met", "moved"])

        share = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("doc_id", "text")
        share = share.coalesce(max(1, -(-int(total) // (rounds * TASK_TOKENS))))
        moved = _mean_changes(share.mapInArrow(run, "block int, at binary, met binary, moved binary"), len(model.rows))
        model = Model(model.rows + moved, model.edges)
        held.unpersist()
    words.unpersist()
    return vocabulary, model, counts


def scored(docs: DataFrame, vocabulary: Vocabulary, model: Model, counts: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """The columns of SCHEMA for each document."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model.rows))

    def run(batches):
        v, rows = sent.value
        m, many = Model(rows, v.edges), len(v.number)
        gain = np.append(np.log10(v.counts + 1.0), 0.0)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def batch_of(*columns):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "token", "times", "n_tokens", "known", "base", "model"])

        for doc_ids, texts in _blocks(batches):
            words, ids, last, before, lengths, starts = _numbered(v, texts)
            log_p = m.log_probabilities(ids, last, before).astype(float) / np.log(10)
            rare = ids == many
            log_p[rare] -= np.log10(v.rest)
            add = lambda x: np.add.reduceat(x, starts).tolist()
            model_sum, base, known = add(log_p), add(gain[ids]), add((~rare).astype(np.int64))
            digests = [hashlib.md5(text or b"", usedforsecurity=False).digest() for text in texts.cast(pa.binary()).to_pylist()]
            marks = pa.array(digests, pa.binary())
            # the head row's token can't be a word; it holds doc_id and digest only so that heads spread over partitions, those without a doc_id too
            ones, heads = np.ones(len(texts), np.int64), [END + str(doc_id).encode() + digest for doc_id, digest in zip(doc_ids.to_pylist(), digests, strict=True)]
            yield batch_of(doc_ids, marks, heads, ones, lengths, known, base, model_sum)
            of, rare_tokens, times = _rare(words, np.flatnonzero(rare), lengths, starts)
            of = pa.array(of)
            yield batch_of(doc_ids.take(of), marks.take(of), rare_tokens, times, *[pa.nulls(len(of), k) for k in kinds[4:]])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mark binary, token binary, times long, n_tokens long, known long, base double, model double")
    rare = rows.join(counts, "token", "left")
    head = F.col("n_tokens").isNotNull()
    alone = lambda c: F.when(~head, c)
    summed = rare.groupBy("doc_id", "mark").agg(
        F.count(F.when(head, 1)).alias("copies"),
        *[F.max(c).alias(c) for c in ("n_tokens", "known", "base", "model")],
        F.coalesce(F.sum(alone(F.when(F.col("n") > 0, F.col("times")))), F.lit(0)).alias("rare_known"),
        F.coalesce(F.sum(alone(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1))), F.lit(0.0)).alias("rare_gain"),
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    return summed.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.floor(F.col("rare_known") / F.col("copies"))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_gain") / F.col("copies") - F.col("n_tokens") * float(np.log10(vocabulary.total + vocabulary.distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("rare_gain") / F.col("copies")).alias("score"),
    )
