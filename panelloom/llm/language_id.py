"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 3- and 4-byte stretches of the lower-cased text, letters only, hashed into
``BUCKETS`` rows of an embedding table. A text is the mean of its rows; a linear layer and a softmax
give the languages. Embeddings and layer are trained by stochastic gradient descent in numpy on a
bounded sample: about ``per_lang`` labelled documents of each of the ``most`` most frequent languages, of at most
``longest`` bytes each, drawn by a hash of doc_id and text, and never more than twice that number. A tenth of the sample sets the temperature of the
scores and the score below which a text is rejected, so that about one good document in a thousand
falls below it. For prediction embeddings and layer fold into one table, so whole texts of any length cost
a gather and a sum.

A text that is null or has no letter gets ``und``, score 0, and is rejected. Null languages are not
learned from; without any labelled text everything is ``und``. Of languages with equal scores the first by
name is taken. Every row is judged alone and whole, however long, so repeated rows get the same result;
``kept`` returns all columns, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import slices

BUCKETS, WIDTH, BLOCK = 1 << 15, 16, 2_000_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII that isn't a letter becomes a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def _bytes(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "


def _hashes(data: np.ndarray):
    """Bucket of the stretch of 3 and of 4 bytes that starts at each place."""
    a = data.astype(np.uint32)
    three = a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))
    four = three[:-1] | (a[3:] << np.uint32(24))
    spread = lambda x, m: (x * np.uint32(m)) >> np.uint32(32 - 15)
    return spread(three ^ np.uint32(0x5BD1E995), 2654435761), spread(four, 2246822519)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket -> share in each language's logit
    bias: np.ndarray
    sharpness: float
    least: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text; texts as _bytes makes them."""
        starts = np.append(0, np.cumsum([len(t) + 2 for t in texts]))
        # two bytes part the texts, and no stretch that touches them counts
        data = np.frombuffer(b"\0\0".join(texts) + b"\0\0\0\0\0", np.uint8)
        total = np.zeros((len(texts), len(self.languages)))
        number = np.zeros(len(texts))
        for n, h in zip((3, 4), _hashes(data), strict=True):
            ends = np.maximum(starts[1:] - 2 - n + 1, starts[:-1])
            edges = np.stack([starts[:-1], ends], 1).ravel()
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.table[k][h], edges)[::2] * (ends > starts[:-1])
            number += ends - starts[:-1]
        return total / np.maximum(number, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        found: list = [(UNKNOWN, 0.0, True)] * len(texts)
        good = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        if good:
            p = _softmax(self.logits([_bytes(texts[i]) for i in good]) * self.sharpness)
            best, top = p.argmax(1).tolist(), p.max(1).tolist()
            for i, k, s in zip(good, best, top, strict=True):
                found[i] = (self.languages[k], min(1.0, s), s < self.least)
        return found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Examples:
    """Distinct buckets and their numbers for many texts, end to end in two buffers: four bytes for each bucket of a text, given back
    to the system as a whole. Single arrays would leave the driver's memory in pieces that stay for all that runs later."""

    def __init__(self):
        self.buckets, self.times, self.ends, self.labels = array("H"), array("H"), [0], []

    def __len__(self) -> int:
        return len(self.labels)

    def add(self, data: bytes, label: int) -> None:
        h = np.concatenate(_hashes(np.frombuffer(data + b" " * max(0, 5 - len(data)), np.uint8)))
        where, n = np.unique(h, return_counts=True)
        if n.max() > 65535:
            n = np.maximum(n * 65535 // n.max(), 1)  # shares are what counts
        self.buckets.frombytes(where.astype("u2").tobytes())
        self.times.frombytes(n.astype("u2").tobytes())
        self.ends.append(len(self.buckets))
        self.labels.append(label)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets, their shares, and the label."""
        here = slice(self.ends[k], self.ends[k + 1])
        n = np.frombuffer(self.times, np.uint16)[here]
        return np.frombuffer(self.buckets, np.uint16)[here].astype(np.int64), (n / n.sum(dtype=np.int64)).astype(np.float32), self.labels[k]


def fit(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 0.8, seed: int = 1) -> Model:
    """Train on whole texts and on short stretches of them, so that short texts are known too."""
    kinds = sorted(set(languages))
    if not kinds:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0, 0.0)
    pick = np.random.default_rng(seed)
    examples, held = Examples(), []
    for i, (text, lang) in enumerate(zip(texts, languages, strict=True)):
        data = _bytes(text)
        y = kinds.index(lang)
        cuts = [data] + [data[a : a + n] for n in (60, 240) if len(data) > n and (a := int(pick.integers(0, len(data) - n))) >= 0]
        if i % 10 == 9:
            held.append((data, y))
            continue
        for cut in cuts:
            examples.add(cut, y)
    embed = pick.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(kinds)), np.float32), np.zeros(len(kinds), np.float32)
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for k in pick.permutation(len(examples)):
            where, share, y = examples[k]
            now = rate * (1 - step / steps)
            step += 1
            rows = embed[where]
            mean = share @ rows
            p = _softmax((mean @ layer + bias)[None])[0]
            p[y] -= 1
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            # a row's share is small; scaled up as if each subword were a sample of the text
            embed[where] = rows - (now * len(where) ** 0.5) * share[:, None] * back[None]
    model = Model(kinds, np.ascontiguousarray((embed @ layer).T), bias.astype(float), 1.0, 0.0)
    if held:
        z, y = model.logits([d for d, _ in held]), np.array([y for _, y in held])
        sharp = np.geomspace(0.25, 64, 33)
        model.sharpness = float(min(sharp, key=lambda s: -np.log(np.maximum(_softmax(z * s)[np.arange(len(y)), y], 1e-12)).mean()))
        p = _softmax(z * model.sharpness)
        right = p.max(1)[p.argmax(1) == y]
        if len(right):
            model.least = float(min(0.5, np.quantile(right, 0.001)))
    return model


def learn(docs: DataFrame, per_lang: int = 1500, longest: int = 20_000, most: int = 500) -> Model:
    """Fit on the bounded sample of ``docs`` (doc_id, text, lang)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= longest)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    drawn = drawn.limit(2 * per_lang * len(counts))  # equal rows share a hash, so all or none of them are drawn
    rows = sorted(drawn.collect(), key=lambda r: (str(r.doc_id), r.text, r["lang"]))
    order = np.random.default_rng(0).permutation(len(rows))
    return fit([rows[i].text for i in order], [rows[i]["lang"] for i in order])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, (doc_id,) in predicted(batch, held.value, ("doc_id",)):
                yield pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), *found], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with the same columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, columns in predicted(batch, held.value, batch.schema.names):
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.compute.invert(found[2]))

    return docs.mapInArrow(run, docs.schema)


def predicted(batch: pa.RecordBatch, model: Model, names):
    """Pieces of a batch: the predictions as arrays, and the columns of these names."""
    text = batch.column(batch.schema.names.index("text"))
    sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
    for a, b in slices(sizes, BLOCK):
        lang, score, rejected = zip(*model.predict(text.slice(a, b - a).to_pylist()), strict=True)
        columns = [batch.column(batch.schema.names.index(n)).slice(a, b - a) for n in names]
        yield [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], columns
