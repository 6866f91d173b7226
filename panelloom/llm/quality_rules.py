"""Quality rules: word statistics, and compression bands by zstandard.

A text that compresses far better than prose of its length repeats itself or follows a template; one
that hardly compresses is noise. Limits depend on the length, since short texts compress less. The
whole document has to lie inside the band of its length, and so do at least half of its fixed chunks. A last
piece of under a quarter of a chunk belongs to the chunk before it, so every byte is judged.

A null text has no words, lines or symbols, and fails the base rules like any text of under 20 words.
Very long texts are measured whole, one at a time. Every row is judged alone, so repeated rows get the same
verdict. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame

from panelloom.llm.common import slices

#: Bytes of text handled at once, and of a chunk.
BLOCK, CHUNK = 2_000_000, 4096
#: Bytes -> least and largest ratio of original to compressed size (level 3); straight lines over log2(bytes) between.
#: Set on labelled prose so that none of the good documents falls outside.
BANDS = ((64, 0.80, 1.60), (128, 0.95, 1.68), (256, 1.10, 1.80), (512, 1.25, 1.95), (1024, 1.45, 2.09), (2048, 1.65, 2.22), (4096, 1.75, 2.31), (8192, 1.80, 2.42), (16384, 1.85, 2.52), (65536, 1.85, 2.65), (1 << 20, 1.85, 2.90))
_WINDOW, _SPACE, _SYMBOLS = 8, b" \t\n\x0b\x0c\r", b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, chunks_out long"


def limits(sizes, bands=BANDS):
    at, low, high = np.array(bands, float).T
    x = np.log2(np.maximum(sizes, 1))
    return np.interp(x, np.log2(at), low), np.interp(x, np.log2(at), high)


def chunks_of(data: bytes) -> list[bytes]:
    """Chunks of CHUNK bytes over the whole text, a short last piece with the one before; none for a text of one chunk."""
    if len(data) <= CHUNK:
        return []
    starts = [*range(0, len(data), CHUNK)]
    if len(data) - starts[-1] < CHUNK // 4:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words inside windows of eight that occur twice or more in it.

    Windows are named exactly: words get numbers, then pairs of numbers, pairs of pairs and pairs of
    those get numbers in turn. All texts of a block are named together.
    """
    counts = np.array([len(w) for w in words])
    total = int(counts.sum())
    if total < _WINDOW:
        return np.zeros(len(words), np.int64)
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for text in words for w in text), np.int64, total)
    doc = np.repeat(np.arange(len(words)), counts)
    place = np.arange(total)
    for step in (1, 2, 4):
        ok = doc[:-step] == doc[step:] if step < len(doc) else np.zeros(0, bool)
        left, right, doc, place = names[:-step][ok], names[step:][ok], doc[:-step][ok], place[:-step][ok]
        if not len(left):
            return np.zeros(len(words), np.int64)
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
    key = doc * (int(names.max()) + 1) + names
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    again = place[n[back] > 1]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + _WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(words)), counts)[covered], minlength=len(words))


def measured(texts: list[bytes | None], compressor: zstandard.ZstdCompressor, bands=BANDS) -> list[tuple]:
    """The columns of SCHEMA after doc_id, for each text."""
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    repeats = repeated_words(words).tolist()
    found = []
    for data, held, n_repeat in zip(texts, words, repeats, strict=True):
        n = len(held)
        tight = data.translate(None, _SPACE)
        chars = len(tight) if tight.isascii() else len(tight.decode(errors="replace"))
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        failed = n < 20 or 100 * n_repeat > 30 * n
        ratio, chunks, out, kept = None, 0, 0, False
        if data:
            parts = [data, *chunks_of(data)]
            ratios = np.array([len(p) / len(compressor.compress(p)) for p in parts])
            low, high = limits([len(p) for p in parts], bands)
            bad = (ratios < low) | (ratios > high)
            ratio, chunks, out = float(ratios[0]), len(ratios) - 1, int(bad[1:].sum())
            kept = not failed and not bad[0] and 2 * out <= chunks
        found.append((n, chars, len(tight) - len(tight.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed, bool(kept), ratio, chunks, out))
    return found


def quality(docs: DataFrame, bands=BANDS) -> DataFrame:
    """The columns of SCHEMA for each document; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc_id, text = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary())
            sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
            for a, b in slices(sizes, BLOCK):
                columns = zip(*measured(text.slice(a, b - a).to_pylist(), compressor, bands), strict=True)
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([doc_id.slice(a, b - a), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
