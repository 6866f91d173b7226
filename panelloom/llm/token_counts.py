"""Token counts of a lower-casing BPE tokenizer whose words end in a suffix, by rank-synchronous array merging.

New pre-tokens of a block lie end to end in one ragged numpy array; each round finds every
sequence's lowest-rank pair by a segmented minimum, merges all those pairs at once, and sequences
without a pair leave. The symbols that survive are counted. Pre-tokens above ``LONG`` bytes take the
same merges from a heap, since a round merges once for each sequence.

A null or empty text has no tokens. Special strings inside a text count as one token each, as the
library's default has it. Counts of words are remembered per worker up to ``REMEMBERED`` words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from panelloom.llm.bpe_codec import unicode_spaces
from panelloom.llm.common import slices
from panelloom.llm.pair_merge import PairTable, merge_long, merge_ragged

#: Bytes of text handled at once, words remembered, and the longest pre-token for the arrays.
BLOCK, REMEMBERED, LONG = 2_000_000, 400_000, 512
#: Control characters that Python's split takes as white space and Unicode's White_Space does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")
_LOADED: dict[str, "Counter"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Read from a tokenizer file with NFC, white-space and lower-case normalizers, one split pattern and BPE merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE":
            raise ValueError("the file has other steps than this operator takes")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(unicode_spaces(pattern))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = ([vocab[p[k]] for p in pairs] for k in (0, 1))
        merged = [vocab[a + b] for a, b in pairs]
        self.table = PairTable(left, right, range(len(pairs)), merged)
        self._pairs = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left, right, merged, strict=True))}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> "Counter":
        """One counter for each worker process."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Surviving symbols of each pre-token."""
        data = [p.encode() for p in pieces]
        counts = [0] * len(data)
        short = []
        for i, d in enumerate(data):
            if len(d) > LONG:
                symbols = self.inner[np.frombuffer(d, np.uint8)]
                symbols[-1] = self.last[d[-1]]
                counts[i] = len(merge_long(symbols.tolist(), self._pairs))
            else:
                short.append(i)
        for a, b in slices([len(data[i]) for i in short], 1_000_000):
            part = [data[i] for i in short[a:b]]
            starts = np.append(0, np.cumsum([len(d) for d in part]))
            raw = np.frombuffer(b"".join(part), np.uint8)
            flat = self.inner[raw]
            flat[starts[1:] - 1] = self.last[raw[starts[1:] - 1]]
            _, ends = merge_ragged(flat, starts, self.table)
            for i, n in zip(short[a:b], np.diff(ends).tolist(), strict=True):
                counts[i] = n
        return counts

    def words(self, text: str) -> tuple[list[str], int]:
        """Normalized stretches without white space, which no pre-token crosses, and the number of special strings."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ")  # each letter alone: no final form
            spread = _SPACES.split(part) if _SEPARATORS.search(part) else part.split()
            # white space and lower-casing commute, so the words can be cut first
            found += " ".join(spread).lower().split(" ") if spread else []
        return found, len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.words(t) if t else ([], 0) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*(w for w, _ in split)).difference(self.known))
        if new:
            cut = [self.pattern.findall(w) for w in new]
            pieces = list(set().union(*cut))
            of = dict(zip(pieces, self.piece_counts(pieces), strict=True))
            self.known.update((w, sum(map(of.__getitem__, c))) for w, c in zip(new, cut, strict=True))
        get = self.known.__getitem__
        return [sum(map(get, w)) + n for w, n in split]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each document, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path)
        for batch in batches:
            doc_id, text = batch.column(0).cast(pa.int64()), batch.column(1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
            counts: list[int] = []
            for a, b in slices(sizes, BLOCK):
                counts += counter.count(text.slice(a, b - a).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
