"""Byte-level BPE encoding and decoding by a table of token ranks.

Texts are split by the tokenizer's pattern. Pieces that are not tokens themselves go, in buckets of
similar length, into padded numpy matrices; in every round each row merges its leftmost pair of the
least rank, found in a hashed pair table, and closes the gap. Pieces above ``LONG`` bytes, which would
need as many rounds as they have bytes, take the same merges from a heap.

A null or empty text has no ids and decodes to no bytes. Results of pieces are remembered per worker in two
generations of about ``REMEMBERED`` pieces, long ones counted by their length: when the younger is full, the elder is forgotten and
takes its place, and pieces met again move to the younger. So memory doesn't grow with the corpus, and frequent pieces aren't merged anew.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from panelloom.llm.common import slices
from panelloom.llm.pair_merge import PairTable, merge_long, merge_padded

#: Bytes of text handled at once, pieces remembered in a generation, characters that count as one piece, and the longest piece for the matrices.
BLOCK, REMEMBERED, CHARACTERS, LONG = 1_000_000, 75_000, 32, 512
_LOADED: dict[tuple, "Codec"] = {}


def unicode_spaces(pattern: str) -> str:
    r"""``pattern`` with \s as the White_Space property, as the tokenizers' libraries take it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Codec:
    """Ranks read from a file of lines ``<base64 token> <rank>``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(unicode_spaces(pattern))
        self.token = {i: t for t, i in self.ranks.items()}
        splits = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = map(np.array, zip(*splits, strict=True))
        self.table = PairTable(left, right, merged, merged)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.held = 0
        self._pairs: dict | None = None

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        """One codec for each worker process."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]

    def _long(self, piece: bytes) -> bytes:
        if self._pairs is None:
            held = self.table._keys[self.table._keys >= 0]
            a, b = held >> 32, held & 0xFFFFFFFF
            m = self.table.merged[self.table.find(a, b)]
            self._pairs = {(x, y): (z, z) for x, y, z in zip(a.tolist(), b.tolist(), m.tolist(), strict=True)}
        return np.array(merge_long(self.single[np.frombuffer(piece, np.uint8)].tolist(), self._pairs), "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of new pieces, as little-endian 32-bit integers, into ``known``."""
        buckets: dict[int, list] = {}
        for piece in pieces:
            data = piece.encode()
            if (token := self.ranks.get(data)) is not None:
                self.known[piece] = token.to_bytes(4, "little")
            elif len(data) > LONG:
                self.known[piece] = self._long(data)
            else:
                buckets.setdefault((len(data) + 3) // 4, []).append((piece, data))
        for quarter, held in buckets.items():
            width = quarter * 4
            for start in range(0, len(held), rows := max(64, 400_000 // width)):
                part = held[start : start + rows]
                lengths = np.array([len(d) for _, d in part])
                raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(len(part), width)
                symbols = self.single[raw]
                left = merge_padded(symbols, lengths, self.table)
                data, wide = symbols.astype("<u4").tobytes(), width * 4
                for i, ((piece, _), n) in enumerate(zip(part, left.tolist(), strict=True)):
                    self.known[piece] = data[i * wide : i * wide + 4 * n]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.known, self.elder, self.held = {}, self.known, 0
        missing = set().union(*split).difference(self.known)
        met = self.elder.keys() & missing
        self.known.update((piece, self.elder.pop(piece)) for piece in met)
        new = list(missing.difference(met))
        if new:
            self.encode_pieces(new)
        self.held += len(missing) + sum(map(len, missing)) // CHARACTERS
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes of a list of ids; an id without a token raises KeyError."""
        return b"".join(map(self.token.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) for each document: the operator's plain output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for doc_id, texts in _blocks(batches):
            packed = codec.encode_packed(texts)
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([doc_id, ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_id, texts in _blocks(batches):
            packed = codec.encode_packed(texts)
            decoded = [sha(codec.decode(np.frombuffer(p, "<u4").tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(list(map(sha, packed)), pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        doc_id, text = batch.column(0).cast(pa.int64()), batch.column(1)
        sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
        for a, b in slices(sizes, BLOCK):
            yield doc_id.slice(a, b - a), text.slice(a, b - a).to_pylist()
