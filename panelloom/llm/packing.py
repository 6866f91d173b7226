"""Packing of token sequences: dominance reduction and best fit on the counts of each length, and exact places for every piece.

A document is its token ids and an end. One longer than the capacity is cut into pieces of the capacity, of which the first may be
shorter. Pieces of one length are alike, so the whole instance is a count for each length, ``capacity`` numbers at most whatever
the corpus holds. On those numbers:

1. Martello and Toth's reduction: for the longest piece that is left, a set of at most three pieces (it alone, with one, or with
   two others) that provably dominates every other set that could hold it becomes a sequence for good. Equal cases are taken together,
   as often as the counts allow, until no piece has such a set.
2. Best fit, longest first, of what remains; all pieces of a length at once, into the sequences with the least room for them. Best
   fit of the whole instance is also tried, and the plan of fewer sequences stands; reduction can't make the best plan worse.

The plan says for each length which of its pieces, by number, go where. Pieces get their numbers in two steps: within their task while
they are encoded, and by running totals of the tasks' counts for each length. So only the counts of lengths reach the driver, and only the plan,
whose size depends on the capacity, goes to the tasks.

A null or empty text is its end alone. Special strings inside a text are special tokens, as the library has them by default. Repeated rows
and null doc_ids are packed like others. Other columns aren't read. An empty table gives an empty result. Very long texts are encoded
whole; white space beyond what the library's pattern can take is split by the same pattern elsewhere.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.bpe_codec import unicode_spaces
from panelloom.llm.common import durable, slices
from panelloom.llm.token_counts import byte_letters

#: Rows of running totals that are sent to every task, beyond which they are joined; bits for a piece's number beside its length.
BROADCAST, NUMBER_BITS = 200_000, 48
#: Byte-level tokenizers split by this unless their file says otherwise.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """The ids of a byte-level BPE tokenizer file; its vocabulary in the order of its merges are the ranks that the merging library takes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, byte = spec["pre_tokenizer"], {c: b for b, c in enumerate(byte_letters())}
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError("the file has other steps than this operator takes")
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pattern = regex.compile(unicode_spaces(PATTERN))

    @classmethod
    def load(cls, path: str) -> "Encoder":
        """One for each worker process."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.library.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern gives up on very long runs of white space
            parts = self._split.split(text) if self._split else [text]
            found: list[int] = []
            for part in parts:
                if part in self.special:
                    found.append(self.special[part])
                else:
                    for piece in self._pattern.findall(part):
                        found += self.library._encode_single_piece(piece)
            return np.array(found, np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, number, and ids if asked for): ``number`` counts the task's pieces of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder.load(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            text = batch.column(1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
            for a, b in slices(sizes, 2_000_000):
                columns: list[list] = [[] for _ in range(7)]
                for doc_id, t in zip(batch.column(0).slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist(), strict=True):
                    ids = np.append(encoder.ids(t), np.uint32(end)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    data = memoryview(ids.tobytes())
                    for piece, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        row = (doc_id, piece, x, y - x, zlib.crc32(data[4 * x : 4 * y]), seen[y - x])
                        seen[y - x] += 1
                        for column, value in zip(columns, row, strict=False):
                            column.append(value)
                        if with_ids:
                            columns[6].append(ids[x:y].astype(np.int32))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(c, k) for c, k in zip(columns[: 6 + with_ids], kinds, strict=False)]
                arrays.insert(5, pa.array([task] * len(columns[0]), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# --- the plan: on counts of lengths --------------------------------------------------------------

#: Contents of a sequence as (length, copies), longest first, and how many sequences have them.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length j, of three at most, that dominates every other feasible set with it; None if there isn't one to be told.

    A set dominates another if the other's pieces can be dealt out to some of its own, none of which is exceeded.
    """
    room = capacity - j
    held = counts[: room + 1].copy()
    if j <= room:
        held[j] -= 1
    sizes = np.flatnonzero(held)
    if not len(sizes):
        return (j,)
    best = int(sizes[-1])  # no single piece beside j is longer
    small = np.repeat(sizes[:3], np.minimum(held[sizes[:3]], 3))[:3].cumsum()
    if best == room or len(small) < 2 or small[1] > room:
        return (j, best)  # all that can lie beside j together is no longer than it
    if len(small) > 2 and small[2] <= room:
        return None
    # Two others at most: for each r the longest s <= r that fits with both.
    most = np.minimum(room - sizes, sizes)
    at = np.searchsorted(sizes, most, side="right") - 1
    twice = (at >= 0) & (sizes[at.clip(0)] == sizes) & (held[sizes] < 2)  # one piece can't lie there twice
    at = np.where(twice, at - 1, at)
    r, s = sizes[at >= 0], sizes[at[at >= 0]]
    if best >= (r + s).max():
        return (j, best)
    own = s[r == best]
    if not len(own):
        return None
    other = int(own[0])
    return (j, best, other) if bool(((s <= other) | (r + s <= best)).all()) else None


def reduced(counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Sequences that are fixed, and the counts that are left."""
    left, plan, going = counts.copy(), [], True
    while going:
        going = False
        for j in range(capacity, 0, -1):
            while left[j] and (found := dominating(left, j, capacity)):
                lengths, copies = np.unique(found, return_counts=True)
                # What dominates goes on to do so while there are such pieces: other sets only become fewer.
                times = int((left[lengths] // copies).min())
                left[lengths] -= copies * times
                plan.append((tuple(zip(lengths.tolist()[::-1], copies.tolist()[::-1], strict=True)), times))
                going = True
    return plan, left


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first; sequences with the same contents are handled together."""
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by room: [contents, how many]
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            room = next((r for r in range(size, capacity + 1) if open_[r]), None)
            contents, have = open_[room].pop() if room is not None else ((), math.inf)
            room = capacity if room is None else room
            each = room // size  # having taken one, a sequence has still the least room that is enough
            full = min(have, n // each)
            taken = [(each, full)] * (full > 0)
            n, have = n - each * full, have - full
            if 0 < n < each and have:
                taken.append((n, 1))
                n, have = 0, have - 1
            for copies, times in taken:
                open_[room - size * copies].append(((*contents, (size, copies)), times))
            if have and have < math.inf:
                open_[room].append((contents, have))
    return [x for group in open_ for x in group]


def planned(counts: np.ndarray, capacity: int) -> Plan:
    """The plan of fewer sequences: reduction and best fit of the rest, or best fit alone."""
    fixed, left = reduced(counts, capacity)
    return min(fixed + best_fit(left, capacity), best_fit(counts, capacity), key=lambda p: sum(n for _, n in p))


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: no packing has fewer."""
    lengths, best = np.arange(capacity + 1), -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    for small in [0, *np.flatnonzero(counts[: capacity // 2 + 1]).tolist()]:
        large, middle = lengths > capacity - small, (lengths > capacity / 2) & (lengths <= capacity - small)
        low = (lengths >= small) & (lengths <= capacity / 2)
        free = int((counts * (capacity - lengths))[middle].sum())
        more = int((counts * lengths)[low].sum()) - free
        best = max(best, int(counts[large | middle].sum()) + max(0, -(-more // capacity)))
    return best


def places(plan: Plan) -> np.ndarray:
    """Rows (key, copies, sequence, offset): from piece ``key % 2^NUMBER_BITS`` of length ``key / 2^NUMBER_BITS`` on, ``copies`` to a sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, times in plan:
        offset = 0
        for length, copies in contents:
            rows.append((length << NUMBER_BITS | used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- the pieces' places --------------------------------------------------------------------------


def packed(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for) for each piece."""
    made = durable(pieces(docs, path, capacity, end, with_ids))  # tasks and numbers are part of the written rows
    sums = durable(made.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r.length] = r.n
    sent = docs.sparkSession.sparkContext.broadcast(places(planned(counts, capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("task", "length", before.alias("before"))
    before = F.broadcast(before) if sums.count() <= BROADCAST else before
    numbered = made.join(before, ["task", "length"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, number = columns["length"].to_numpy(), columns.pop("number").to_numpy()
            at = np.searchsorted(table[:, 0], (length << NUMBER_BITS) | number, side="right") - 1
            key, copies, sequence, offset = table[at].T
            nth = number - (key & ((1 << NUMBER_BITS) - 1))
            columns |= {"sequence_id": pa.array(sequence + nth // copies), "offset": pa.array(offset + length * (nth % copies))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = {"piece": "int", "ids": "array<int>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*fields, "sequence_id", "offset"])
    ordered = numbered.select(*fields, "number")
    return ordered.mapInArrow(run, schema)


def sequences(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the packed sequences themselves, with the document and the place of each piece in order."""
    rows = packed(docs, path, capacity, end, with_ids=True)
    # at most ``capacity`` tokens meet in a group
    held = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
