"""What filters take from a corpus in every order: kept, removed, redundant and unique losses, and each filter's mean share.

The five filters: A, under 100 words; B, under 80 distinct words in 100; C, over 10 capitals A-Z in 100 code points; D, any of
``#$%&*|``; E, the text of a smaller doc_id. Words are runs without ASCII white space, told apart by case.

1. One pass of a byte transducer reads each text: its state is whether a word is open, and the table holds for each state and byte
   what is put out: a word begins or ends, a capital, a symbol, a code point. The next state depends on the byte alone, so
   the states of a whole array are one lookup. It goes through a long text piece by piece and keeps its state, as does the hash
   of the word that is open.
2. Word spans go into an open-addressing hash table by document and hash. A span that meets another in its slot is
   compared with it, hash, length and all bytes, and goes on to the next slot if it differs; so distinct words are exact.
3. Each document becomes a set of filters that it fails. The smallest doc_id of each text is found by digest; a row joins it by doc_id and
   digest, so that no group of copies meets in a task. Documents are counted by part and set, and only those counts, 32 a
   part at most, are laid out over the 120 orders.

A null text is empty: it fails A, and E if any smaller doc_id's text is null or empty. A null part is ''. A null doc_id is no
smaller and no greater than any other: it doesn't fail E, makes none fail, and has no labels. Repeated rows are documents of their own; rows that
share the smallest doc_id of a text don't fail E. Of several labels of a doc_id one that is set counts. Other columns aren't read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import durable, slices

#: Bytes that the pass takes at once.
PIECE = 1 << 20
FILTERS = "ABCDE"
#: States, and what the transducer puts out.
GAP, WORD = 0, 1
BEGIN, END, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8, 16
_SPACES, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte, and what is put out for each state and byte."""
    after = np.full(256, WORD, np.uint8)
    after[list(_SPACES)] = GAP
    out = np.zeros((2, 256), np.uint8)
    out[GAP, after == WORD] |= BEGIN
    out[WORD, after == GAP] |= END
    out[:, ord("A") : ord("Z") + 1] |= CAPITAL
    out[:, list(_SYMBOLS)] |= SYMBOL
    out[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    return after, out


AFTER, OUT = _transducer()


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, for the places of a piece."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PIECE + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


class WordTable:
    """Distinct words of documents as spans of one buffer of bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.start, self.size, self.mark, self.doc = (np.zeros(0, np.int64) for _ in range(4))
        self.slots = np.full(1 << 12, -1, np.int64)

    def _slot(self, mark: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = (mark.view(np.uint64) ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        return (key >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans of entries a and b hold the same bytes."""
        same = (self.mark[a] == self.mark[b]) & (self.size[a] == self.size[b]) & (self.doc[a] == self.doc[b])
        at = np.flatnonzero(same)
        x, y, size, k = self.start[a[at]], self.start[b[at]], self.size[a[at]], 0
        while len(at):
            wrong = self.data[x + k] != self.data[y + k]
            same[at[wrong]] = False
            k += 1
            more = ~wrong & (size > k)
            at, x, y, size = at[more], x[more], y[more], size[more]
        return same

    def insert(self, start: np.ndarray, size: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The documents of those words that are new, one entry for each."""
        held, n = len(self.start), len(start)
        while 2 * (held + n) > len(self.slots):  # entries find new slots in a table twice as large
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            if 2 * (held + n) <= len(self.slots) and held:
                self._place(np.arange(held), compare=False)
        self.start, self.size, self.mark, self.doc = (np.concatenate(x) for x in ((self.start, start), (self.size, size), (self.mark, mark), (self.doc, doc)))
        new, slots = self._place(np.arange(held, held + n))
        order = np.argsort(new, kind="stable")
        new, slots = new[order], slots[order]
        self.slots[slots] = held + np.arange(len(new))  # entries that were met before leave no gaps
        self.start, self.size, self.mark, self.doc = (np.concatenate([x[:held], x[new]]) for x in (self.start, self.size, self.mark, self.doc))
        return self.doc[held:]

    def _place(self, ids: np.ndarray, compare: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Entries that took a slot, and their slots; others equal one that has."""
        slot = self._slot(self.mark[ids], self.doc[ids])
        taken, at = [], []
        while len(ids):
            free = np.flatnonzero(self.slots[slot] < 0)[::-1]  # of several the first comes last and stays
            self.slots[slot[free]] = ids[free]
            holder = self.slots[slot]
            mine = holder == ids
            taken.append(ids[mine])
            at.append(slot[mine])
            rest = np.flatnonzero(~mine)
            if compare and len(rest):
                rest = rest[~self._equal(ids[rest], holder[rest])]
            ids, slot = ids[rest], (slot[rest] + 1) & (len(self.slots) - 1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *taken]), np.concatenate([none, *at])


def counts(texts: list[bytes]) -> np.ndarray:
    """For each text: words, distinct words, capitals, code points, symbols."""
    found = np.zeros((len(texts), 5), np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space after each text closes its last word
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.append(0, np.cumsum(sizes + 1))
    table = WordTable(data)
    power, inverse = _powers()
    state, summed, scale, unscale = GAP, np.uint64(0), np.uint64(1), np.uint64(1)
    open_at, open_sum, open_un = 0, np.uint64(0), np.uint64(1)
    for a in range(0, len(data), PIECE):
        piece = data[a : a + PIECE]
        states = AFTER[piece]
        before = np.append(np.uint8(state), states[:-1])
        out = OUT[before, piece]
        state = int(states[-1])
        for column, kind in ((2, CAPITAL), (4, SYMBOL)):
            found[:, column] += np.diff(np.searchsorted(np.flatnonzero(out & kind) + a, firsts))
        rest = np.flatnonzero((out & POINT) == 0) + a
        within = np.clip(firsts, a, a + len(piece))
        found[:, 3] += np.diff(within) - np.diff(np.searchsorted(rest, firsts))
        with np.errstate(over="ignore"):
            sums = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], dtype=np.uint64) * scale + summed
            upto = np.append(summed, sums[:-1])
            begin, end = np.flatnonzero(out & BEGIN), np.flatnonzero(out & END)
            start, base, un = begin + a, upto[begin], inverse[begin] * unscale
            if len(end) and (not len(begin) or begin[0] > end[0]):  # the word that was open
                start, base, un = np.append(open_at, start), np.append(open_sum, base), np.append(open_un, un)
            if len(start) > len(end):
                open_at, open_sum, open_un = int(start[-1]), base[-1], un[-1]
            start, base, un = start[: len(end)], base[: len(end)], un[: len(end)]
            mark = ((upto[end] - base) * un).view(np.int64)
            summed, scale, unscale = sums[-1], scale * power[len(piece)], unscale * inverse[len(piece)]
        doc = np.searchsorted(firsts, start, side="right") - 1
        found[:, 0] += np.bincount(doc, minlength=len(texts))
        found[:, 1] += np.bincount(table.insert(start, end + a - start, mark, doc), minlength=len(texts))
    found[:, 3] -= 1  # the space after it
    return found


def failures(found: np.ndarray) -> np.ndarray:
    """Bit k is set where filter k of A to D is failed."""
    words, distinct, capitals, points, symbols = found.T
    return (words < 100) | (100 * distinct < 80 * words) << 1 | (100 * capitals > 10 * points) << 2 | (symbols > 0) << 3


def measured(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mark, n_words, n_distinct, n_capitals, n_points, n_symbols, fails) for each document; mark is a digest of the text."""
    names = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(text).to_pylist(), PIECE - PIECE // 4):
                texts = text.slice(a, b - a).to_pylist()
                found = counts(texts)
                marks = pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary())
                columns = [pa.array(found[:, k]) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), marks, *columns, pa.array(failures(found).astype(np.int32))], ["doc_id", "part", "mark", *names, "fails"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return held.mapInArrow(run, f"doc_id long, part string, mark binary, {', '.join(f'{n} long' for n in names)}, fails int")


def failed_sets(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents by the set of filters that they fail, as five bits, and the labelled ones among them."""
    rows = durable(measured(docs, part).select("doc_id", "part", "mark", "fails"))
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("mark").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    of = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    known = known.join(first, ["doc_id", "mark"], "left").join(of, "doc_id", "left")
    known = known.select("part", (F.col("fails") + F.when(F.col("is_first"), 0).otherwise(16)).alias("fails"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = rows.filter("doc_id IS NULL").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.union(rest).groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step."""
    sets = failed_sets(docs, labels, part)
    orders = sets.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    earlier = F.col("filter_order").substr(F.lit(1), F.col("step") - 1)
    laid = orders.withColumns({"letter": letter, "own": F.col("fails").bitwiseAND(bits(letter)) != 0, "gone": F.col("fails").bitwiseAND(bits(earlier)) != 0, "only": F.col("fails") == bits(letter)})
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    own, gone = F.col("own"), F.col("gone")
    steps = laid.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", ~own & ~gone).alias("kept"), total("n", own & ~gone).alias("removed"), total("n", own & gone).alias("redundant"), total("n", F.col("only")).alias("unique_fails"),
        total("good", own & ~gone).alias("good_lost"), total("toxic", own & ~gone).alias("toxic_lost"),
    )
    # 120 rows for each part and filter
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


#: ``audit`` for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * capitals > 10 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
k AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS own, fails = letter AS single,
    earlier <> '' AND length(translate(fails, earlier, '')) < length(fails) AS gone
  FROM s, k),
g AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
