"""Removal of long byte strings that occur elsewhere, by a distributed merge sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes.

1. Suffixes to sort are chosen by content: in each stretch of ``LENGTH`` bytes the k-byte string with
   the least hash is its anchor (the last of equal ones). Equal stretches have their anchors at the same
   place, so nothing is missed. Only anchors whose k-byte string's hash is met again need sorting; the
   hashes are counted over all texts, pre-aggregated by task.
2. Each task sorts its suffixes from those anchors, equal ones as one with all their places, and cuts
   them at common splitters into runs. Runs travel front-coded: the length of the prefix shared with
   the suffix before, and the rest.
3. Each range of suffixes merges its runs with a loser tree. Suffixes carry the length of the prefix
   they share with the last one put out: the longer is the smaller, and only where both are equal are
   bytes compared, from there on. Front-coded lengths serve as they come.
4. In the merged order suffixes that share their anchor's bytes lie together. A stretch that begins j
   bytes before its anchor repeats if another suffix shares ``LENGTH - j`` bytes with it and the j bytes
   before the anchor as well.
5. An anchor that more than ``HOT`` texts hold would put all its suffixes into one range. Its surroundings
   are compared by Spark instead: equal ones are one; the others meet on the ``LENGTH - SPAN`` bytes that all
   stretches of ``SPAN`` neighbouring starts share, and where two do, on each stretch's digest. All of that is
   counted before it is shuffled, and no task holds an anchor's places.

Texts are known by two 64-bit hashes. A text that is there twice or more is covered whole, if it has ``LENGTH`` bytes. A null text counts as
empty; nothing is removed from shorter texts. Rows are taken as they come, so repeated doc_ids are
texts of their own. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import durable

LENGTH, ANCHOR = 200, 72
#: Largest stretch of a text handled at once, and about how many suffixes a range gets.
SLICE, RANGE = 1 << 20, 60_000
#: Hashes of texts (8 bytes each) up to which they are broadcast; beyond, the joins shuffle.
BROADCAST = 500_000
SAMPLE = 20_000
#: Texts of one anchor above which its suffixes don't go to one range; starts that are first compared together.
HOT, SPAN = 10_000, 16
#: Texts that a task remembers as done.
REMEMBERED = 100_000
_MARK = ["m1", "m2"]
_WINDOW = LENGTH - ANCHOR + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(data: bytes):
    """(first start, last start, anchor, hash) of the stretches of LENGTH bytes that share an anchor, over a whole text."""
    found = []
    for begin in range(0, max(1, len(data) - LENGTH + 1), SLICE - LENGTH + 1):
        part = data[begin : begin + SLICE]
        if len(part) >= LENGTH:
            lo, hi, at, h = _anchors(np.frombuffer(part, np.uint8))
            found.append((lo + begin, hi + begin, at + begin, h))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(a: np.ndarray):
    if not _POWERS:
        for step in (_BASE, _BACK):
            _POWERS.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE, step)])))
    up, down = _POWERS
    n = len(a)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    m = len(h)
    # the hash's upper bits, then the place from the end: the least is the last of those with the least hash
    mixed = (h & ~np.uint64(SLICE - 1)) | np.arange(m - 1, -1, -1, dtype=np.uint64)
    blocks = -(-m // _WINDOW)
    padded = np.full(blocks * _WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = mixed
    grid = padded.reshape(blocks, _WINDOW)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[_WINDOW - 1 : _WINDOW - 1 + starts])
    at = m - 1 - (least & np.uint64(SLICE - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.append(first[1:], starts) - 1, at[first], h[at[first]]


def _shared(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(x), len(y))
    if x[start:n] == y[start:n]:
        return n
    diff = int.from_bytes(x[start:n], "big") ^ int.from_bytes(y[start:n], "big")
    return n - (diff.bit_length() + 7) // 8


class Entry:
    """A suffix from its anchor, the reversed bytes before it, the least distance of a start, and all places (two hashes of the text, anchor)."""

    __slots__ = ("right", "left", "least", "places")

    def __init__(self, right, left, least, places):
        self.right, self.left, self.least, self.places = right, left, least, places


def entries(data: bytes, wanted: set[int], text: tuple[int, int]):
    """The suffixes of a text whose anchors are wanted."""
    for lo, hi, a, h in zip(*(x.tolist() for x in anchors(data)), strict=True):
        if h in wanted:
            yield Entry(data[a : hi + LENGTH], data[lo:a][::-1], a - hi, [(*text, a)])


def packed(run: list[Entry]) -> tuple:
    """A sorted run, front-coded, as binary columns."""
    lcp, tails, before = [], [], b""
    for e in run:
        n = _shared(before, e.right)
        lcp.append(n)
        tails.append(e.right[n:])
        before = e.right
    numbers = lambda x, t: np.array(list(x), t).tobytes()
    return (
        numbers(lcp, "<u2"), numbers(map(len, tails), "<u2"), b"".join(tails), numbers((len(e.left) for e in run), "<u2"), b"".join(e.left for e in run),
        numbers((e.least for e in run), "<i2"), numbers((len(e.places) for e in run), "<i4"), *(numbers((p[k] for e in run for p in e.places), "<i8") for k in range(3)),
    )


_COLUMNS = ("lcp", "sizes", "tails", "left_sizes", "lefts", "least", "counts", "m1", "m2", "at")
RUN_SCHEMA = "part int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def unpacked(columns: tuple) -> Iterator[tuple[int, Entry]]:
    """(length of the prefix shared with the one before, suffix) in order."""
    lcp, sizes, tails, left_sizes, lefts, least, counts, *places = columns
    ints = lambda x, t: np.frombuffer(x, t).tolist()
    places = list(zip(*(ints(x, "<i8") for x in places), strict=True))
    i = j = k = 0
    before = b""
    for n, size, left, low, count in zip(ints(lcp, "<u2"), ints(sizes, "<u2"), ints(left_sizes, "<u2"), ints(least, "<i2"), ints(counts, "<i4"), strict=True):
        before = before[:n] + tails[i : i + size]
        yield n, Entry(before, lefts[j : j + left], low, places[k : k + count])
        i, j, k = i + size, j + left, k + count


def merged(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """(length of the prefix shared with the one before, suffix) over all runs, by a loser tree that knows common prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # bytes shared with the last suffix put out
    losers = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        if heads[x] is None:
            return y, x
        if heads[y] is None or known[x] > known[y]:
            return x, y
        if known[x] < known[y]:
            return y, x
        p, q = heads[x][1].right, heads[y][1].right
        n = _shared(p, q, known[x])
        if n == len(p) or (n < len(q) and p[n] < q[n]):
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        for i, (_, lost) in enumerate(pairs):
            losers[level + i] = lost
        winners = [w for w, _ in pairs]
    w = winners[0]
    while heads[w] is not None:
        yield known[w], heads[w][1]
        heads[w] = next(runs[w], None)
        if heads[w] is not None:
            known[w] = heads[w][0]
        node = (w + k) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2


def repeated(group: list[Entry], lcp: list[int]) -> Iterator[tuple[Entry, int, int]]:
    """(suffix, j1, j2): stretches that begin j1 .. j2 bytes before the anchor and repeat. ``lcp[i]`` is shared by suffixes i - 1 and i."""
    several = [e for e in group if len(e.places) > 1]
    for e in several:
        yield e, e.least, len(e.left)
    if len(group) < 2:
        return
    if len(group) <= 12:
        for i, j in combinations(range(len(group)), 2):
            x, y = group[i], group[j]
            low, high = LENGTH - min(lcp[i + 1 : j + 1]), _shared(x.left, y.left)
            for e in (x, y):
                if len(e.places) == 1 and (a := max(low, e.least)) <= (b := min(high, len(e.left))):
                    yield e, a, b
        return
    # many: for each j the suffixes fall into classes by the bytes after and by the bytes before
    n = len(group)
    after = np.array([0, *lcp[1:]])
    order = sorted(range(n), key=lambda i: group[i].left)
    before = np.array([0] + [_shared(group[a].left, group[b].left) for a, b in zip(order, order[1:], strict=False)])
    least, most = np.array([e.least for e in group]), np.array([len(e.left) for e in group])
    first, last = int(least.min()), int(most.max())
    found = np.zeros((n, last - first + 3), np.int8)
    for j in range(first, last + 1):
        right = np.cumsum(after < LENGTH - j)
        left = np.zeros(n, np.int64)
        left[order] = np.cumsum(before < j)
        ok = np.flatnonzero((least <= j) & (j <= most))
        _, back, count = np.unique(right[ok] * (n + 1) + left[ok], return_inverse=True, return_counts=True)
        found[ok[count[back] > 1], j - first + 1] = 1
    change = np.diff(found)
    for (i, a), (_, b) in zip(np.argwhere(change == 1).tolist(), np.argwhere(change == -1).tolist(), strict=True):
        yield group[i], a + first, b + first - 1


def spans(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, int, int, int]]:
    """(two hashes of the text, start, end) of the bytes that suffixes of these runs show to repeat."""

    def close():
        for e, a, b in repeated(group, lcp):
            for m1, m2, at in e.places:
                yield m1, m2, at - b, at - a + LENGTH

    group: list[Entry] = []
    lcp: list[int] = []
    for n, e in merged(runs):
        if group and n < ANCHOR:
            yield from close()
            group, lcp = [], []
        last = group[-1] if group else None
        # equal suffixes from several tasks come one after another, in any order of what lies before them
        same = None
        if last is not None and n == len(e.right) == len(last.right):
            same = next((g for g in reversed(group[-64:]) if g.right == e.right and g.left == e.left and g.least == e.least), None)
        if same is not None:
            same.places += e.places
            continue
        group.append(e)
        lcp.append(n)
    if group:
        yield from close()


def _marks() -> list:
    return [F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(LENGTH), "text").alias("m2")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_marks(), F.col("text"))


def _some(texts: DataFrame, marked: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """The texts whose marks are in a table of n rows, or the others: only those then move."""
    marks = marked.select(*_MARK)
    return texts.join(F.broadcast(marks) if n <= BROADCAST else marks, _MARK, how)


def _fresh(batches, others: int):
    """The two hashes, the text and ``others`` more values of each row, but for texts that the task has just had."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        more = [batch.column(3 + k) for k in range(others)]
        for i, mark in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if mark not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(mark)
                yield mark, texts[i].as_py() or b"", [x[i] for x in more]


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """m1, m2 (hashes of a text), and ``hashes`` of its anchors that are met again: those of at most HOT texts, and ``hot`` ones."""

    def run(batches):
        for mark, data, _ in _fresh(batches, 0):
            h, n = np.unique(anchors(data)[3], return_counts=True)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.full(len(h), m, np.int64)) for m in mark), pa.array(n > 1)], ["h", *_MARK, "twice"])

    met = _keyed(docs.filter(F.octet_length("text") >= LENGTH)).mapInArrow(run, "h long, m1 long, m2 long, twice boolean")
    again = met.groupBy("h").agg(*[f(m).alias(f"{m}{k}") for m in _MARK for k, f in (("a", F.min), ("b", F.max))], F.max("twice").alias("t"), F.count("*").alias("n"))
    again = again.filter("m1a < m1b OR m2a < m2b OR t").select("h", (F.col("n") > HOT).alias("is_hot"))
    held = met.select("h", *_MARK).join(again, "h")
    return held.groupBy(*_MARK).agg(F.collect_set(F.when(~F.col("is_hot"), F.col("h"))).alias("hashes"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("hot"))


def splitters(docs: DataFrame, parts: int) -> list[bytes]:
    """Borders of the ranges, from the anchors of a bounded sample of texts."""
    n = docs.count()
    share = min(1.0, 2000 / max(1, n))

    def run(batches):
        for _, data, _ in _fresh(batches, 0):
            _, _, at, _ = anchors(data)
            keys = [data[a : a + ANCHOR] for a in at[:: max(1, len(at) // 10)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["k"])

    drawn = _keyed(docs).filter(F.pmod("m1", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    keys = sorted(bytes(r.k) for r in drawn.mapInArrow(run, "k binary").limit(SAMPLE).collect())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _hot_spans(chosen: DataFrame) -> DataFrame:
    """m1, m2, start, end of the bytes about hot anchors that repeat. ``chosen``: m1, m2, text, hot."""

    def run(batches):
        told: set[bytes] = set()
        for (m1, m2), data, (hot,) in _fresh(batches, 1):
            places, around = [], []
            for e in entries(data, set(np.asarray(hot.values).view(np.uint64).tolist()), (m1, m2)):
                ctx = hashlib.md5(e.least.to_bytes(2, "little", signed=True) + len(e.left).to_bytes(2, "little") + e.left + e.right).digest()
                fresh = ctx not in told
                if fresh:
                    if len(told) >= REMEMBERED:
                        told.clear()
                    told.add(ctx)
                places.append((e.places[0][2], ctx))
                around.append((e.left, e.right, e.least) if fresh else (None, None, None))
            if places:
                at, ctx = zip(*places, strict=True)
                left, right, least = zip(*around, strict=True)
                many = len(at)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(many, m, np.int64)) for m in (m1, m2)), pa.array(at, pa.int64()), pa.array(ctx, pa.binary()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(least, pa.int32())],
                    [*_MARK, "at", "ctx", "lefts", "rights", "least"],
                )

    held = durable(chosen.select(*_MARK, "text", "hot").mapInArrow(run, "m1 long, m2 long, at long, ctx binary, lefts binary, rights binary, least int"))
    counts = held.groupBy("ctx").agg(F.count("*").alias("n"))
    around = held.filter("rights IS NOT NULL").select("ctx", "lefts", "rights", "least").dropDuplicates(["ctx"])
    most = F.octet_length("lefts")

    def shared(rows, key, at_least=2):
        """The rows whose key, a digest, is met in two surroundings or more; counted within tasks first."""
        again = durable(rows.groupBy(key).count().filter(F.col("count") >= at_least).select(key))
        return rows.join(F.broadcast(again) if again.count() <= BROADCAST else again, key, "left_semi")

    # Stretches of starts j1 .. j2 before the anchor all hold the j1 bytes before it and LENGTH - j2 bytes from it on.
    ranges = F.array(*[F.struct(F.lit(j).alias("j1"), F.lit(min(j + SPAN, _WINDOW) - 1).alias("j2")) for j in range(0, _WINDOW, SPAN)])
    common = lambda j1, j2: F.md5(F.concat(j1.cast("string").cast("binary"), F.substring("lefts", F.lit(1), j1), F.substring("rights", F.lit(1), LENGTH - j2)))
    cut = around.select("ctx", "lefts", "rights", "least", F.explode(ranges).alias("r")).select("*", F.greatest("r.j1", "least").alias("a"), F.least(F.col("r.j2"), most).alias("b"))
    # The key takes the range's own ends: a context that covers only a part of the range has them as well, but for its outermost bytes.
    cut = cut.filter("a <= b").withColumn("key", common(F.col("r.j1"), F.col("r.j2")))
    each = shared(cut, "key").select("ctx", "lefts", "rights", F.explode(F.sequence("a", "b")).alias("j")).withColumn("stretch", common(F.col("j"), F.col("j")))
    alone = shared(each, "stretch").groupBy("ctx").agg(F.collect_set("j").alias("js"))
    known = around.select("ctx", "least", most.alias("most")).join(counts, "ctx").join(alone, "ctx", "left")
    known = known.select("ctx", F.when(F.col("n") > 1, F.sequence("least", "most")).otherwise(F.col("js")).alias("js")).filter("js IS NOT NULL")
    ends = lambda step: F.sort_array(F.filter("js", lambda j: ~F.array_contains("js", j + step)))
    known = durable(known.select("ctx", F.arrays_zip(ends(-1).alias("a"), ends(1).alias("b")).alias("runs")))
    places = held.select(*_MARK, "at", "ctx").join(F.broadcast(known) if known.count() <= BROADCAST // 8 else known, "ctx")
    return places.select(*_MARK, "at", F.explode("runs").alias("r")).select(*_MARK, (F.col("at") - F.col("r.b")).alias("start"), (F.col("at") - F.col("r.a") + LENGTH).alias("end"))


def repeats(docs: DataFrame) -> DataFrame:
    """m1, m2 and ``spans`` (array of start, end) of each text with bytes that suffixes show to repeat."""
    wanted = durable(repeated_anchors(docs))
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    n_texts, n_hashes, n_hot = wanted.agg(F.count("*"), count("hashes"), count("hot")).first()
    parts = int(max(1, n_hashes // RANGE, min(64, n_hashes // 2000)))
    borders = splitters(docs, parts)

    def sort(batches):
        held: dict = {}
        size = 0

        def flush():
            ordered = sorted(held.values(), key=lambda e: (e.right, e.left))
            cut: dict[int, list[Entry]] = {}
            for e in ordered:
                cut.setdefault(bisect_right(borders, e.right[:ANCHOR]), []).append(e)
            for part, run in cut.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in packed(run))], ["part", *_COLUMNS])

        for mark, data, (hashes,) in _fresh(batches, 1):
            for e in entries(data, set(np.asarray(hashes.values).view(np.uint64).tolist()), mark):
                old = held.setdefault((e.right, e.left, e.least), e)
                if old is not e:
                    old.places += e.places
                else:
                    size += len(e.right) + len(e.left) + 300
            if size > 60_000_000:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    def merge(key, table):
        runs = [unpacked(tuple(table.column(c)[i].as_py() for c in _COLUMNS)) for i in range(table.num_rows)]
        rows = np.array(list(spans(runs)), np.int64).reshape(-1, 4)
        return pa.table({c: pa.array(rows[:, k]) for k, c in enumerate((*_MARK, "start", "end"))})

    chosen = _some(_keyed(docs), wanted, n_texts).join(wanted, _MARK)
    runs = chosen.select(*_MARK, "text", "hashes").mapInArrow(sort, RUN_SCHEMA)
    found = [runs.groupBy("part").applyInArrow(merge, "m1 long, m2 long, start long, end long")]
    if n_hot:
        found.append(_hot_spans(chosen.filter(F.size("hot") > 0)))
    return durable(reduce(DataFrame.union, found).distinct().groupBy(*_MARK).agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def removed(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each document."""

    def run(batches):
        for batch in batches:
            texts, found = batch.column(2).cast(pa.binary()), batch.column(3)
            rows = []
            for i in range(batch.num_rows):
                data = texts[i].as_py() or b""
                kept, n_spans, gone, at, end = [], 0, 0, 0, -1
                for s in sorted((x["start"], x["end"]) for x in found[i].as_py() or ()):
                    if s[0] > end:
                        kept.append(data[max(end, 0) : s[0]])
                        n_spans += 1
                    end = max(end, s[1])
                kept.append(data[max(end, 0) :])
                left = b"".join(kept)
                gone = len(data) - len(left)
                rows.append((len(data), gone, n_spans, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(docs)
    n_texts = found.count()
    held = docs.select("doc_id", F.md5("text").alias("digest"), "text", *_marks())
    cut = _some(held, found, n_texts).join(found, _MARK).select("doc_id", "digest", "text", "spans")
    rest = _some(held, found, n_texts, "left_anti").select("doc_id", "digest", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    each = cut.unionByName(rest).mapInArrow(run, "doc_id long, digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # copies of whole texts, counted by digest; the texts themselves don't move
    copies = docs.filter(F.octet_length("text") >= LENGTH).groupBy(F.md5("text").alias("copied")).agg(F.count("*").alias("n")).filter("n > 1")
    whole = F.col("n").isNotNull()
    return each.join(copies, F.col("digest") == F.col("copied"), "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
