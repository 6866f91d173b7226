"""Byte-pair merging on numpy arrays: a hashed pair table, padded matrices, ragged arrays, and a heap for long rows."""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


class PairTable:
    """(left id, right id) -> (rank, merged id), in an open-addressing table that is probed for whole arrays at once."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        self.rank = np.append(np.asarray(rank, np.int32), NEVER)
        self.merged = np.append(np.asarray(merged, np.int32), np.int32(-1))
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, _EMPTY)
        self._place = np.full(1 << bits, len(keys), np.int32)
        waiting, slot, self._probes = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            self._probes += 1
            free = self._keys[slot] == _EMPTY
            first = np.zeros(len(waiting), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self._keys[slot[put]] = keys[waiting[put]]
            self._place[slot[put]] = waiting[put]
            waiting, slot = waiting[~put], (slot[~put] + 1) & self._mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self._shift).astype(np.int64)

    def find(self, left, right):
        """Position of each pair in ``rank`` and ``merged``; their last entry stands for no such pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        held = self._keys[slot]
        place = np.where(held == keys, self._place[slot], len(self.rank) - 1).astype(np.int32)
        open_ = np.flatnonzero((held != keys) & (held != _EMPTY))
        for _ in range(self._probes):
            if not len(open_):
                break
            slot_o = (slot[open_] + 1) & self._mask
            slot[open_] = slot_o
            held = self._keys[slot_o]
            hit = held == keys[open_]
            place[open_[hit]] = self._place[slot_o[hit]]
            open_ = open_[~hit & (held != _EMPTY)]
        return place


def merge_padded(symbols: np.ndarray, lengths: np.ndarray, table: PairTable):
    """Merge every row of a padded matrix to its end; each round takes every row's leftmost pair of the least rank.

    ``symbols`` is (rows, width) int32, changed in place; returns the lengths that are left.
    """
    rows, width = symbols.shape
    lengths = lengths.astype(np.int64).copy()
    if width < 2 or not rows:
        return lengths
    places = table.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
    none = len(table.rank) - 1
    places[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = none
    ranks = table.rank[places]
    live = np.arange(rows)
    s, p, r = symbols, places, ranks
    while len(live):
        at = r.argmin(axis=1)
        n = np.arange(len(live))
        go = r[n, at] != NEVER
        if not go.all():
            symbols[live[~go]] = s[~go]
            live, s, p, r, at = live[go], s[go], p[go], r[go], at[go]
            if not len(live):
                break
            n = n[: len(live)]
        width = int(lengths[live].max())
        s[n, at] = table.merged[p[n, at]]
        columns = np.arange(s.shape[1] - 1)
        moved = columns[None, :] > at[:, None]
        s[:, :-1] = np.where(moved, s[:, 1:], s[:, :-1])
        if s.shape[1] > 2:
            moved = moved[:, :-1]
            p[:, :-1] = np.where(moved, p[:, 1:], p[:, :-1])
            r[:, :-1] = np.where(moved, r[:, 1:], r[:, :-1])
        p[:, -1], r[:, -1] = none, NEVER
        lengths[live] -= 1
        left = lengths[live]
        for shift in (-1, 0):  # the pairs that hold the merged symbol
            where = at + shift
            here = np.flatnonzero((where >= 0) & (where + 1 < left))
            w = where[here]
            found = table.find(s[here, w], s[here, w + 1])
            p[here, w], r[here, w] = found, table.rank[found]
        gone = np.flatnonzero(at >= left - 1)
        p[gone, at[gone].clip(max=p.shape[1] - 1)] = none
        r[gone, at[gone].clip(max=p.shape[1] - 1)] = NEVER
        if width > 2 and width < s.shape[1]:
            symbols[live, width:] = s[:, width:]
            s, p, r = s[:, :width].copy(), p[:, : width - 1].copy(), r[:, : width - 1].copy()
            symbols = symbols[:, :width]
    return lengths


def merge_ragged(flat: np.ndarray, starts: np.ndarray, table: PairTable):
    """Merge rows held end to end in one array; each round applies every row's leftmost pair of the least rank at once.

    Returns what is left of ``flat`` and of ``starts`` (one more than rows, the last is the total).
    """
    rows = len(starts) - 1
    count = np.diff(starts)
    done_flat, done_row = [], []
    row = np.repeat(np.arange(rows), count)
    while len(flat):
        inner = row[:-1] == row[1:]
        ranks = np.full(len(flat), NEVER, np.int32)
        places = np.full(len(flat), len(table.rank) - 1, np.int32)
        if inner.any():
            at = np.flatnonzero(inner)
            places[at] = table.find(flat[at], flat[at + 1])
            ranks[at] = table.rank[places[at]]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(ranks, heads)
        size = np.diff(np.append(heads, len(flat)))
        over = np.repeat(least == NEVER, size)
        if over.any():
            done_flat.append(flat[over])
            done_row.append(row[over])
            keep = ~over
            flat, row, ranks, places = flat[keep], row[keep], ranks[keep], places[keep]
            if not len(flat):
                break
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(heads, len(flat)))
            least = np.minimum.reduceat(ranks, heads)
        lowest = np.flatnonzero(ranks == np.repeat(least, size))
        first = np.append(True, row[lowest[1:]] != row[lowest[:-1]])
        at = lowest[first]
        flat[at] = table.merged[places[at]]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        flat, row = flat[keep], row[keep]
    if not done_flat:
        return flat, starts
    row = np.concatenate(done_row)
    order = np.argsort(row, kind="stable")
    left = np.bincount(row, minlength=rows)
    return np.concatenate(done_flat)[order], np.append(0, np.cumsum(left))


def merge_long(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same result for one long row, by a heap of pairs over a linked list: n log n where the arrays take n squared."""
    n = len(symbols)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(p[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i] = pairs[a, b][1]
        alive[j], after[i] = False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (p := pairs.get((symbols[k], symbols[after[k]]))):
                heapq.heappush(heap, (p[0], k, symbols[k], symbols[after[k]]))
    return [s for s, a in zip(symbols, alive, strict=True) if a]
