"""Rank-synchronous merging: many symbol sequences as ragged arrays, one merge of each in a round.

A table of pairs says which two adjacent symbols may merge, with what rank and into which symbol.
In a round each sequence merges the leftmost of its lowest-ranked pairs; a sequence without a
pair is finished and leaves the arrays. This order is that of the usual priority queue, so the
symbols that survive are those of the tokenizer.

Sequences over LONG symbols go by a heap each, which takes n log n steps instead of n rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np

NONE = np.int64(1) << 40
LONG = 200


class Pairs:
    """Pairs of symbols: sorted keys left * size + right, with ranks and results."""

    def __init__(self, symbols: Mapping, ranks: Mapping):
        """symbols: id by string (bytes or text) of everything a sequence may hold; ranks: those that a merge may make."""
        self.size = len(symbols) + 1
        found = []
        for s, rank in ranks.items():
            made = symbols[s]
            for i in range(1, len(s)):
                a, b = symbols.get(s[:i]), symbols.get(s[i:])
                if a is not None and b is not None:
                    found.append((a * self.size + b, rank, made))
        table = np.array(sorted(found) or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = (np.ascontiguousarray(x) for x in table.T)
        self.by_key = None

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE: no such pair) and merged symbols."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable") if len(keys) > 5000 else None  # sorted keys hit the cache
        at = np.empty(len(keys), np.int64)
        if order is None:
            at = np.searchsorted(self.keys, keys)
        else:
            at[order] = np.searchsorted(self.keys, keys[order])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One sequence, by a heap of its pairs."""
        if self.by_key is None:
            self.by_key = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        n, size = len(symbols), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (p := self.by_key.get(symbols[i] * size + symbols[j])):
                heapq.heappush(heap, (p[0], i, symbols[i], symbols[j], j, p[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, j, made = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and symbols[i] == a and symbols[j] == b):
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]


def merge(pairs: Pairs, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The surviving symbols of each sequence, behind each other, and how many there are of each."""
    n = len(lengths)
    symbols, lengths = symbols.astype(np.int64), lengths.astype(np.int64)
    row = np.repeat(np.arange(n), lengths)
    done_symbols, done_rows = [], []
    for r in np.flatnonzero(lengths > LONG):
        a = int(lengths[:r].sum())
        out = pairs.merge_long(symbols[a : a + lengths[r]].tolist())
        done_symbols.append(np.array(out, np.int64))
        done_rows.append(np.full(len(out), r))
    if done_rows:
        short = lengths[row] <= LONG
        symbols, row = symbols[short], row[short]
    rank, made = _ranks(pairs, symbols, row)
    while len(symbols):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(rank, first)
        per = np.repeat(best, np.diff(np.r_[first, len(row)]))
        over = per == NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_rows.append(row[over])
            going = ~over
            symbols, row, rank, made, per = symbols[going], row[going], rank[going], made[going], per[going]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == per)
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # the leftmost of each sequence
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, row, rank, made = symbols[keep], row[keep], rank[keep], made[keep]
        at = moved[at]
        again = np.unique(np.concatenate([at, at[at > 0] - 1]))
        last = again == len(symbols) - 1
        rank[again[last]] = NONE
        again = again[~last]
        same = row[again] == row[again + 1]
        rank[again[~same]] = NONE
        again = again[same]
        rank[again], made[again] = pairs.look(symbols[again], symbols[again + 1])
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    rows, out = np.concatenate(done_rows), np.concatenate(done_symbols)
    order = np.argsort(rows, kind="stable")
    return out[order], np.bincount(rows, minlength=n)


def _ranks(pairs: Pairs, symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
    at = np.flatnonzero(row[1:] == row[:-1])
    rank[at], made[at] = pairs.look(symbols[at], symbols[at + 1])
    return rank, made
