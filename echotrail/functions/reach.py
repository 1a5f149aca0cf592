"""Searches in a graph whose edges a task holds as arrays: hops of many targets by bits, and of one source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Edges, or pairs of a node and a target, that are followed at once, and first neighbours asked by a node that lacks few targets.
ROWS, PAIRS, ASKED = 4096, 1 << 20, 8
#: What following one edge for one target costs, in words of a neighbour's bits, and pairs, in PAIRS, that are kept to be followed.
PAIR_COST, KEPT = 64, 8


def _places(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all list entries of the nodes ``of``, one node after the other, and where each one's begin."""
    size = first[of + 1] - first[of]
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first[of] - begin, size), begin


def _cuts(size: np.ndarray, most: int) -> list[slice]:
    """Slices of nodes whose lists have ``most`` entries together, or of one node with more."""
    upto, lo, out = np.cumsum(size), 0, []
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        out.append(slice(lo, hi))
        lo = hi
    return out


class Held:
    """Edges of nodes 0 to n - 1, sorted by their sources; ``alike``: every edge's reverse is one too."""

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray, alike: bool):
        self.n, self.first, self.to = n, self._first(n, source), target
        if alike:
            self.back_first, self.back = self.first, self.to
        else:
            self.back_first, self.back = self._first(n, target), source[np.argsort(target, kind="stable")]

    @staticmethod
    def _first(n: int, ends: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(np.bincount(ends, minlength=n))]

    def hops(self, targets: np.ndarray, reach: int | None = None) -> Iterator[np.ndarray]:
        """For each hop, how many of the sorted, different ``targets`` every node reaches by so many edges and no fewer; ends where nothing is new.

        While few pairs of a node and a target are new, each is followed back
        along the edges into its node; otherwise each node that lacks targets
        takes the bits of its neighbours that had a new one.
        """
        words, total = -(-len(targets) // 64), len(targets)
        seen = np.zeros((self.n, words), dtype=np.uint64)
        pairs = targets.astype(np.int64) * (64 * words) + np.arange(total)
        self._mark(seen, pairs)
        known = np.bincount(targets, minlength=self.n)
        changed, hop = known > 0, 0
        while reach is None or hop < reach:
            hop += 1
            if pairs is not None:
                node = pairs // (64 * words)
                cost = int((self.back_first[node + 1] - self.back_first[node]).sum()) * PAIR_COST
            before = None
            if pairs is not None and cost <= len(self.to) * words:
                pairs = self._follow(seen, pairs)
            else:
                before, pairs = seen, None
                seen = self._heard(seen, known, changed, total)
            if pairs is None or len(pairs) > PAIRS:
                now = np.concatenate([np.bitwise_count(seen[x : x + ROWS]).sum(axis=1, dtype=np.int64) for x in range(0, self.n, ROWS)])
                new, known = now - known, now
                if before is not None and new.sum() <= PAIRS:
                    pairs = self._new_pairs(before, seen, np.flatnonzero(new))
            else:
                new = np.bincount(pairs // (64 * words), minlength=self.n)
                known = known + new
            changed = new > 0
            if not changed.any():
                return
            yield new

    @staticmethod
    def _mark(seen: np.ndarray, pairs: np.ndarray) -> None:
        """Sets the bits of sorted pairs, a word at a time."""
        word = pairs >> 6
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        if len(starts):
            seen.reshape(-1)[word[starts]] |= np.bitwise_or.reduceat(np.uint64(1) << (pairs & 63).astype(np.uint64), starts)

    def _follow(self, seen: np.ndarray, pairs: np.ndarray) -> np.ndarray | None:
        """Marks the pairs that edges into the nodes of new ones lead to, and gives them unless they are too many."""
        width, flat, out, n = 64 * seen.shape[1], seen.reshape(-1), [pairs[:0]], 0
        node = pairs // width
        for cut in _cuts(self.back_first[node + 1] - self.back_first[node], PAIRS):
            at, _ = _places(self.back_first, node[cut])
            size = self.back_first[node[cut] + 1] - self.back_first[node[cut]]
            into = self.back[at].astype(np.int64) * width + np.repeat(pairs[cut] % width, size)
            fresh = (flat[into >> 6] >> (into & 63).astype(np.uint64)) & np.uint64(1) == 0
            into = np.unique(into[fresh])
            self._mark(seen, into)
            n += len(into)
            out = [*out, into] if n <= KEPT * PAIRS else []
        return np.concatenate(out) if out else None

    def _heard(self, seen: np.ndarray, known: np.ndarray, changed: np.ndarray, total: int) -> np.ndarray:
        """Each node's bits and its neighbours'."""
        after, size, words = seen.copy(), np.diff(self.first), seen.shape[1]
        lacking = np.flatnonzero((known < total) & (size > 0))
        everything = np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
        if total % 64:
            everything[-1] = (np.uint64(1) << np.uint64(total % 64)) - np.uint64(1)
        asked = ASKED if known.sum() > 0.5 * total * self.n else 0
        buffer = np.empty((ROWS, words), dtype=np.uint64)
        for cut in _cuts(size[lacking], 64 * ROWS):
            rows = lacking[cut]
            for j in range(asked):
                rows = rows[size[rows] > j]
                for x in range(0, len(rows), ROWS):
                    after[rows[x : x + ROWS]] |= seen[self.to[self.first[rows[x : x + ROWS]] + j]]
                rows = rows[np.concatenate([(after[rows[x : x + ROWS]] != everything).any(axis=1) for x in range(0, len(rows), ROWS)] or [np.zeros(0, dtype=bool)])]
            if not len(rows):
                continue
            at, begin = _places(self.first, rows)
            at = self.to[at]
            news = changed[at]
            heard, at = np.add.reduceat(news, begin, dtype=np.int64), at[news]
            rows, heard = rows[heard > 0], heard[heard > 0]
            start = np.cumsum(heard) - heard
            for own in _cuts(heard, ROWS):
                begin, x = start[own] - start[own.start], int(start[own.start])
                near = at[x : x + int(heard[own].sum())]
                if len(near) > ROWS:  # one node, piece by piece
                    for x in range(0, len(near), ROWS):
                        after[rows[own]] |= np.bitwise_or.reduce(seen[near[x : x + ROWS]], axis=0)
                else:
                    np.take(seen, near, axis=0, out=buffer[: len(near)], mode="clip")
                    after[rows[own]] |= np.bitwise_or.reduceat(buffer[: len(near)], begin, axis=0)
        return after

    @staticmethod
    def _new_pairs(before: np.ndarray, after: np.ndarray, rows: np.ndarray) -> np.ndarray:
        width, out = 64 * after.shape[1], [np.zeros(0, dtype=np.int64)]
        for x in range(0, len(rows), ROWS):
            bits = np.unpackbits((after[rows[x : x + ROWS]] & ~before[rows[x : x + ROWS]]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
            row, place = np.nonzero(bits)
            out.append(rows[x + row] * width + place)
        return np.concatenate(out)

    def depths(self, source: int) -> np.ndarray:
        """Each node's hops from ``source``, -1 where there is no path."""
        far, front, hop = np.full(self.n, -1, dtype=np.int32), np.array([source]), 0
        far[source] = 0
        while len(front):
            hop += 1
            to = self.to[_places(self.first, front)[0]]
            to = to[far[to] < 0]
            far[to] = hop
            front = np.unique(to)
        return far
