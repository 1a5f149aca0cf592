"""NumPy kernels over UTF-8 bytes: words, hashes, sketches, sliding minima.

All work on one slice of texts at a time (about 1 MB), without a Python loop
over bytes or words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that separate words: space and 9 to 13.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))

_rng = np.random.Generator(np.random.PCG64(20240117))
#: A random 64-bit value per byte, and odd multipliers.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
BASE = ODD[0]
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (mod 2**64), grown on demand."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


class Words:
    """Words of some texts: starts and ends in ``data``, hashes, and offsets.

    ``first[d]:first[d + 1]`` are the words of text d. ``data`` holds the
    texts with one space behind each, text d from ``begin[d]``.
    """

    def __init__(self, texts: list[bytes], hashes: bool = True, lower: bool = False):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.translate(LOWER)
        self.data = data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        sep = SEPARATOR[data]
        turn = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            turn = np.concatenate(([0], turn))
        self.start, self.end = turn[0::2], turn[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        if hashes:
            self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        while lo < len(out):  # blocks of whole words, so that the power tables stay small
            origin = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, origin + (1 << 20))))
            s, e = self.start[lo:hi] - origin, self.end[lo:hi] - origin
            n = int(e[-1])
            up, down = _power_tables(n + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(BYTE[self.data[origin : origin + n]] * up[:n], out=total[1:])
                out[lo:hi] = (total[e] - total[s]) * down[s]
            lo = hi
        return mix(out)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's offsets.

    A text with fewer words than ``width`` has its whole word sequence as one
    shingle; a text without words has none.
    """
    h, first = words.hash, words.first
    with np.errstate(over="ignore"):
        if len(h) >= width:
            run = h[: len(h) - width + 1] * ODD[1]
            for k in range(1, width):
                run = run + h[k : len(h) - width + 1 + k] * ODD[1 + k]
            run = mix(run)
        else:
            run = h[:0]
        parts, sizes = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                own = np.unique(run[a : b - width + 1])
            elif b > a:
                own = mix((h[a:b] * ODD[10 : 10 + b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a))
            else:
                own = h[:0]
            parts.append(own)
            sizes.append(len(own))
    flat = np.concatenate(parts) if parts else h[:0]
    return flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


EMPTY = U(2**64 - 1)


def one_permutation_sketch(flat: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification, a row per text.

    One hash per shingle: its high bits choose the bin, the least value in a
    bin is kept. An empty bin j copies the first full bin of the random
    sequence (j, 1), (j, 2), ...; texts that agree on that bin agree on j.
    Rows of empty sets hold EMPTY everywhere.
    """
    n = len(offsets) - 1
    sketch = np.full(n * bins, EMPTY, dtype=np.uint64)
    if len(flat):
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        at = owner * bins + (((flat >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sketch[at[lead]] = np.minimum(flat[lead], EMPTY - U(1))
    sketch = sketch.reshape(n, bins)
    full = sketch != EMPTY
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 1
    while len(row):
        with np.errstate(over="ignore"):
            probe = (mix(col.astype(np.uint64) * ODD[20] + U(attempt) * ODD[21]) % U(bins)).astype(np.int64)
        found = full[row, probe]
        sketch[row[found], col[found]] = sketch[row[found], probe[found]]
        row, col = row[~found], col[~found]
        attempt += 1
    return sketch


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band of ``rows`` bins; the band's number is part of it."""
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows, rows)
    with np.errstate(over="ignore"):
        out = (parts * ODD[30 : 30 + rows]).sum(axis=2, dtype=np.uint64)
        return mix(out + np.arange(bins // rows, dtype=np.uint64) * ODD[40])


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width``-byte window, by doubling (no power tables)."""
    return _compose(BYTE[data], data, width)


def _compose(one: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        have, size, level, base = None, 0, one, BASE
        step = 1
        left = width
        scale = U(1)
        while left:
            if left & 1:
                if have is None:
                    have = level
                else:
                    n = len(level) - size
                    have = have[:n] + level[size : size + n] * scale
                size += step
                scale = U(pow(int(BASE), size, 2**64))
            left >>= 1
            if left:
                n = len(level) - step
                if n <= 0:
                    return one[:0]
                level = level[:n] + level[step : step + n] * base
                base = base * base
                step *= 2
    return mix(have) if have is not None else one[:0]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level
