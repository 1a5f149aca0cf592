"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

The segmentation is BPE's: of all adjacent pairs whose join is a piece, the
best-scored (the leftmost of equals) is merged, until none is left. With
dropout, a candidate merge is skipped for good if a keyed hash of it (seed,
document, the unit's place in it and text, the candidate's place) falls under
the rate, so a seed always gives the same segmentation, and other seeds,
documents or places give others. A unit is a run of spaces and what follows up
to the next space; no piece crosses units.

Distinct units are segmented without dropout once and remembered with the
merges made. Where none of these is skipped at an occurrence, its segmentation
is that one, as a skipped candidate that would not have been merged changes
nothing. The other occurrences of a batch are segmented one by one, all at
once: each round finds every unit's best candidate and merges it. Very long
units go through a heap.

A space stands before every text that isn't empty; decoding takes it away.
Characters without a piece, and U+2581 (which pieces use for the space), are
spelled in byte pieces, so every text decodes to itself. A null or empty text
has no pieces. A text that is no valid UTF-8 is encoded with U+FFFD in place of
the wrong bytes and isn't lossless. Of equally good merges the leftmost is
made. Rows that repeat a doc_id are keyed alike, so equal texts among them have
equal pieces; rows without a doc_id share a key of their own. An empty table
gives an empty one.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import map_batches, slices, table, texts_of
from .tokens import decoded

U = np.uint64
RATE, SEED = 0.1, 7
#: Segmented units a process remembers at most.
REMEMBERED = 400_000
#: Symbols from which on a unit goes through a heap.
LONG = 128
_META = 0x2581
_NONE = np.int64(2**62)
_MASK = 2**64 - 1
_ODDS = [int(K.ODD[i]) for i in (2, 3, 4)]


def model_file() -> str:
    """The default model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces: characters' ids, merges, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.id_of = {t: i for i, t in enumerate(text) if plain[i]}
        self.bytes_of = [t.replace(chr(_META), " ").encode() if plain[i] else b"" for i, t in enumerate(text)]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(text[i][3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for t, i in self.id_of.items():
            if len(t) == 1:
                self.char_ids[ord(t)] = i
        self.char_ids[ord(" ")] = self.char_ids[_META]
        self.char_ids[_META] = -1
        order = np.lexsort((np.arange(n), -np.array([model.get_score(i) for i in range(n)])))
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        keys, values = [], []
        for t, i in self.id_of.items():
            for k in range(1, len(t)):
                a, b = self.id_of.get(t[:k]), self.id_of.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self._fill(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the merges."""
        self.bits = max(16, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    @cached_property
    def merges(self) -> dict[int, int]:
        """The merges for one pair at a time."""
        own = self.keys >= 0
        return dict(zip(self.keys[own].tolist(), self.values[own].tolist(), strict=True))

    @cached_property
    def rank_list(self) -> list[int]:
        return self.rank.tolist()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair joins to, or -1."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[at]
        slot = self._slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held >= 0)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _limit(rate: float) -> int:
    return min(int(rate * 2**64), 2**64 - 1) if rate > 0 else 0


def skipped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate of joining [begin, middle) and [middle, end) of a unit is dropped."""
    if rate <= 0:
        return np.zeros(len(key), dtype=bool)
    with np.errstate(over="ignore"):
        h = K.mix(key + begin.astype(np.uint64) * K.ODD[2] + middle.astype(np.uint64) * K.ODD[3] + end.astype(np.uint64) * K.ODD[4])
    return h < U(_limit(rate))


def _dropped(key: int, begin: int, middle: int, end: int, limit: int) -> bool:
    """``skipped`` for one candidate, on plain integers."""
    x = (key + begin * _ODDS[0] + middle * _ODDS[1] + end * _ODDS[2]) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31) < limit


def segment_by_heap(p: Pieces, symbols: np.ndarray, key: int, rate: float) -> tuple[list[int], list[int]]:
    """One unit's segmentation with an agenda; the pieces (-1 without one) and their first symbols."""
    n = len(symbols)
    ids, end, before, behind = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    rank, merges, limit = p.rank_list, p.merges, _limit(rate)
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = behind[i]
        m = merges.get(ids[i] << 32 | ids[j]) if j < n and ids[i] >= 0 and ids[j] >= 0 else None
        if m is not None and not (limit and _dropped(key, i, end[i], end[j], limit)):
            heapq.heappush(agenda, (rank[m], i, end[i], end[j], m))

    for i in range(n - 1):
        offer(i)
    dead = [False] * n
    while agenda:
        _, i, middle, stop, m = heapq.heappop(agenda)
        if dead[i] or end[i] != middle or behind[i] >= n or end[behind[i]] != stop:
            continue
        j = behind[i]
        ids[i], end[i], dead[j] = m, stop, True
        behind[i] = behind[j]
        if behind[i] < n:
            before[behind[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ids[i] for i in range(n) if not dead[i]], [i for i in range(n) if not dead[i]]


def segment(p: Pieces, symbols: np.ndarray, first: np.ndarray, key: np.ndarray, rate: float, made: list | None = None) -> np.ndarray:
    """The piece at each symbol's place that begins one (-1: its bytes), -2 elsewhere.

    ``first`` are the units' offsets in ``symbols``, ``key`` their hash keys.
    The merges of each round (units, and begin, middle and end in a byte each)
    are put into ``made``, but for units that go through the heap.
    """
    out = np.full(len(symbols), -2, dtype=np.int64)
    size = np.diff(first)
    unit = np.repeat(np.arange(len(size)), size)
    for u in np.flatnonzero(size > LONG).tolist():
        got, at = segment_by_heap(p, symbols[first[u] : first[u + 1]], int(key[u]), rate)
        out[first[u] + np.array(at)] = got
    keep = (size <= LONG)[unit]
    pos, unit = np.flatnonzero(keep), unit[keep]
    ids, end = symbols[pos].astype(np.int64), pos + 1

    def candidates(at: np.ndarray) -> np.ndarray:
        """Order keys (rank, place) of joining each symbol with the next; the joined piece is found again by rank."""
        best = np.full(len(at), _NONE)
        ok = at + 1 < len(pos)
        ok[ok] = unit[at[ok]] == unit[at[ok] + 1]
        i = at[ok]
        m = p.merged(ids[i], ids[i + 1])
        good = m >= 0
        i, m = i[good], m[good]
        base = first[unit[i]]
        drop = skipped(key[unit[i]], pos[i] - base, end[i] - base, end[i + 1] - base, rate)
        value = np.where(drop, _NONE, p.rank[m] << 24 | (pos[i] - base))
        where = np.flatnonzero(ok)[good]
        best[where] = value
        return best

    by_rank = np.argsort(p.rank)
    best = candidates(np.arange(len(pos)))
    while len(pos):
        lead = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        least = np.minimum.reduceat(best, lead)
        count = np.diff(np.append(lead, len(pos)))
        if (least == _NONE).any():  # finished units leave
            done = np.repeat(least == _NONE, count)
            out[pos[done]] = ids[done]
            pos, unit, ids, end, best = (x[~done] for x in (pos, unit, ids, end, best))
            if not len(pos):
                break
            lead = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            count, least = np.diff(np.append(lead, len(pos))), least[least != _NONE]
        win = np.flatnonzero(best == np.repeat(least, count))
        if made is not None:
            base = first[unit[win]]
            made.append((unit[win], (pos[win] - base) << 16 | (end[win] - base) << 8 | (end[win + 1] - base)))
        ids[win] = by_rank[best[win] >> 24]
        end[win] = end[win + 1]
        stay = np.ones(len(pos), dtype=bool)
        stay[win + 1] = False
        win = win - np.arange(len(win))
        pos, unit, ids, end, best = (x[stay] for x in (pos, unit, ids, end, best))
        again = np.unique(np.concatenate((win, win[win > 0] - 1)))
        best[again] = candidates(again)
    return out


def encode_batch(
    p: Pieces, texts: list[str], docs: np.ndarray, seed: int = SEED, rate: float = RATE, memory: Memory | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, and each text's offsets in them; ``docs`` are the documents' hash keys."""
    joined = "".join([f" {t}" if t else "" for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    length = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    ends = np.cumsum(length)
    if not len(points):
        return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    space = points == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[(ends - length)[length > 0]] = True
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(points)))
    # a hash of each unit's characters; blocks of units keep the power tables small
    value = K.mix(points.astype(np.uint64) + U(1))
    total = np.empty(len(start), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            origin = int(start[lo])
            hi = max(lo + 1, int(np.searchsorted(start, origin + (1 << 20))) - 1)
            stop = int(start[hi]) if hi < len(start) else len(points)
            up, down = K._power_tables(stop - origin + 1)
            sums = np.zeros(stop - origin + 1, dtype=np.uint64)
            np.cumsum(value[origin:stop] * up[: stop - origin], out=sums[1:])
            s = start[lo:hi] - origin
            total[lo:hi] = (sums[s + size[lo:hi]] - sums[s]) * down[s]
            lo = hi
        doc = np.searchsorted(ends, start, side="right")
        own = K.mix(total + size.astype(np.uint64))
        place = (start - (ends - length)[doc]).astype(np.uint64)
        key = K.mix(own + docs[doc].astype(np.uint64) * K.ODD[5] + U(seed) * K.ODD[6] + K.mix(place + U(1)))
    unique, at, which = np.unique(own, return_index=True, return_inverse=True)
    memory = memory if memory is not None else Memory()
    found, known = memory.find(unique)
    fresh = ~known
    plain = _remembered(p, points, start[at[fresh]], size[at[fresh]])
    begins, lengths, firsts, counts = (np.empty(len(unique), dtype=np.int64) for _ in range(4))
    begins[fresh], lengths[fresh], firsts[fresh], counts[fresh] = plain[1], plain[2], plain[4], plain[5]
    begins[known], lengths[known] = memory.begin[found[known]] + len(plain[0]), memory.length[found[known]]
    firsts[known], counts[known] = memory.first[found[known]] + len(plain[3]), memory.count[found[known]]
    ids, merges = np.concatenate((plain[0], memory.flat)), np.concatenate((plain[3], memory.merges))
    memory.add(unique[fresh], *plain)
    begins, lengths = begins[which], lengths[which]
    if rate > 0:
        differs = _any_skipped(merges, firsts[which], counts[which], key, rate) | (size > LONG)
        flat, begins[differs], lengths[differs] = _segmented(p, points, start[differs], size[differs], key[differs], rate)
        begins[differs] += len(ids)
        ids = np.concatenate((ids, flat))
    upto = np.concatenate(([0], np.cumsum(lengths)))
    out = ids[np.repeat(begins - upto[:-1], lengths) + np.arange(upto[-1])]
    offsets = upto[np.searchsorted(start, np.concatenate(([0], ends)))]
    return out, offsets


def _any_skipped(merges: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """Whether any of the merges that each unit's segmentation without dropout makes is skipped."""
    out = np.zeros(len(key), dtype=bool)
    upto = np.concatenate(([0], np.cumsum(count)))
    lo = 0
    while lo < len(key):  # blocks keep the expanded merges small
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 20), side="right")) - 1)
        own = count[lo:hi]
        unit = np.repeat(np.arange(lo, hi), own)
        m = merges[np.arange(upto[lo], upto[hi]) + np.repeat(first[lo:hi] - upto[lo:hi], own)]
        out[unit[skipped(key[unit], m >> 16, m >> 8 & 255, m & 255, rate)]] = True
        lo = hi
    return out


def _remembered(p: Pieces, points: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_segmented`` without dropout, the merges made, and where each unit's begin and how many they are."""
    made: list[tuple[np.ndarray, np.ndarray]] = []
    flat, begin, length = _segmented(p, points, start, n, np.zeros(len(n), dtype=np.uint64), 0.0, made)
    unit = np.concatenate([u for u, _ in made] or [np.empty(0, dtype=np.int64)])
    merges = np.concatenate([m for _, m in made] or [np.empty(0, dtype=np.int64)])[np.argsort(unit, kind="stable")]
    count = np.bincount(unit, minlength=len(n)).astype(np.int64)
    return flat, begin, length, merges, np.cumsum(count) - count, count


def _segmented(
    p: Pieces, points: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, rate: float, made: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of some units one after another, and where each unit's begin and how many they are."""
    first = np.concatenate(([0], np.cumsum(n)))
    own = points[np.repeat(start - first[:-1], n) + np.arange(first[-1])]
    found = segment(p, p.char_ids[own], first, key, rate, made)
    head = np.flatnonzero(found > -2)
    ids, source = found[head], own[head]
    # characters without a piece become their UTF-8 bytes
    width = np.ones(len(ids), dtype=np.int64)
    spelled = np.flatnonzero(ids == -1)
    flat = ids
    if len(spelled):
        data = [chr(c).encode("utf-8", "surrogatepass") for c in source[spelled].tolist()]
        width[spelled] = [len(d) for d in data]
        place = np.cumsum(width) - width
        flat = np.repeat(ids, width)
        for i, d in zip(place[spelled].tolist(), data, strict=True):
            flat[i : i + len(d)] = p.byte_ids[list(d)]
    unit = np.repeat(np.arange(len(n)), n)[head]
    length = np.bincount(unit, weights=width, minlength=len(n)).astype(np.int64)
    return flat, np.cumsum(length) - length, length


class Memory:
    """Segmentations without dropout of units already seen, and their merges, by the units' hash; a bounded, growing-only table.

    It only saves time: a unit's segmentation without dropout is a function of its text.
    """

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.keys, self.flat = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.merges, self.begin, self.length, self.first, self.count = (np.empty(0, dtype=np.int64) for _ in range(5))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted ``keys`` are in the table, and whether they are."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def add(self, keys: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, merges: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        if not len(keys) or len(self.keys) + len(keys) > self.most:
            return
        joined = np.concatenate((self.keys, keys))
        order = np.argsort(joined, kind="stable")
        self.keys = joined[order]
        self.begin = np.concatenate((self.begin, begin + len(self.flat)))[order]
        self.length = np.concatenate((self.length, length))[order]
        self.first = np.concatenate((self.first, first + len(self.merges)))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.flat, self.merges = np.concatenate((self.flat, flat)), np.concatenate((self.merges, merges))


@lru_cache(maxsize=2)
def memory_of(path: str) -> Memory:
    """One memory to a process and model."""
    return Memory()


def decode(p: Pieces, ids: list[int]) -> str:
    """The text of some ids."""
    data = b"".join([p.bytes_of[i] for i in ids])
    return data[1:].decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None, seed: int = SEED, rate: float = RATE, keep_ids: bool = True) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: its variant (the hash of doc_id and seed that keys its dropout), ids (or null), their digest, and whether they decode to the text."""
    path = path or model_file()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces_of(path)
        raw = texts_of(batch.column(1))
        texts = [decoded(t) for t in raw]
        ids = batch.column(0).to_pylist()
        variant = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{d}") >> 1 for d in ids], dtype=np.int64)
        rows: list = [None] * len(texts)
        for lo, hi in slices(raw):
            flat, offsets = encode_batch(p, texts[lo:hi], variant[lo:hi], seed, rate, memory_of(path))
            flat = flat.astype("<u4")
            for k, i in enumerate(range(lo, hi)):
                own = flat[offsets[k] : offsets[k + 1]]
                back = decode(p, own.tolist())
                rows[i] = (len(own), zlib.crc32(own.tobytes()), back == texts[i] and ("\ufffd" not in back or back.encode() == raw[i]), len(back), own.tolist() if keep_ids else None)
        n, crc, lossless, chars, kept = zip(*rows, strict=True)
        return pa.record_batch(
            [batch.column(0).cast(pa.int64()), pa.array(variant), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(lossless, pa.bool_()), pa.array(chars, pa.int64()), pa.array(kept, pa.list_(pa.int32()))],
            names=["doc_id", "variant", "n_pieces", "ids_crc32", "lossless", "decoded_chars", "ids"],
        )

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, variant long, n_pieces long, ids_crc32 long, lossless boolean, decoded_chars long, ids array<int>")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
