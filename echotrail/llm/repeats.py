"""Removal of repeated 100-byte strings, by suffix sorting.

A suffix array of the whole corpus would hold a row per byte. Instead the
windows (the 100-byte strings at every start) are dealt out by content and
each block gets its own suffix array by difference cover:

1. *Anchors.* A window's anchor is the least hash of its 32-byte substrings,
   so equal windows have equal anchors. Consecutive windows with one anchor
   (at one place) form a run; its two outer windows determine the whole run. A corpus has a
   run for about 35 bytes.
2. *Runs by anchor.* Of equal runs all but the earliest are repeats. Copies
   inside one batch are settled before the shuffle, so a passage that a third
   of all documents share sends one row per batch.
3. *Different runs with one anchor* may still share some windows (the edges of
   a passage). Only these go on: the bytes of the earliest of each, dealt out
   by anchor.
4. *Suffix arrays.* Each block of such bytes is suffix-sorted by the
   difference-cover algorithm, neighbours' first 100 bytes are compared, and
   in each class of equal windows all but the earliest are repeats. Only of an
   anchor with very many different runs (the edge of a passage that stands in
   very many documents) the windows are dealt out one by one, by their hash;
   equal ones are reduced to the earliest before the shuffle and again behind
   it. A task settles what it has gathered whenever that has doubled, so
   neither an anchor nor a window is ever held with all its copies.
5. The repeats' starts go back to their documents, where covered bytes are
   cut out.

All steps are exact (64-bit hashes aside); no window is left out. "Earliest"
is the smaller doc_id, then the smaller start. Null and empty texts, and
texts under 100 bytes, lose nothing. Rows that repeat a doc_id are one
document's place in that order: of equal windows at the same place none goes.
A null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import Work, bounded_batches, ids_of, partitions_for, slices, table, text_bytes, texts_of
from .suffix_array import equal_prefix_classes, suffix_array

WIDTH, GRAM = 100, 32
#: Symbols sorted at once, and bytes of packed rows to a partition.
BLOCK, PARTITION = 1 << 20, 16 << 20
#: Shuffle partitions at most.
MOST_PARTITIONS = 20_000
#: Runs gathered before they are packed into rows.
FLUSH = 500_000
#: An anchor with so many different runs is dealt out window by window.
HOT = 20_000
#: An anchor with so many different runs among those gathered by one task is marked as hot before the shuffle.
MARK = 64
#: Runs of a bucket from which on they are settled while it is still read.
COMPACT = 1_000_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(2**63)

#: Kinds of packed rows; texts come behind the rows they need.
RUNS, MARKS, REPEATS, UNSETTLED, HOT_UNSETTLED, STRINGS, WINDOWS, TEXT = range(8)
_PACKED = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("keys", "spans", "docs", "starts", "counts", "data")]
)
_TYPES = {"keys": np.uint64, "spans": np.uint64, "docs": np.int64, "starts": np.int32, "counts": np.int32}


class Runs:
    """Parallel arrays: anchor, span, document, first start, number of windows."""

    def __init__(self, **arrays: np.ndarray):
        self.arrays = arrays

    def __getattr__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def __len__(self) -> int:
        return len(next(iter(self.arrays.values())))

    def take(self, at: np.ndarray) -> Runs:
        return Runs(**{k: v[at] for k, v in self.arrays.items()})

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        return Runs(**{k: np.concatenate([p.arrays[k] for p in parts]) for k in parts[0].arrays})

    @staticmethod
    def unpack(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> Runs:
        return Runs(**{c: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=_TYPES[c]) for c in names})


def _packed(kind: int, runs: Runs, bucket: np.ndarray, data: list[bytes] | None = None) -> list[dict]:
    """A row for each bucket, with the arrays of its runs."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    runs, bucket = runs.take(order), bucket[order]
    lead = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rows = []
    for a, b in zip(lead, [*lead[1:], len(bucket)], strict=True):
        row = {c: np.ascontiguousarray(v[a:b], dtype=_TYPES[c]).tobytes() for c, v in runs.arrays.items()}
        rows.append(row | {"bucket": int(bucket[a]), "kind": kind} | ({"data": b"".join(data[i] for i in order[a:b])} if data else {}))
    return rows


def _batches(rows: list[dict], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``most`` bytes."""
    now, size = [], 0
    for row in rows:
        now.append([row.get(c) for c in _PACKED.names])
        size += sum(len(x) for x in now[-1] if isinstance(x, bytes))
        if size > most:
            yield _batch(now)
            now, size = [], 0
    if now:
        yield _batch(now)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PACKED.names)


def runs_of(texts: list[bytes], ids: np.ndarray) -> Runs:
    """The anchor runs of all windows of some texts, in the texts' order."""
    parts = []
    for lo, hi in slices(texts):
        data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        if len(data) < WIDTH:
            continue
        ends = np.cumsum(np.fromiter(map(len, texts[lo:hi]), dtype=np.int64, count=hi - lo))
        begins = np.concatenate(([0], ends[:-1]))
        grams = K.window_hashes(data, GRAM)
        least = K.sliding_minimum(grams, WIDTH - GRAM + 1)
        whole = K.window_hashes(data, WIDTH)
        inside = np.ones(len(whole), dtype=bool)
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            inside[max(b, e - WIDTH + 1) : e] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        value = least[at]
        # the leftmost least substring is left behind by the next window: a new run even if its copy follows,
        # so that no two windows of a run are equal
        left = grams[at[:-1]] == value[:-1]
        lead = np.flatnonzero(np.concatenate(([True], left | (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1))))
        start, count = at[lead], np.diff(np.append(lead, len(at)))
        doc = np.searchsorted(ends, start, side="right")
        with np.errstate(over="ignore"):
            span = K.mix(whole[start] * K.ODD[50] + whole[start + count - 1] * K.ODD[51] + count.astype(np.uint64))
        parts.append(Runs(keys=least[start], spans=span, docs=ids[lo:hi][doc], starts=start - begins[doc], counts=count))
    if not parts:
        return Runs(keys=np.empty(0, np.uint64), spans=np.empty(0, np.uint64), docs=np.empty(0, np.int64), starts=np.empty(0, np.int64), counts=np.empty(0, np.int64))
    return Runs.join(parts)


def _settle(runs: Runs) -> tuple[Runs, Runs]:
    """The earliest of each kind of equal runs, and the rest."""
    order = np.lexsort((runs.starts, runs.docs, runs.spans, runs.keys))
    runs = runs.take(order)
    same = (runs.spans[1:] == runs.spans[:-1]) & (runs.keys[1:] == runs.keys[:-1])
    # equal runs at one place (a repeated doc_id) are all the earliest
    place = (runs.docs[1:] == runs.docs[:-1]) & (runs.starts[1:] == runs.starts[:-1])
    lead = np.concatenate(([True], ~same)) if len(runs) else np.empty(0, bool)
    first = np.flatnonzero(lead)
    later = ~lead
    for i in np.flatnonzero(same & place) + 1:
        later[i] = later[i - 1]
    return runs.take(first), runs.take(np.flatnonzero(later))


def _per_anchor(runs: Runs) -> np.ndarray:
    """For runs sorted by anchor, how many runs each one's anchor has."""
    if not len(runs):
        return np.empty(0, dtype=np.int64)
    lead = np.concatenate(([True], runs.keys[1:] != runs.keys[:-1]))
    group = np.cumsum(lead) - 1
    return np.bincount(group)[group]


def _places(runs: Runs) -> Runs:
    return Runs(docs=runs.docs, starts=runs.starts, counts=runs.counts)


def document_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), buckets) as Spark has it, so that no numbering of the documents crowds a bucket."""
    up = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    # The primes of xxHash64; 42 is Spark's seed.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + p5) ^ (up(docs.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = up(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % buckets


def _in_runs(docs: np.ndarray, starts: np.ndarray) -> Runs:
    """Single windows as runs of consecutive ones."""
    near = np.lexsort((starts, docs))
    docs, starts = docs[near].astype(np.int64), starts[near].astype(np.int64)
    if not len(docs):
        return Runs(docs=docs, starts=starts, counts=starts)
    lead = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1))))
    last = np.append(lead[1:], len(docs)) - 1
    return Runs(docs=docs[lead], starts=starts[lead], counts=starts[last] - starts[lead] + 1)


class Gathered:
    """Runs kept back until there are ``most`` of them, so that few, large rows are packed."""

    def __init__(self, emit, most: int = FLUSH):
        self.emit, self.most, self.parts, self.size = emit, most, [], 0

    def add(self, *part) -> Iterator[pa.RecordBatch]:
        """``part`` begins with runs."""
        if len(part[0]):
            self.parts.append(part)
            self.size += len(part[0])
            if self.size >= self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            parts, self.parts, self.size = self.parts, [], 0
            yield from _batches(self.emit(*zip(*parts, strict=True)))


def _find_runs(buckets: int):
    def emit(parts: tuple[Runs, ...]) -> list[dict]:
        first, later = _settle(Runs.join(list(parts)))
        rows = _packed(REPEATS, _places(later), document_bucket(later.docs, buckets))
        # a very common anchor's runs are unsettled whatever the rest is; its bucket only learns that it is hot
        many = _per_anchor(first) >= MARK
        over, first = first.take(np.flatnonzero(many)), first.take(np.flatnonzero(~many))
        rows += _packed(HOT_UNSETTLED, Runs(keys=over.keys, **_places(over).arrays), document_bucket(over.docs, buckets))
        marks = np.unique(over.keys)
        rows += _packed(MARKS, Runs(keys=marks), (marks % np.uint64(buckets)).astype(np.int64))
        return rows + _packed(RUNS, first, (first.keys % np.uint64(buckets)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(emit)
        for batch in batches:
            yield from gathered.add(runs_of(texts_of(batch.column(1)), ids_of(batch.column(0))))
        yield from gathered.flush()

    return run


class Bucket:
    """What a task holds of one bucket. ``results`` yields (kind, runs) for what is settled."""

    def __init__(self):
        self.parts: list[Runs] = []
        self.size = self.settled = 0

    def add(self, part: Runs) -> None:
        self.parts.append(part)
        self.size += len(part)

    def joined(self) -> Runs:
        return Runs.join(self.parts)

    def keep(self, runs: Runs) -> None:
        self.parts, self.size = ([runs] if len(runs) else []), len(runs)
        self.settled = self.size

    @property
    def due(self) -> bool:
        return self.size >= COMPACT and self.size >= 2 * self.settled


class RunBucket(Bucket):
    """Runs by anchor, and the anchors marked as hot."""

    names = {RUNS: ("keys", "spans", "docs", "starts", "counts"), MARKS: ("keys",)}

    def __init__(self):
        super().__init__()
        self.marks = np.empty(0, dtype=np.uint64)

    def take(self, kind: int, batch: pa.RecordBatch, i: int) -> None:
        part = Runs.unpack(batch, i, self.names[kind])
        if kind == MARKS:
            self.marks = np.union1d(self.marks, part.keys)
        else:
            self.add(part)

    def results(self, last: bool) -> Iterator[tuple[int, Runs]]:
        if not self.parts:
            return
        first, later = _settle(self.joined())
        yield REPEATS, _places(later)
        many = _per_anchor(first)
        hot = (many >= HOT) | np.isin(first.keys, self.marks)
        self.marks = np.union1d(self.marks, first.keys[hot])
        self.keep(first.take(np.flatnonzero(~hot)))
        for kind, at in ((HOT_UNSETTLED, hot), (UNSETTLED, (many > 1) & ~hot & last)):
            some = first.take(np.flatnonzero(at))
            yield kind, Runs(keys=some.keys, **_places(some).arrays)


class StringBucket(Bucket):
    """Strings of unsettled runs, for the suffix arrays, and the windows of hot anchors by their hashes."""

    def __init__(self):
        super().__init__()
        self.runs: list[Runs] = []
        self.data: list[bytes] = []

    def take(self, kind: int, batch: pa.RecordBatch, i: int) -> None:
        part = Runs.unpack(batch, i, ("keys", "docs", "starts", "counts"))
        if kind == WINDOWS:
            self.add(part)
        else:
            self.runs.append(part)
            self.data.append(batch.column("data")[i].as_py())

    def results(self, last: bool) -> Iterator[tuple[int, Runs]]:
        if self.parts:
            first, later = _settle_windows(self.joined())
            self.keep(first)
            yield REPEATS, _in_runs(later.docs, later.starts)
        if last and self.runs:
            yield REPEATS, repeated_windows(Runs.join(self.runs), np.frombuffer(b"".join(self.data), dtype=np.uint8))


def _settle_windows(windows: Runs) -> tuple[Runs, Runs]:
    """The earliest of each kind of equal windows (keys are their hashes), and the rest."""
    first, later = _settle(Runs(spans=np.zeros(len(windows), dtype=np.uint64), **windows.arrays))
    return tuple(Runs(keys=x.keys, **_places(x).arrays) for x in (first, later))


def _by_bucket(kinds: tuple[int, int], make, buckets: int):
    """Rows of two kinds, gathered bucket by bucket (they come sorted) and settled; other rows pass.

    Only one bucket is held at a time, whatever the partition's size, and of
    it no more than twice what is left after settling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, Gathered] = {}

        def settle(held: Bucket, last: bool) -> Iterator[pa.RecordBatch]:
            for kind, runs in held.results(last):
                if kind not in out:
                    out[kind] = _to_documents(kind, buckets)
                yield from out[kind].add(runs)

        bucket, held = None, None
        for batch in batches:
            kind, where = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            own = np.isin(kind, kinds)
            for i in np.flatnonzero(own).tolist():
                if where[i] != bucket:
                    if held is not None:
                        yield from settle(held, True)
                    bucket, held = where[i], make()
                held.take(int(kind[i]), batch, i)
                if held.due:
                    yield from settle(held, False)
            if not own.all():
                yield batch.filter(pa.array(~own))
        if held is not None:
            yield from settle(held, True)
        for g in out.values():
            yield from g.flush()

    return run


def _to_documents(kind: int, buckets: int) -> Gathered:
    def emit(parts: tuple[Runs, ...]) -> list[dict]:
        runs = Runs.join(list(parts))
        return _packed(kind, runs, document_bucket(runs.docs, buckets))

    return Gathered(emit)


def _with_texts(names: tuple[str, ...], make, carried: str | None = None):
    """Texts with the packed runs of their bucket, which come first.

    ``make()`` gives a task's ``each(ids, texts, lookup)`` and ``flush()``,
    which give record batches; ``lookup(kind, doc)`` gives a document's runs.
    ``each`` gets the column ``carried`` as well, if one is named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, flush = make()
        bucket, parts, runs = None, {}, {}
        for batch in batches:
            buckets, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]) | ((kind[1:] == TEXT) != (kind[:-1] == TEXT)))))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
                if buckets[a] != bucket:
                    bucket, parts, runs = buckets[a], {}, {}
                if kind[a] != TEXT:
                    for i in range(a, b):
                        parts.setdefault(int(kind[i]), []).append(Runs.unpack(batch, i, names))
                    continue
                for k, v in parts.items():
                    joined = Runs.join(v)
                    runs[k] = joined.take(np.lexsort((joined.starts, joined.docs)))
                parts = {}

                def lookup(k: int, doc: int, runs: dict[int, Runs] = runs) -> Runs | None:
                    own = runs.get(k)
                    if own is None:
                        return None
                    lo, hi = np.searchsorted(own.docs, [doc, doc + 1])
                    return own.take(slice(lo, hi)) if hi > lo else None

                some = batch.slice(a, b - a)
                yield from each(some.column("doc_id").to_pylist(), texts_of(some.column("data")), lookup, *([some.column(carried)] if carried else []))
        yield from flush()

    return run


def _cut_strings(buckets: int):
    """The bytes of unsettled runs, dealt by anchor; of a hot anchor's runs the windows, dealt by their hashes."""
    of_key = lambda runs: (runs.keys % np.uint64(buckets)).astype(np.int64)

    def strings(parts: tuple[Runs, ...], data: tuple[list[bytes], ...]) -> list[dict]:
        runs = Runs.join(list(parts))
        return _packed(STRINGS, runs, of_key(runs), [x for d in data for x in d])

    def windows(parts: tuple[Runs, ...]) -> list[dict]:
        first, later = _settle_windows(Runs.join(list(parts)))
        later = _in_runs(later.docs, later.starts)
        return _packed(WINDOWS, first, of_key(first)) + _packed(REPEATS, later, document_bucket(later.docs, buckets))

    def make():
        cold, hot = Gathered(strings, FLUSH // 4), Gathered(windows)  # strings carry their bytes

        def each(ids, texts, lookup):
            for doc, text in zip(ids, texts, strict=True):
                own = lookup(UNSETTLED, doc)
                if own is not None:
                    yield from cold.add(own, [text[s : s + c + WIDTH - 1] for s, c in zip(own.starts.tolist(), own.counts.tolist(), strict=True)])
                own = lookup(HOT_UNSETTLED, doc)
                if own is not None:
                    n = own.counts
                    starts = np.repeat(own.starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    whole = K.window_hashes(np.frombuffer(text, dtype=np.uint8), WIDTH)
                    yield from hot.add(Runs(keys=whole[starts], docs=np.repeat(own.docs, n), starts=starts, counts=np.ones(len(starts), dtype=np.int32)))

        def flush():
            yield from cold.flush()
            yield from hot.flush()

        return each, flush

    return _with_texts(("keys", "docs", "starts", "counts"), make)


def repeated_windows(runs: Runs, data: np.ndarray) -> Runs:
    """Windows of unsettled runs that occur earlier in one of them.

    ``data`` holds the runs' bytes (counts + 99 each), in the runs' order.
    One suffix array is built for each block of whole anchors.
    """
    sizes = runs.counts.astype(np.int64) + WIDTH - 1
    begins = np.cumsum(sizes) - sizes
    order = np.lexsort((runs.starts, runs.docs, runs.keys))
    found = []
    lo = 0
    keys, fill = runs.keys[order], np.cumsum(sizes[order] + 1)
    while lo < len(order):
        base = fill[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(fill, base + BLOCK)))
        if hi < len(order):  # an anchor's runs stay together
            back = int(np.searchsorted(keys, keys[hi]))
            hi = back if back > lo else int(np.searchsorted(keys, keys[hi], side="right"))
        some = order[lo:hi]
        lo = hi
        size, count = sizes[some], runs.counts[some].astype(np.int64)
        place = np.cumsum(size + 1) - (size + 1)
        symbols = np.zeros(int(size.sum()) + len(some), dtype=np.int64)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        symbols[np.repeat(place, size) + offset] = data[np.repeat(begins[some], size) + offset].astype(np.int64) + 2
        symbols[place + size] = 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.full(len(symbols), -1, dtype=np.int64)
        owner[np.repeat(place, count) + nth] = np.repeat(np.arange(len(some)), count)
        suffixes = suffix_array(symbols)
        suffixes = suffixes[owner[suffixes] >= 0]
        group = equal_prefix_classes(symbols.astype(np.uint16), suffixes, WIDTH)
        who = owner[suffixes]
        doc, start = runs.docs[some][who], runs.starts[some][who] + suffixes - place[who]
        near = np.lexsort((start, doc, group))
        group, doc, start = group[near], doc[near], start[near]
        lead = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        first = np.repeat(lead, np.diff(np.append(lead, len(group))))
        later = (doc != doc[first]) | (start != start[first])
        found.append((doc[later], start[later]))
    return _in_runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def covered(runs: Runs | None, length: int) -> list[tuple[int, int]]:
    """The maximal byte ranges that the windows cover; runs are sorted by start."""
    if runs is None:
        return []
    start, end = runs.starts.astype(np.int64), runs.starts.astype(np.int64) + runs.counts + WIDTH - 1
    reach = np.maximum.accumulate(end)
    lead = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    stop = np.append(lead[1:], len(start)) - 1
    return list(zip(start[lead].tolist(), np.minimum(reach[stop], length).tolist(), strict=True))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def find_repeats(spark: SparkSession, docs: DataFrame, schema: str | T.StructType, finish, work: Work | None = None, carry: str | None = None) -> DataFrame:
    """``finish(ids, texts, spans)`` for every row of ``docs(doc_id, text)``.

    spans: for each text, the maximal removed byte ranges. ``finish`` gives a
    record batch of ``schema``. With ``carry``, that column of ``docs`` travels
    with the texts, and ``finish`` gets it as a fourth argument.
    """
    work = work or Work(spark, "repeats")
    bounded_batches(spark)
    row = F.col(carry) if carry else F.lit(None).cast("int")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), row.alias("row"))
    sized = partitions_for(spark, text_bytes(docs, "data"), PARTITION)
    # a task holds one bucket at a time, so a huge corpus may have many buckets to a partition
    parts, buckets = min(sized, MOST_PARTITIONS), 4 * sized
    null = [F.lit(None).cast("binary").alias(c) for c in ("keys", "spans", "docs", "starts", "counts")]
    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.lit(TEXT).alias("kind"), "doc_id", *null, "data", "row")

    runs = docs.select("doc_id", "data").mapInArrow(_find_runs(buckets), _PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    settled = work.save(runs.mapInArrow(_by_bucket((RUNS, MARKS), RunBucket, buckets), _PACKED), "settled")
    work.free_shuffles()
    unsettled = settled.filter(F.col("kind").isin(UNSETTLED, HOT_UNSETTLED))
    strings = unsettled.union(texts.drop("row")).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_cut_strings(buckets), _PACKED)
    strings = strings.repartition(parts, "bucket").sortWithinPartitions("bucket")
    sorted_out = work.save(strings.mapInArrow(_by_bucket((STRINGS, WINDOWS), StringBucket, buckets), _PACKED), "sorted")
    work.free_shuffles()
    repeats = settled.filter(F.col("kind") == REPEATS).union(sorted_out)

    def make():
        def each(ids, texts, lookup, *rest):
            yield finish(ids, texts, [covered(lookup(REPEATS, doc), len(text)) for doc, text in zip(ids, texts, strict=True)], *(rest if carry else ()))

        return each, lambda: iter(())

    both = repeats.withColumn("row", F.lit(None).cast(texts.schema["row"].dataType)).union(texts)
    both = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(_with_texts(("docs", "starts", "counts"), make, "row"), schema)


def _ids(ids: list[int]) -> pa.Array:
    return pa.array([None if x == NO_ID else x for x in ids], pa.int64())


def _digest(ids, texts, spans) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": _ids(ids),
            "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_bytes(x, s)).hexdigest() for x, s in zip(texts, spans, strict=True)], pa.string()),
        }
    )


def _kept(texts: list[bytes], spans: list[list[tuple[int, int]]]) -> list[str]:
    """A cut may fall inside a character; what is left of it goes."""
    return [kept_bytes(x, s).decode("utf-8", "ignore") if s else x.decode("utf-8", "replace") for x, s in zip(texts, spans, strict=True)]


def removed_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and the removed byte ranges as an array of (start, end)."""

    def finish(ids, texts, spans):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch({"doc_id": _ids(ids), "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)})

    return find_repeats(spark, docs, "doc_id long, spans array<struct<start: long, end: long>>", finish)


def kept_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and the text without its repeated parts."""
    return find_repeats(
        spark, docs, "doc_id long, kept_text string", lambda ids, texts, spans: pa.record_batch({"doc_id": _ids(ids), "kept_text": pa.array(_kept(texts, spans), pa.string())})
    )


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)``, the text without its repeated parts.

    A null text stays null if nothing of its document is removed; all other
    columns travel with the text, so rows that repeat a doc_id stay apart.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    held = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null"), others.alias("others")).alias("row"))

    def finish(ids, texts, spans, rows):
        return pa.record_batch([pa.array(_kept(texts, spans), pa.string()), rows], names=["text", "row"])

    found = find_repeats(spark, held, T.StructType([T.StructField("text", T.StringType()), held.schema["row"]]), finish, carry="row")
    text = F.when(~F.col("row.null"), F.col("text")).alias("text")
    return found.select(*[text if c == "text" else F.col("row").getField("others").getField(c).alias(c) for c in docs.columns])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(spark, table(spark, sf_dir, "documents"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest)
