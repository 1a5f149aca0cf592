"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, with corpus-wide link counts.

Both tokenizers spell the same bytes (a space and the text). The transducer
reads a token of whichever side lags. Its state is the side that leads and the
bytes of it that are still unmatched; a transition depends on these bytes and
the next token alone and is remembered. The token read overlaps the leading
token: that is a link. If the unmatched bytes are used up exactly, both sides
end at the same byte and a group closes; if the token reaches further, its
side leads from then on; if the bytes disagree, the text has no alignment.

A text is cut at spaces behind anything but white space. No token of either
side reaches over a cut (the vocabulary is searched for such tokens; if there
are any, texts are not cut), so a group closes there, and the groups and links
of a cut piece are remembered by the process.

Counting: documents stay in blocks of about BLOCK bytes of text. A block keeps
its distinct pairs once, with the number of its documents that hold each; a
document keeps places in its block's list. So the corpus-wide counts come from
one row a block and pair, and each block gets back the counts of its own pairs
only, whatever the size of the corpus's list. No pair meets in one task other
than as partial sums.

A text that is null or empty, holds U+2581, or whose pieces spell other bytes
has no tokens: zeros and no groups, and its pairs count nowhere. A text that
isn't valid UTF-8 is taken with U+FFFD in place of the wrong bytes. Texts of
any length are whole; one beyond BLOCK bytes is a block of its own. Every row
is a document, with a repeated doc_id or none too. Of pairs with equally high
counts all are best. An empty table gives an empty one, and other columns are
not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .backtrack import codec, cut
from .common import Work, bounded_batches, slices, table, texts_of
from .pieces import model_file
from .tokens import decoded, vocabulary

#: Bytes of text in a block of documents.
BLOCK = 8 << 20
#: Pieces that a process remembers, the characters of the longest, and the transitions it remembers.
REMEMBERED, LONGEST, TRANSITIONS = 250_000, 64, 1_000_000
_META = "▁"


class Transducer:
    """States are numbers; 0 is the empty residual, the others stand for a leading side (0: A, 1: B) and its unmatched bytes."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.spelled = bytes_a, bytes_b
        self._forget()

    def _forget(self) -> None:
        self.states, self.number, self.moves = [(0, b"")], {(0, b""): 0}, {}

    def move(self, state: int, token: int) -> int:
        """The state after the lagging side's next token (A's, where neither leads), or -1 where the bytes disagree."""
        key = state << 32 | token
        found = self.moves.get(key)
        if found is None:
            leads, residual = self.states[state]
            side = 0 if not state else 1 - leads
            own = self.spelled[side][token]
            if not residual:
                after = (0, own)
            elif residual.startswith(own):
                after = (leads, residual[len(own) :])
            elif own.startswith(residual):
                after = (side, own[len(residual) :])
            else:
                after = None
            found = -1
            if after is not None:
                found = 0 if not after[1] else self.number.setdefault(after, len(self.states))
                if found == len(self.states):
                    self.states.append(after)
            self.moves[key] = found
        return found

    def run(self, a: list[int], b: list[int]) -> tuple[list[list[list[int]]], list[int]] | None:
        """Groups (A's tokens, B's tokens) and links (A's id times B's size, plus B's id); None where the bytes differ."""
        if len(self.moves) > TRANSITIONS:
            self._forget()
        groups, links, i, j, size = [], [], 0, 0, len(self.spelled[1])
        known, move, states, n_a, n_b = self.moves.get, self.move, self.states, len(a), len(b)
        while i < n_a:
            leading = a[i]
            i += 1
            own_a, own_b, leads = [leading], [], 0
            state = known(leading)  # from state 0 the key is the token
            if state is None:
                state = move(0, leading)
            while state > 0:
                if leads:
                    if i == n_a:
                        return None
                    token = a[i]
                    i += 1
                    own_a.append(token)
                    links.append(token * size + leading)
                else:
                    if j == n_b:
                        return None
                    token = b[j]
                    j += 1
                    own_b.append(token)
                    links.append(leading * size + token)
                state, before = known(state << 32 | token), state
                if state is None:
                    state = move(before, token)
                if state > 0 and states[state][0] != leads:
                    leading, leads = token, 1 - leads
            if state < 0:
                return None
            groups.append([own_a, own_b])
        return (groups, links) if j == n_b else None


class Aligner:
    """Aligned pieces of text under a byte-level BPE vocabulary (A) and a SentencePiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.codec, self.model = codec(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.model.get_piece_size()
        text = [self.model.id_to_piece(i) for i in range(n)]
        spelled = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(_META, " ").encode() for i, t in enumerate(text)]
        self.size_b, self.space = n, [self.model.piece_to_id(_META)]
        self.cuts = not any(_META in t.lstrip(_META) for t in text)
        self.shown = [str(i) for i in range(max(n, len(self.codec.bytes_of)))]
        self.transducer, self.memory = Transducer(self.codec.bytes_of, spelled), {}

    def _learn(self, pieces: list[str]) -> list[str]:
        """Align the pieces that aren't remembered; gives the long ones, to be forgotten."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.memory]
        ids_a, shown = self.codec.packed_pieces(new), self.shown
        for p, b in zip(new, self.model.encode(new, num_threads=1), strict=True):
            a, b = array("I", ids_a[p]).tolist(), b or self.space
            found = self.transducer.run(a, b)
            if found is not None:
                groups, links = found
                text = ";".join([",".join([shown[i] for i in x]) + "|" + ",".join([shown[i] for i in y]) for x, y in groups])
                found = len(a), len(b), len(groups), array("q", links).tobytes(), text
            self.memory[p] = found
        self.codec.forget_long()
        return [p for p in new if len(p) > LONGEST]

    def align(self, texts: list[str]) -> list[tuple[int, int, int, np.ndarray, str] | None]:
        """Of each text the numbers of A's and B's tokens and of groups, the links (A's id times B's size, plus B's id), and the groups as text."""
        cuts = [(cut(t) if self.cuts else [t]) if t and _META not in t else [] for t in texts]
        gc.disable()  # thousands of short lists, none in a cycle: collecting on the way would only search the memory
        try:
            long, out = self._learn([p for c in cuts for p in c]), []
        finally:
            gc.enable()
        for pieces in cuts:
            rows = list(map(self.memory.__getitem__, pieces))
            if not rows or None in rows:
                out.append(None)
                continue
            links = np.frombuffer(b"".join([r[3] for r in rows]), dtype=np.int64)
            out.append((*[sum(map(itemgetter(k), rows)) for k in range(3)], links, ";".join([r[4] for r in rows])))
        for p in long:
            self.memory.pop(p, None)
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "place array<int>, times array<int>, pair array<long>, docs array<int>"
)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else [], kind))


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """A block's documents, then its list of pairs as a row without document columns."""
    found = [np.unique(r[5], return_counts=True) for r in rows]
    pairs, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    docs = np.bincount(place, minlength=len(pairs))
    ends = np.cumsum([len(f[0]) for f in found])[:-1]
    none = np.zeros(0, dtype=np.int64)
    columns = list(zip(*rows, strict=True))
    return pa.record_batch(
        [
            pa.array([number] * (len(rows) + 1)), pa.array([*columns[0], None], pa.int64()),
            *[pa.array([*c, None], pa.int64()) for c in columns[1:5]],
            *[pa.array([*c, None], pa.string()) for c in columns[6:]],
            _lists([*np.split(place, ends), none], pa.int32()), _lists([*[f[1] for f in found], none], pa.int32()),
            _lists([*[none] * len(rows), pairs], pa.int64()), _lists([*[none] * len(rows), docs], pa.int32()),
        ],
        names=[c.split()[0] for c in _ALIGNED.split(", ")],
    )


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, column: str = "text", keep_groups: bool = False) -> DataFrame:
    """The documents in blocks, and of each block a row (n_a is null) with its distinct pairs and the number of its documents that hold each."""
    path_a, path_b = path_a or vocabulary(), path_b or model_file()

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        texts, none = texts_of(batch.column(1)), np.zeros(0, dtype=np.int64)
        ids = batch.column(0).cast(pa.int64()).to_pylist()
        for lo, hi in slices(texts, 1 << 21):
            found = aligner(path_a, path_b).align([decoded(t) for t in texts[lo:hi]])
            for doc, size, f in zip(ids[lo:hi], map(len, texts[lo:hi]), found, strict=True):
                if f is None:
                    yield size, (doc, 0, 0, 0, 0, none, "", "" if keep_groups else None)
                else:
                    n_a, n_b, n_groups, links, shown = f
                    yield size, (doc, n_a, n_b, n_groups, len(links), links, hashlib.sha256(shown.encode()).hexdigest(), shown if keep_groups else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for more, row in rows_of(batch):
                if held and size + more > BLOCK:
                    yield _block(number, held)
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += more
        if held:
            yield _block(number, held)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", column).mapInArrow(run, _ALIGNED)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, n_docs (documents that hold it, corpus-wide) and whether no pair of the same A id has more.

    An A id has at most as many pairs as B has ids, so the window's partitions are bounded.
    """
    each = blocks.filter("n_a is null").select(F.explode(F.arrays_zip("pair", "docs")).alias("x"))
    counts = each.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    by_a = W.partitionBy(F.floor(F.col("pair") / size_b))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(by_a))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Each document with n_best and count_sum, from the counts of its block's pairs."""
    own = blocks.filter("n_a is null").select(F.col("block").alias("owner"), F.posexplode("pair").alias("at", "pair"))
    own = own.join(counts, "pair").select("owner", "at", "n_docs", "best")
    docs = blocks.filter("n_a is not null").drop("pair", "docs")
    given = [f.name for f in docs.schema if f.name not in ("block", "place", "times")]

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=bool)
        place = right.column("at").to_numpy()
        n_docs[place], best[place] = right.column("n_docs").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        at, times = left.column("place").combine_chunks(), left.column("times").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy())))
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(v)))[ends] for v in (best[at] * times, n_docs[at] * times)]
        return pa.table([*[left.column(c) for c in given], *[pa.array(np.diff(v)) for v in sums]], names=[*given, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in given) + ", n_best long, count_sum long"
    return docs.groupBy("block").cogroup(own.groupBy("owner")).applyInArrow(run, schema)


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, column: str = "text", keep_groups: bool = False) -> DataFrame:
    """A row for each document; ``groups`` holds the aligned groups as text if they are to be kept."""
    import sentencepiece

    path_b = path_b or model_file()
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    work = Work(docs.sparkSession, "alignment")
    blocks = work.save(aligned(docs, path_a, path_b, column, keep_groups), "blocks")
    return scored(blocks, pair_counts(blocks, size_b))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
