"""Token counts per section of a document, by the tokens' character spans.

A document is encoded once, as a whole. Its tokens' code-point spans are
interval-joined to its sections; a token that touches several goes by RULE:

* ``largest`` (default): the section it shares the most characters with, the
  earliest of equals;
* ``first``: the section that holds its first character in any section.

Tokens that touch no section count for section -1, which is only listed where
there are any. So a document's counts add up to its number of tokens.

Sections are either given (an array of (section, start, end) per document, in
order of start; parts an earlier section covers are the earlier one's) or the
document's lines, each with its line end. A null or empty text has one empty
line; a document with an empty or null array has all its tokens outside. Wrong
UTF-8 counts as U+FFFD. Rows that repeat a doc_id, or have none, are rows like
others and each get their sections. Of equal shares the earliest section wins.
An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of
from .tokens import decoded, encoder, vocabulary

RULES = ("largest", "first")


def line_starts(text: str) -> np.ndarray:
    """The first code point of every line (a last line end opens no line)."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    breaks = np.flatnonzero(points == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(points)]))


def allocate(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1 for none), and whether it touches several.

    Tokens have spans [starts, ends), sections [begin, stop), both in order;
    sections don't overlap.
    """
    if not len(begin):
        return np.full(len(starts), -1, dtype=np.int64), np.zeros(len(starts), dtype=bool)
    first = np.searchsorted(stop, starts, side="right")  # the first section that ends behind the token's start
    last = np.searchsorted(begin, np.maximum(ends, starts + 1), side="left") - 1  # the last that begins before its end
    owner = np.where(first <= last, first, -1)
    several = last > first
    if rule == "largest":
        for i in np.flatnonzero(several).tolist():
            own = np.arange(first[i], last[i] + 1)
            shared = np.minimum(stop[own], ends[i]) - np.maximum(begin[own], starts[i])
            owner[i] = own[int(shared.argmax())]
    return owner, several


def section_tokens(docs: DataFrame, path: str | None = None, sections: str | None = None, rule: str = "largest") -> DataFrame:
    """doc_id, section, start, end, n_tokens and n_crossing for each section of ``docs(doc_id, text)``.

    sections: the name of a column array<struct<section: long, start: long,
    end: long>>; lines by default. n_crossing counts the tokens allocated to
    the section that also touch others.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).offsets
        given = batch.column(2).to_pylist() if sections else None
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, (doc, data) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
            text = decoded(data)
            _, starts, ends = encode(text)
            if given is None:
                begin = line_starts(text)
                stop, names = np.append(begin[1:], len(text)), np.arange(len(begin))
            else:
                own = [s for s in given[i] or [] if s is not None]
                names = np.array([s["section"] for s in own], dtype=np.int64)
                stop = np.maximum.accumulate(np.array([s["end"] for s in own], dtype=np.int64)) if own else np.empty(0, dtype=np.int64)
                begin = np.maximum(np.array([s["start"] for s in own], dtype=np.int64), np.concatenate(([0], stop[:-1]))) if own else stop
                begin = np.minimum(begin, stop)
            owner, several = allocate(starts, ends, begin, stop, rule)
            count = np.bincount(owner + 1, minlength=len(begin) + 1)
            crossing = np.bincount((owner + 1)[several], minlength=len(begin) + 1)
            if not count[0]:
                count, crossing = count[1:], crossing[1:]
            else:
                names, begin, stop = np.append(-1, names), np.append(0, begin), np.append(0, stop)
            for c, v in zip(out, (np.full(len(names), -1 if doc is None else doc), names, begin, stop, count, crossing), strict=True):
                c.append(v)
        flat = [np.concatenate(c) for c in out]
        ids = pa.array(flat[0], mask=np.repeat([d is None for d in batch.column(0).to_pylist()], [len(v) for v in out[1]]))
        return pa.record_batch([ids, *[pa.array(c.astype(np.int64)) for c in flat[1:]]], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    columns = ["doc_id", "text", sections] if sections else ["doc_id", "text"]
    return map_batches(docs, columns, run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
