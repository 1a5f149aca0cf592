"""Language of a text: its family first, then the language within the family.

Features are hashed byte 2- and 3-grams of the whole text (square roots of
counts, unit length). Families are told apart by one-versus-rest linear
support vector machines; within a family, one-versus-one machines vote on
each pair of its languages. Both are trained on the driver from a bounded
sample: about SAMPLE rows of each language, and about SAMPLED of all, chosen by
a hash of the id, so the same rows are drawn at every partitioning. The driver
also holds the number of rows of each language, a weight vector a family, and
one for each two languages of a family.

A text that is null or has no letter is ``und`` with score 0. Rows without a
language are predicted but not learned from. A language outside FAMILIES is a
family of its own. Without training rows every text is ``und``. Rows that
repeat a doc_id are rows like others (drawn together, as the hash of the id
draws them); rows without one are never held out. Of equal margins or votes the
first family or language in alphabetical order wins. Equal texts have equal
predictions. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_text, map_batches, slices, table, texts_of
from .kernels import LOWER

#: Hashed features, expected sampled rows a language and of all languages (8 kB each on the driver), and texts featurised at once.
DIMENSIONS, SAMPLE, SAMPLED, AT_ONCE = 2048, 1500, 40_000, 512
UNDETERMINED = "und"

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "yue"),
}


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def ngram_features(texts: list[bytes]) -> np.ndarray:
    """A unit vector of hashed byte 2- and 3-grams for each text (zeros for an empty one)."""
    n = len(texts)
    data = np.frombuffer((b"  ".join(texts) + b"    ").translate(LOWER), dtype=np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(n), size) * DIMENSIONS
    at = np.arange(len(doc)) + np.repeat(2 * np.arange(n), size)  # two spaces stand between texts: no n-gram spans them
    pairs = data[at] * np.uint32(0x9E3779B1) + data[at + 1] * np.uint32(0x85EBCA77)
    triples = pairs * np.uint32(0xC2B2AE3D) + data[at + 2] * np.uint32(0x27D4EB2F)
    out = np.zeros(n * DIMENSIONS)
    for h in (pairs, triples):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(doc + (h >> np.uint32(21)), minlength=n * DIMENSIONS)
    out = np.sqrt(out.reshape(n, DIMENSIONS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Squared-hinge linear machine (weights, bias) by accelerated gradients; y is +1 or -1.

    Both classes weigh the same, however many rows they have.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)
    w = look = np.zeros(x.shape[1], dtype=x.dtype)
    step, ridge = x.dtype.type(1 / (4 + ridge)), x.dtype.type(ridge)  # |x|^2 is 2, the loss curves by 2 |x|^2 at most
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        gradient = -2 * (x.T @ (weight * y * slack)) + ridge * look
        after = look - step * gradient
        look = after + x.dtype.type(k / (k + 3)) * (after - w)
        w = after
    return w


class Hierarchy:
    """Family machines, and pairwise machines within each family."""

    def __init__(self, languages: list[str], x: np.ndarray, which: np.ndarray):
        self.families = sorted({family_of(k) for k in languages})
        self.members = [[i for i, k in enumerate(languages) if family_of(k) == f] for f in self.families]
        self.languages = languages
        home = np.array([next(i for i, m in enumerate(self.members) if k in m) for k in which]) if len(which) else which
        self.top = np.stack([linear_svm(x, np.where(home == i, 1, -1)) for i in range(len(self.families))]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                own = (which == a) | (which == b)
                self.pairs[a, b] = linear_svm(x[own], np.where(which[own] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers, and scores: the family's share times the pairwise shares' mean."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1))])
        if self.top is None:
            family, score = np.zeros(n, dtype=np.int64), np.ones(n)
        else:
            margin = np.exp(np.clip(3 * (x @ self.top.T), -30, 30))
            family = margin.argmax(axis=1)
            score = margin.max(axis=1) / margin.sum(axis=1)
        out = np.zeros(n, dtype=np.int64)
        for f, members in enumerate(self.members):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            votes, share = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for a, b in combinations(range(len(members)), 2):
                margin = x[at] @ self.pairs[members[a], members[b]]
                p = 1 / (1 + np.exp(np.clip(-3 * margin, -30, 30)))
                votes[:, a] += margin > 0
                votes[:, b] += margin <= 0
                share[:, a] += p
                share[:, b] += 1 - p
            best = (votes + share / (len(members) + 1)).argmax(axis=1)
            out[at] = np.array(members)[best]
            if len(members) > 1:
                score[at] *= share[np.arange(len(at)), best] / (len(members) - 1)
        return out, np.clip(score, 0, 1)


def train(rows: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """A hierarchy learned from about ``sample`` rows of each language of ``rows(doc_id, text, lang)``."""
    rows = rows.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, min(sample, SAMPLED // len(counts)))
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")  # a row a language
    drawn = rows.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(0))
        found = np.concatenate([ngram_features(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)])
        return pa.record_batch([batch.column(1), pa.array([v.tobytes() for v in found.astype(np.float32)], pa.binary())], names=["lang", "x"])

    learned = map_batches(drawn, ["text", "lang"], run, "lang string, x binary").collect()
    if not learned:
        return None
    learned.sort(key=lambda r: (r.lang, r.x))
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in learned])
    return Hierarchy(languages, x, np.array([languages.index(r.lang) for r in learned]))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_language(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        lettered = np.array([has_letter(t.decode("utf-8", "replace")) for t in texts])
        names, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        if model is not None:
            for lo, hi in slices(texts):
                for i in range(lo, hi, AT_ONCE):
                    j = min(i + AT_ONCE, hi)
                    which, score = model.predict(ngram_features(texts[i:j]))
                    names[i:j] = [model.languages[k] for k in which]
                    scores[i:j] = score
            names[~lettered], scores[~lettered] = UNDETERMINED, 0.0
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose crc32(doc_id) modulo 3 is not 1; those with 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = crc32_text("doc_id") % 3 == 1
    model = train(docs.filter(~out).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
