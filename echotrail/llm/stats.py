"""Counts of a document's words, lines, symbols and repeats, vectorised."""

from __future__ import annotations

import numpy as np

from . import kernels as K

U = np.uint64
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def _members(characters: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(characters)] = True
    return found


_SYMBOL = _members(SYMBOLS)
_UPPER, _DIGIT = _members(bytes(range(65, 91))), _members(b"0123456789")
_LETTER = _members(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_STOP, _SHOUT, _BAR = _members(b".,;:"), _members(b"!?"), _members(b"|")


def sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between neighbouring edges."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _repeats(words: K.Words, width: int, per_doc: np.ndarray) -> np.ndarray:
    """For each word, whether a window of ``width`` words over it occurs twice in its text."""
    n = len(words.hash)
    covered = np.zeros(n, dtype=bool)
    if n < width:
        return covered
    with np.errstate(over="ignore"):
        run = words.hash[: n - width + 1] * K.ODD[1]
        for k in range(1, width):
            run = run + words.hash[k : n - width + 1 + k] * K.ODD[1 + k]
        run = K.mix(run + per_doc[: n - width + 1].astype(np.uint64) * K.ODD[60])
    at = np.flatnonzero(per_doc[: n - width + 1] == per_doc[width - 1 :])
    order = at[np.argsort(run[at], kind="stable")]
    same = run[order][1:] == run[order][:-1]
    for k in range(width):
        covered[order[1:][same] + k] = True
        covered[order[:-1][same] + k] = True
    return covered


def document_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and more.

    Words are runs of bytes other than space and 9 to 13; characters are code
    points. An empty text has zeros.
    """
    w = K.Words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    inside = ~K.SEPARATOR[w.data]
    lead = (w.data & 0xC0) != 0x80
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(n, 2)
    out = {
        "n_words": np.diff(w.first),
        "word_chars": sums(inside & lead, w.begin),
        "n_symbols": sums(_SYMBOL[w.data], w.begin),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": sums(_repeats(w, 3, doc), w.first),
    }
    for name, kind in (("upper", _UPPER), ("digit", _DIGIT), ("letter", _LETTER), ("stop", _STOP), ("shout", _SHOUT), ("bar", _BAR)):
        out[name] = sums(kind[w.data], w.begin)
    size = (w.end - w.start).astype(np.int64)
    out["size_square"] = sums(size * size, w.first)
    out["size_sum"] = sums(size, w.first)
    out["short"] = sums(size <= 3, w.first)
    out["long"] = sums(size >= 16, w.first)
    out["symbol_ends"] = sums(_SYMBOL[w.data[w.end - 1]], w.first) if len(size) else np.zeros(n, dtype=np.int64)
    # distinct words and the most frequent one's count
    with np.errstate(over="ignore"):
        key = np.sort(K.mix(w.hash + doc.astype(np.uint64) * K.ODD[61]) >> U(20) | (doc.astype(np.uint64) << U(44)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    owner = (key[first] >> U(44)).astype(np.int64)
    out["distinct"] = np.bincount(owner, minlength=n).astype(np.int64)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, np.diff(np.append(first, len(key))))
    out["top"] = top
    return out


#: The statistics a quality score is made of.
FEATURES = (
    "log_words", "word_length", "word_length_spread", "symbols", "symbol_ends", "bars", "shouts", "stops", "uppers", "digits",
    "letters", "short_words", "long_words", "distinct_words", "top_word", "repeat_words", "dup_lines", "words_per_line",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's ratios are 0."""
    c = {k: v.astype(np.float64) for k, v in document_counts(texts).items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    mean = c["size_sum"] / words
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, np.sqrt(np.maximum(c["size_square"] / words - mean * mean, 0)),
            c["n_symbols"] / chars, c["symbol_ends"] / words, c["bar"] / words, c["shout"] / words, c["stop"] / words, c["upper"] / chars, c["digit"] / chars,
            c["letter"] / np.maximum(c["size_sum"], 1), c["short"] / words, c["long"] / words, c["distinct"] / words, c["top"] / words,
            c["n_repeat_words"] / words, c["n_dup_lines"] / lines, np.log1p(c["n_words"] / lines),
        ],
        axis=1,
    )
