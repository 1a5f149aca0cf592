"""Byte-level BPE by backtracking, embedding whitening and tokenizer alignment, against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotrail.llm import alignment, backtrack, whitening

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  a", "a ", "a  ", "\n", " \n x", "x\n", "x\n y", "a▁b", "<s> </s> <unk>", "<0x41>", "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "日本語 テキスト",
    "é é", "\x00", "a\x00 b", "🙂🙂 x", "\t\tx", "x" * 300, " " * 90 + "y", "ﬁ ﬂ", " x 　y", "é ​", "a\x1c b", "\x85 x", "don't we'll'", "1234567 89", "a  b   c    d",
    "-" * 200 + " " + "=" * 70, "͸ \U0001e4d0 Ᲊ", "one two three " * 50,
]
LONG = ["a" * 300_000, " ".join(f"w{i}" for i in range(150_000)), "\n" * 70_000 + "x"]


@pytest.fixture(scope="module")
def codec():
    return backtrack.codec(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def _ids(codec, text, **options):
    return np.frombuffer(codec.packed([text], **options)[0], dtype="<u4").tolist()


def _random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "aa", "e", " ", "  ", "\n", "\t", "the", "ing", "é", "ß", "中", "🙂", "1", "23", "'s", "'ll", "!", "--", "<|endoftext|>", "\x1c", "\x85", " ", "　", "QU"]
    wild = lambda: chr(rng.choice([rng.randint(0, 0x7F), rng.randint(97, 122), rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
    return ["".join(rng.choice(parts) if rng.random() < 0.8 else wild() for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_librarys(codec, library, seed):
    for text in [*_random_texts(seed, 1500), *(t or "" for t in ODD)]:
        assert _ids(codec, text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", LONG + ["ab" * 40_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))])
def test_long_words_and_texts_are_whole(codec, library, text):
    assert _ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_merging_gives_the_same_words(codec):
    """Against merging pair by pair, the lowest rank and then the leftmost first."""
    rng = random.Random(2)
    for _ in range(1500):
        word = bytes(rng.choice(b"abeinrst \xc3\xa9") for _ in range(rng.randint(1, 30)))
        ids = [codec.id_of_bytes[bytes([b])] for b in word]
        while True:
            ranks = [codec.rank.get(x << 32 | y, 1 << 60) for x, y in zip(ids, ids[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 60:
                break
            k = ranks.index(min(ranks))
            ids[k : k + 2] = [codec.id_of_bytes[codec.bytes_of[ids[k]] + codec.bytes_of[ids[k + 1]]]]
        assert np.frombuffer(codec.segment([word])[0], dtype="<u4").tolist() == np.frombuffer(codec.walk(word), dtype="<u4").tolist() == ids


def test_memory_starts_anew_without_a_difference(codec, library, monkeypatch):
    monkeypatch.setattr(backtrack, "REMEMBERED", 3)
    monkeypatch.setattr(backtrack, "PAIRS", 1 << 4)
    small = backtrack.Codec(BYTE_BPE)
    texts = _random_texts(9, 200)
    assert [np.frombuffer(r, dtype="<u4").tolist() for r in small.packed(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert _ids(codec, "<|endoftext|>", special=False) != [50256]


def test_decoding_is_the_librarys(codec, library):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randint(0, 50258) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0] == library.decode(ids, skip_special_tokens=False)


def test_encoded_rows(spark, library):
    """Null and repeated ids, odd and long texts, clashing names; one row for each row."""
    rows = [(i, t) for i, t in enumerate(ODD + LONG)] + [(None, "a b"), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "place")})
    got = backtrack.decoded_texts(backtrack.encoded(docs)).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.text) for r in got) == Counter(
        (i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False)) for i, ids in want
    )
    few = docs.filter("length(text) < 100")
    assert {r.doc_id: r.ids for r in backtrack.encoded(few, packed=False).collect() if r.doc_id == 4} == {4: library.encode("a ", add_special_tokens=False).ids}
    assert backtrack.encoded(docs.limit(0)).count() == 0


def _aligned(rows: list[tuple]) -> Counter:
    """Every token's byte range against every other's, and counts over all rows."""
    tok, model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    spelled = backtrack.codec(BYTE_BPE).bytes_of
    held, docs = [], Counter()
    for doc, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [spelled[i] for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            held.append((doc, [], [], [], []))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        a_start, b_start = a_end - [len(x) for x in a_bytes], b_end - [len(x) for x in b_bytes]
        links, groups, lo = [], [], 0
        for i in range(len(a)):
            near = range(np.searchsorted(b_end, a_start[i], side="right"), np.searchsorted(b_start, a_end[i]))
            links += [(a[i], b[j]) for j in near]
        for end in np.intersect1d(a_end, b_end):
            own = [[x[k] for k in np.flatnonzero((e > lo) & (e <= end))] for x, e in ((a, a_end), (b, b_end))]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            lo = end
        docs.update(set(links))
        held.append((doc, a, b, groups, links))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return Counter(
        (d, len(a), len(b), len(g), len(s), sum(docs[p] == best[p[0]] for p in s), sum(docs[p] for p in s), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, s in held
    )


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [40, 8 << 20])
def test_alignment_is_that_of_byte_ranges(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(ODD + [t for t in _random_texts(5, 120)])] + [(None, "a b"), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "pair", "place", "best")}).repartition(3)
    assert Counter(tuple(r[c] for c in _COLUMNS) for r in alignment.alignment(docs).collect()) == _aligned(rows)


def test_long_texts_are_aligned_whole(spark):
    rows = [(1, " ".join(f"wörd{i % 700}," for i in range(20_000))), (2, "x" * 5000)]
    assert Counter(tuple(r[c] for c in _COLUMNS) for r in alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == _aligned(rows)


def test_alignment_of_nothing_and_kept_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty).count() == 0
    row = alignment.alignment(spark.createDataFrame([(1, "hello, wörld")], "doc_id long, text string"), keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_transducer_by_hand():
    t = alignment.Transducer([b"ab", b"c", b"abcd"], [b"a", b"bc", b"d", b"x"])
    assert t.run([0, 1], [0, 1]) == ([[[0, 1], [0, 1]]], [0, 1, 5])  # ab|c against a|bc: one group, three links
    assert t.run([2], [0, 1, 2]) == ([[[2], [0, 1, 2]]], [8, 9, 10])
    assert t.run([0], [0]) is None and t.run([0, 1], [3]) is None and t.run([1], [1, 2]) is None


def _vectors(n: int, d: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.2, d)) / 3 + 0.2).astype(np.float32).tolist()


def _check_whitening(got: list, rows: list[tuple], k: int) -> None:
    kept = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and v]
    x = np.floor(1024 * np.array([v for _, v in kept], dtype=float)).astype(np.int64).astype(object) + 100_000
    n, sums = len(x), x.sum(axis=0)
    z = n * x - sums
    centred = (z / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = Counter((i, j + 1, n, int((zi * zi).sum())) for (i, _), zi in zip(kept, z, strict=True) for j in range(k))
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == want
    assert all(r.deviation_text == str(r.deviation) and r.identity_error < 1e-9 for r in got)
    for j in range(k):
        own = sorted((r for r in got if r.component == j + 1), key=lambda r: (r.deviation, r.vec_id is None, r.vec_id or 0))
        order = sorted(range(n), key=lambda i: (int((z[i] * z[i]).sum()), kept[i][0] is None, kept[i][0] or 0))
        mine, theirs = np.array([r.whitened for r in own]), (centred @ axes[:, j] / np.sqrt(values[j]))[order]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert own[0].explained == pytest.approx(values[j] / np.trace(centred.T @ centred / n), rel=1e-9)


@pytest.mark.parametrize("partitions", [1, 3, 70])
def test_whitening_is_that_of_the_covariance(spark, partitions):
    """Null, ragged and not finite vectors go; repeated and unnamed rows count; columns may clash."""
    rows = list(enumerate(_vectors(300, 12, 1))) + [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] + [0.0] * 11), (904, [])]
    rows += [(5, rows[5][1]), (None, rows[7][1])]
    frame = spark.createDataFrame([*rows, (905, [1.0] * 5), (906, [1e30] + [0.0] * 11)], "vec_id long, embedding array<float>")
    frame = frame.withColumns({c: F.lit("x") for c in ("n", "vector", "component", "part", "body")}).repartition(partitions)
    _check_whitening(whitening.whitened(frame).collect(), rows, 8)


def test_whitening_of_few_dimensions_and_rows(spark):
    rows = list(enumerate(_vectors(40, 3, 2)))
    _check_whitening(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 3)
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert len(flat) == 4 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in flat)
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and {round(r.explained, 9) for r in line} == {1.0, 0.0}


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(i, [float(i * 2**40), -float(i)]) for i in range(6)]
    got = {r.vec_id: r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.component == 1}
    x = [[1024 * i * 2**40 + 100_000, 100_000 - 1024 * i] for i in range(6)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i in range(6):
        assert got[i].deviation is None and int(got[i].deviation_text) == sum((6 * v - s) ** 2 for v, s in zip(x[i], sums, strict=True))
