"""Corpus operators against brute force, and at their edges."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from echotrail.llm import attribution, html, langid, media, minhash, packing, pieces, quality, repeats, rules, stats, tokens
from echotrail.llm import kernels as K
from echotrail.llm.components import connected_components
from echotrail.llm.common import Work
from echotrail.llm.suffix_array import suffix_array

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _prose(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(VOCABULARY)}{rng.randrange(60)}" for _ in range(n))


def _edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def _corpus() -> list[tuple]:
    """Ordinary, copied, edited, empty, null, very short and long texts."""
    rng = random.Random(5)
    texts: list[str | None] = [_prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    for i in range(12):
        texts += [texts[i], _edited(rng, texts[i], 0.02), _edited(rng, texts[i], 0.05)]
    base = _prose(rng, 150)
    texts += [base] * 15 + [_edited(rng, base, 0.03) for _ in range(25)]  # a large group of copies, exact and near
    passage = _prose(rng, 60)
    texts += [f"{_prose(rng, 40)}\n{passage}\n{_prose(rng, 40)}" for _ in range(6)]
    texts += [None, "", " \n\t", "one", "one", "Two words", "é ö ü ß", "a b c d", "a b c d e", "A B C D E", "ab" * 400, "xyz " * 300, _prose(rng, 6000), "l1\nl1\nl1\nl2 l2 l2 l2"]
    return [(i, t, ["en", "de", None][i % 3], ["s1", None][i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit("x") for c in ("data", "bucket", "kind", "score", "component", "rank", "length", "keys", "n", "rule", "fold")})


def _words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(K.LOWER))


def _shingles(text: str | None) -> set[bytes]:
    w = _words(text)
    if len(w) < 5:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def _components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {k: _shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k in sorted(sets):
        shared = Counter(j for s in sets[k] for j in holders[s])
        for j, m in shared.items():
            if 100 * m >= 75 * (len(sets[k]) + len(sets[j]) - m):
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: root(k) for k in sets}


def test_near_duplicates_are_those_of_brute_force(spark, docs, rows):
    texts = {r[0]: r[1] for r in rows}
    want = _components(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, docs).collect()}
    assert len(got) == len(rows)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (want[k] == k) and r.n_shingles == len(_shingles(texts[k])) for k, r in got.items())


def test_pairs_that_both_miss_the_centre_are_found(spark):
    """b and c are alike, a (the least id, so the centre) is like neither enough."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    a = base.copy()
    for i in range(0, 300, 40):
        a[i] = f"a{i}"
    b = base.copy()
    for i in range(20, 300, 40):
        b[i] = f"b{rng.random()}"
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b[:-1], "last"])), (3, " ".join(base))]
    want = _components(dict(rows))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sketch_agreement_estimates_similarity():
    rng = random.Random(1)
    for n in (3, 20, 400):
        a = [f"t{i}" for i in range(n + 4)]
        b = a[: max(5, int(len(a) * 0.9))] + [f"u{rng.random()}" for _ in range(max(1, len(a) // 10))]
        flat, offsets = K.shingles(K.Words([" ".join(a).encode(), " ".join(b).encode()], lower=True))
        sketch = K.one_permutation_sketch(flat, offsets, 2000)
        x, y = set(flat[: offsets[1]].tolist()), set(flat[offsets[1] :].tolist())
        assert abs((sketch[0] == sketch[1]).mean() - len(x & y) / len(x | y)) < 0.06


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 530)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "t")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Work(spark, "t")).count() == 0


def _repeats(texts: dict[int, str | None]) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(texts):
        t = (texts[d] or "").encode()
        hit = bytearray(len(t))
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out[d] = (len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def test_repeats_are_those_of_brute_force(spark, docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.find_repeats(spark, docs, DIGEST, repeats._digest).collect()}
    assert got == _repeats({r[0]: r[1] for r in rows})


@pytest.mark.parametrize("hot, mark, compact", [(2, 64, 10**6), (20_000, 64, 10**6), (20_000, 2, 1), (2, 2, 7)])
def test_repeats_with_periods_and_hot_anchors(spark, monkeypatch, hot, mark, compact):
    """Self-overlaps, matches across characters, and anchors dealt out window by window."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MARK", mark)
    monkeypatch.setattr(repeats, "COMPACT", compact)
    rng = random.Random(8)
    passage = _prose(rng, 40)
    texts = {0: "a" * 350, 1: "a" * 101, 2: "b" * 99, 3: "b" * 100, 4: "é" * 120, 5: "zé" * 90 + "é" * 80, 6: "abc" * 200, 7: None, 8: ""}
    for i in range(10, 24):
        texts[i] = _prose(rng, rng.randrange(5, 30)) + passage[rng.randrange(20) :][: rng.randrange(120, 250)] + _prose(rng, rng.randrange(5, 30))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.find_repeats(spark, frame.repartition(5), DIGEST, repeats._digest).collect()}
    assert got == _repeats(texts)


@pytest.mark.parametrize("mark", [3, 64])
def test_a_window_in_every_document_and_ids_of_one_residue(spark, monkeypatch, mark):
    """All ids are multiples of any number of buckets there may be."""
    monkeypatch.setattr(repeats, "MARK", mark)
    rng = random.Random(18)
    line = "This very line of more than a hundred characters stands in each and every document of the corpus, word for word."
    texts = {i * 3 * 2**20: f"{_prose(rng, rng.randrange(3, 25))} {line} {_prose(rng, 12)}" for i in range(90)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.find_repeats(spark, frame, DIGEST, repeats._digest).collect()}
    assert got == _repeats(texts)
    assert len(set(repeats.document_bucket(np.array(list(texts)), 32).tolist())) > 25


def test_document_buckets_are_sparks(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1, 123456789]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(37)).alias("b"))
    assert {r.doc_id: r.b for r in frame.collect()} == dict(zip(ids, repeats.document_bucket(np.array(ids), 37).tolist(), strict=True))


def test_all_columns_and_repeated_rows_stay(spark):
    schema = "kept_text string, text string, doc_id int, bucket string, kind double, row array<int>, null boolean, others date"
    q = "q" * 150
    rows = [("k", "p" + q, 1, "b", 0.5, [1], True, None), ("l", "p" + q, 1, "c", None, [], False, None), ("m", q + "x", 2, None, 1.0, None, None, None), ("n", None, 3, "d", 2.0, [3], True, None), ("o", "", None, "e", 3.0, [4], True, None)]
    frame = spark.createDataFrame(rows, schema)
    found = repeats.without_repeats(spark, frame)
    assert found.schema.simpleString() == frame.schema.simpleString()
    got = {r.kept_text: r for r in found.collect()}
    assert len(got) == 5 and got["k"].text == got["l"].text == "pq" and got["m"].text == "x"
    assert got["n"].text is None and got["o"].text == "" and got["o"].doc_id is None
    assert {k: tuple(v for c, v in r.asDict().items() if c != "text") for k, r in got.items()} == {r[0]: tuple(v for i, v in enumerate(r) if i != 1) for r in rows}
    assert repeats.without_repeats(spark, frame.limit(0)).count() == 0


def test_removed_spans_and_kept_texts(spark):
    rows = [(1, "p" * 50 + "q" * 200), (2, "x" * 30 + "q" * 150 + "y" * 30), (None, "q" * 150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in repeats.kept_texts(spark, frame).collect()}
    # a null id comes first; in it each string but the first starts earlier as well
    assert kept[None] == "q" and kept[2] == "x" * 30 + "y" * 30
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.removed_spans(spark, frame).collect()}
    assert spans[2] == [(30, 180)] and spans[1] == [(50, 250)] and spans[None] == [(1, 150)]


def test_suffix_array_is_the_sorted_one():
    rng = random.Random(4)
    for _ in range(300):
        s = np.array([rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randrange(70))], dtype=np.int64)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def _counts(text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if triples[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts_are_those_of_brute_force(spark, docs, rows):
    got = {r.doc_id: r for r in rules.quality_rules(spark, docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r, want = got[doc], _counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_cutoffs_follow_each_group(spark):
    """A source full of symbols keeps its ordinary documents; a clean source rejects one like them."""
    rng = random.Random(9)
    plain = [_prose(rng, 80) for _ in range(300)]
    noisy = [" ".join(w + "#" if rng.random() < 0.5 else w for w in _prose(rng, 80).split(" ")) for _ in range(151)]
    rows = [(i, t, "en", "clean") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "noisy") for i, t in enumerate(noisy[:150])] + [(5000, noisy[150], "en", "clean")]
    kept = {r.doc_id: r.kept for r in rules.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[5000]
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(150))


def _rejected(spark, symbols: dict[str, list[int]]) -> dict[str, list[int]]:
    """Which of documents of 200 words, with so many symbols each, the rules reject in each source."""
    rows, at = [], {}
    for group, counts in symbols.items():
        for i, n in enumerate(counts):
            words = [f"word{(i * 200 + j) % 9973:04d}" for j in range(200)]
            words[:n] = [w + "#" for w in words[:n]]
            at[len(rows)] = (group, i)
            rows.append((len(rows), " ".join(words), "en", group))
    found: dict[str, list[int]] = {g: [] for g in symbols}
    for r in rules.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("not kept").collect():
        found[at[r.doc_id][0]].append(at[r.doc_id][1])
    return {g: sorted(x) for g, x in found.items()}


def test_symbols_are_rejected_only_where_they_stand_apart(spark):
    """Ordinary use by a tenth, or by most, rejects nothing; junk far above either is rejected."""
    ordinary = [i % 6 if i % 10 == 0 else 0 for i in range(300)]
    assert _rejected(spark, {"a": ordinary, "b": [5 + i % 20 for i in range(300)]}) == {"a": [], "b": []}
    assert _rejected(spark, {"a": [*ordinary, 150, 180]}) == {"a": [300, 301]}
    assert _rejected(spark, {"a": [0] * 300}) == {"a": []}


def test_cutoffs_differ_between_groups(spark):
    """What is junk in a plain source is common in a marked one."""
    found = _rejected(spark, {"plain": [0] * 400 + [120] * 8, "marked": [100 + i % 60 for i in range(400)]})
    assert found["plain"] == list(range(400, 408)) and found["marked"] == []


def test_no_size_at_which_a_group_turns(spark):
    """A small group leans on its language's sketch, more or less, and judges alike."""
    sizes = (6, 20, 60, 99, 100, 101, 300)
    found = _rejected(spark, {"plain": [0] * 400 + [120] * 8} | {f"of {n}": [0] * n + [120] for n in sizes})
    assert all(found[f"of {n}"] == [n] for n in sizes)


def _verdicts(rows: list[tuple]) -> dict[int, bool]:
    """The rules by sorting each group's values."""
    counts = {d: _counts(t) for d, t, *_ in rows}
    n_lines = {d: len([x for x in (t or "").split("\n") if x.strip(" \t\v\f\r")]) for d, t, *_ in rows}
    ratio = lambda a, b: a / b if b else 0.0
    found = {d: (ratio(c[2], c[1]), ratio(c[4], c[0]), ratio(c[3], n_lines[d]), ratio(c[1], c[0])) for d, c in counts.items()}
    base = {d for d, c in counts.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    unit = {d: (ratio(1, c[1]), ratio(3, c[0]), ratio(1, n_lines[d])) for d, c in counts.items()}
    bucket = lambda x: int(np.ceil(np.log(x) / np.log(rules.GAMMA))) if x > 0 else -(2**30)
    value = lambda b: rules.GAMMA**b * (1 + 1e-9) if b > -(2**30) else 0.0
    upto = lambda w, b: sum(n for x, n in w.items() if x <= b)
    at = lambda w, share: min(b for b in w if upto(w, b) >= share * sum(w.values()))

    def weights(of: dict, i: int, lang: object, source: object) -> Counter:
        """Each row by itself; then those of the language and of the source, bucket by bucket."""
        out, whole = Counter(), {"lang": Counter(), "source": Counter()}
        for d, _, x, y in rows:
            if d not in base:
                b = bucket(of[d][i])
                out[b] += rules.UNIT * ((x, y) == (lang, source))
                whole["lang"][b] += x == lang
                whole["source"][b] += y == source
        for part in whole.values():
            for b, n in part.items():
                out[b] += rules.MIX * rules.UNIT * n // sum(part.values())
        return +out

    def cut(i: int, kind: str | None, lang: object, source: object) -> float | None:
        own = weights(found, i, lang, source)
        size = sum(own.values())
        if kind is None:
            return value(at(own, 0.75)) + rules.REACH * (value(at(own, 0.75)) - value(at(own, 0.25)))
        start = at(weights(unit, i, lang, source), 0.5)
        for b in sorted({start, *own}):
            near, far = upto(own, b + rules.STRETCH_BUCKETS) - upto(own, b), size - upto(own, b + rules.STRETCH_BUCKETS)
            if b >= start and 4 * upto(own, b) >= 3 * size and far > 0 and rules.THIN * near <= far:
                return value(b + rules.STRETCH_BUCKETS)
        return None

    kept, cuts = {}, {}
    for d, _, lang, source in rows:
        kept[d] = d not in base
        for i, (_, kind) in enumerate(rules.RULES.values()):
            if kept[d]:
                if (i, lang, source) not in cuts:
                    cuts[i, lang, source] = cut(i, kind, lang, source)
                kept[d] = cuts[i, lang, source] is None or found[d][i] <= cuts[i, lang, source]
    return kept


def test_verdicts_are_those_of_sorted_groups(spark):
    """Large and small groups, a null language, a null source, and ratios that many rows share."""
    rng = random.Random(21)
    rows = []
    for i in range(700):
        words = _prose(rng, rng.randrange(48, 90)).split(" ")
        if rng.random() < 0.15:
            words = [w + "#" * rng.randrange(3) for w in words]
        if rng.random() < 0.15:
            words = words[:20] + words[: rng.randrange(4, 20)] + words[20:]
        if rng.random() < 0.05:
            words = [w * 2 for w in words]
        text = " ".join(words[:30]) + "\n" + " ".join(words[30:]) + "\nend" * rng.choice([1, 1, 1, 2])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", None])))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark, frame).collect()}
    assert got == _verdicts(rows) and 0 < sum(got.values()) < len(got)


def test_quality_learns_labels_and_ignores_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.7
        text = _prose(rng, 60)
        rows.append((i, text if good else " ".join(w + rng.choice("***|###") for w in text.upper().split(" "))))
        labels.append((i, int(good), 0))
    rows += [(5000, None), (5001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(spark, docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.98
    # turning the held-out labels around changes nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(spark, docs, turned).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())


def test_quality_is_that_of_one_process(spark, docs, rows):
    """The same scores from all rows in one matrix, solved and pooled directly."""
    rng = random.Random(13)
    learned = [(r[0], rng.randint(0, 1)) for r in rows for _ in range(1 + (r[0] % 7 == 0))]
    labels = spark.createDataFrame([(d, y, 0) for d, y in learned], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.quality_scores(spark, docs.repartition(7), labels).collect()}

    x = np.concatenate([stats.features([(r[1] or "").encode()]) for r in rows]).astype(np.float32).astype(float)
    mean_of = defaultdict(list)
    for d, y in learned:
        mean_of[d].append(y)
    own = [i for i, r in enumerate(rows) if zlib.crc32(str(r[0]).encode()) % 5 and r[0] in mean_of]
    y = np.array([np.mean(mean_of[rows[i][0]]) for i in own])
    fourier = quality.FourierMap(x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-3))
    z = fourier(x)
    fold = np.array([r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) as f").orderBy("doc_id").collect()])[own]

    def ridge(at):
        penalty = quality.RIDGE * len(at) * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(z[own][at].T @ z[own][at] + penalty, z[own][at].T @ y[at])

    raw = np.array([z[own][i] @ ridge(np.flatnonzero(fold != fold[i])) for i in range(len(own))])
    bins = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    kinds = sorted(set(bins.tolist()))
    level = quality.isotonic(np.array([(bins == b).sum() for b in kinds], float), np.array([y[bins == b].mean() for b in kinds]))
    want = np.clip(np.interp(z @ ridge(np.arange(len(own))), (np.array(kinds) + 0.5) / quality.BINS * 2 - 1 + 0.5, level), 0, 1)
    close = [abs(got[r[0]] - want[i]) < 0.02 for i, r in enumerate(rows)]  # a raw score may fall into the next bin
    assert np.mean(close) > 0.97


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(spark, docs, none).collect()} == {0.5}


def test_fourier_map_approximates_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 18))
    z = quality.FourierMap(np.zeros(18), np.ones(18))(x)[:, :-1]
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-squares / (2 * quality.BANDWIDTH**2))).max() < 0.3


def test_isotonic_fit():
    assert quality.isotonic(np.ones(4), np.array([0.0, 1.0, 0.0, 1.0])).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_statistics_of_empty_texts():
    assert np.isfinite(stats.features([b"", b" ", b"a"])).all()


def test_encoder_agrees_with_the_library(rows):
    from tokenizers import Tokenizer

    encode, slow = tokens.encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    odd = ["<|endoftext|> x", "日本語 text", "a b", "naïve — “quoted” 12,5€", "😀 x", "it's we'll  \n\n end ", "x" * 5000, "a" + " " * 1_200_000 + "b"]
    for text in [r[1] or "" for r in rows] + odd:
        want = slow.encode(text, add_special_tokens=False)
        ids, starts, ends = encode.offsets(text)
        assert encode.ids(text).tolist() == want.ids == ids.tolist()
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def test_packing_is_whole_and_gapless(spark, docs, rows):
    encode = tokens.encoder(tokens.vocabulary())
    got = packing.packed(spark, docs).collect()
    by_doc, by_row = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_row[r.sequence_id].append((r.offset, r.length))
    for doc, text, *_ in rows:
        ids, at = [*encode.ids(text or "").tolist(), 2], 0
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at) and r.length <= 1024 and (i == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) and (len(own) > 1) == (len(ids) > 1024)
    for places in by_row.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_plans_hold_the_histogram_and_are_tight():
    rng = random.Random(7)
    for trial in range(5):
        sizes = [rng.choice([rng.randint(1, 100), rng.randint(300, 700), 1024]) for _ in range(rng.randint(1, 3000))] if trial else [400] * 10 + [600] * 10
        histogram = Counter(sizes)
        plan = packing.plan(dict(histogram))
        held = Counter()
        for config, n in plan:
            assert sum(k * m for k, m in config) <= 1024
            for k, m in config:
                held[k] += m * n
        assert held == histogram
        used = sum(n for _, n in plan)
        bound = max(-(-sum(sizes) // 1024), sum(1 for s in sizes if s > 512))
        assert used <= bound * 1.03 + 2
    assert packing.plan({}) == []


def _least_rows(sizes: list[int], capacity: int) -> int:
    """The exact optimum by dynamic programming over sets of pieces: (rows, room used in the last one)."""
    best = [(0, capacity)] + [(len(sizes) + 1, 0)] * (2 ** len(sizes) - 1)
    for held in range(2 ** len(sizes)):
        rows, used = best[held]
        for i, x in enumerate(sizes):
            if not held >> i & 1:
                best[held | 1 << i] = min(best[held | 1 << i], (rows, used + x) if used + x <= capacity else (rows + 1, x))
    return best[-1][0]


def test_small_histograms_need_the_least_rows():
    rng, more = random.Random(29), 0
    for _ in range(40):
        sizes = [rng.choice([rng.randint(1, 40), rng.randint(20, 60)]) for _ in range(rng.randint(1, 11))]
        used, least = sum(n for _, n in packing.plan(dict(Counter(sizes)), 64)), _least_rows(sizes, 64)
        assert least <= used <= least + 1
        more += used - least
    assert more <= 2


def test_the_program_places_most_pieces():
    """Lengths that only certain combinations fill: best-fit alone would need more rows."""
    histogram = {6: 300, 7: 300, 11: 100, 13: 100, 24: 100, 27: 200}
    left = dict(histogram)
    sizes = np.array(sorted(left))
    solution = packing.fractional(sizes, np.array([float(left[int(k)]) for k in sizes]), 64)
    covered = Counter()
    for config, x in solution.items():
        assert sum(config) <= 64
        for k in config:
            covered[k] += x
    assert all(covered[k] >= n * (1 - 1e-9) for k, n in histogram.items())
    placed = packing.rounded(solution, left)
    assert sum(n * len(c) for c, n in placed) > 0.8 * sum(histogram.values())
    rows = sum(n for _, n in packing.plan(histogram, 64))
    bound = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert rows <= min(1.02 * bound + 1, sum(n for _, n in packing.best_fit(histogram, 64)))


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes, values = np.sort(rng.choice(np.arange(2, 30), 5, replace=False)), rng.random(5)
        best = np.zeros(61)
        for c in range(61):
            best[c] = max([best[c - 1] if c else 0, *[best[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c]])
        found, pick = packing.knapsack_table(values, sizes, 60)
        assert found == pytest.approx(best)
        c, worth = 60, 0.0
        while c > 0:
            worth += values[pick[c]] if pick[c] >= 0 else 0
            c -= sizes[pick[c]] if pick[c] >= 0 else 1
        assert c == 0 and worth == pytest.approx(best[60])


def test_merge_dropout_is_lossless_and_seeded(spark, docs, rows):
    got = {r.doc_id: r for r in pieces.encoded(docs, seed=3, rate=0.2).collect()}
    p = pieces.pieces_of(pieces.model_file())
    for doc, text, *_ in rows:
        r = got[doc]
        assert r.lossless and pieces.decode(p, r.ids) == (text or "") and r.n_pieces == len(r.ids)
    same = {r.doc_id: r.ids for r in pieces.encoded(docs.repartition(3), seed=3, rate=0.2).collect()}
    other = {r.doc_id: r.ids for r in pieces.encoded(docs, seed=4, rate=0.2).collect()}
    assert all(same[k] == r.ids for k, r in got.items())
    assert sum(other[k] != r.ids for k, r in got.items()) > len(rows) / 2


def test_pieces_without_dropout_are_the_librarys(rows):
    import sentencepiece

    model, p = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file()), pieces.pieces_of(pieces.model_file())
    texts = [r[1] for r in rows if r[1] and r[1].strip()] + ["x  y\n\tz ", "日本 ö\U0001f600", "w" * 500]
    flat, offsets = pieces.encode_batch(p, texts, np.zeros(len(texts), dtype=np.int64), rate=0.0)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == model.encode(t)


def test_rounds_and_agenda_agree(monkeypatch, rows):
    p, texts = pieces.pieces_of(pieces.model_file()), [r[1] or "" for r in rows[:60]] + ["▁ literal ▁"]
    variants = np.arange(len(texts)) % 8
    whole = pieces.encode_batch(p, texts, variants, rate=0.3)
    monkeypatch.setattr(pieces, "LONG", 0)
    heap = pieces.encode_batch(p, texts, variants, rate=0.3)
    assert whole[0].tolist() == heap[0].tolist() and whole[1].tolist() == heap[1].tolist()


def _naive_pieces(model, text: str, doc: int, seed: int, rate: float) -> list[int]:
    """Merge-dropout by its definition: scan all pairs of a unit, merge the best that isn't dropped."""
    word = 2**64 - 1

    def mixed(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
        return x ^ (x >> 31)

    odd = [int(v) for v in K.ODD]
    out, whole = [], f" {text}"
    for unit in re.finditer(r" *[^ ]+| +$", whole):
        letters = unit[0]
        own = mixed((sum(mixed(ord(c) + 1) * pow(int(K.BASE), i, 2**64) for i, c in enumerate(letters)) + len(letters)) & word)
        key = mixed((own + doc * odd[5] + seed * odd[6] + mixed(unit.start() + 1)) & word)
        parts = [(c.replace(" ", "▁") if c != "▁" else "", i, i + 1) for i, c in enumerate(letters)]

        def piece(t: str) -> int:
            i = model.piece_to_id(t)
            return i if t and i != model.unk_id() and model.id_to_piece(i) == t and not model.is_byte(i) and not model.is_control(i) else -1

        while True:
            best = None
            for k in range(len(parts) - 1):
                (a, begin, middle), (b, _, end) = parts[k], parts[k + 1]
                if piece(a) < 0 or piece(b) < 0 or piece(a + b) < 0:
                    continue
                if mixed((key + begin * odd[2] + middle * odd[3] + end * odd[4]) & word) < int(rate * 2**64):
                    continue
                rank = (-model.get_score(piece(a + b)), k)
                best = min(best, (rank, k)) if best else (rank, k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1], parts[k + 1][2])]
        for t, begin, end in parts:
            out += [piece(t)] if piece(t) >= 0 else [model.piece_to_id(f"<0x{b:02X}>") for b in letters[begin:end].encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_merge_dropout_is_that_of_its_definition(rows, rate):
    import sentencepiece

    model, p = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file()), pieces.pieces_of(pieces.model_file())
    texts = [r[1][:600] for r in rows if r[1]][::3] + ["two  spaces \n\t tab ", "naïve ▁ 日本語", "internationalization " * 4, "z" * 200]
    docs = np.arange(len(texts), dtype=np.int64) * 977 + 5
    flat, offsets = pieces.encode_batch(p, texts, docs, seed=3, rate=rate)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == _naive_pieces(model, t, int(docs[i]), 3, rate), t


def test_wrong_utf8_is_not_lossless(spark):
    frame = spark.createDataFrame([(1, bytearray(b"ab\xff c")), (2, bytearray("a\ufffd c".encode()))], "doc_id long, text binary").withColumn("text", F_cast_string())
    assert {r.doc_id: r.lossless for r in pieces.encoded(frame).collect()} == {1: False, 2: True}


def F_cast_string():
    from pyspark.sql import functions as F

    return F.col("text").cast("string")


def test_dropout_differs_by_document_and_place(spark):
    word, n = "internationalization", 300
    p = pieces.pieces_of(pieces.model_file())
    docs = spark.createDataFrame([(i, " ".join([word] * 3)) for i in range(n)], "doc_id long, text string")
    got = [p_ids for (p_ids,) in pieces.encoded(docs, seed=3, rate=0.5).select("ids").collect()]
    assert len({tuple(ids) for ids in got}) > 100  # more than any few variants give
    places = [tuple(pieces.encode_batch(p, [" ".join([word] * 50)], np.array([d]), rate=0.5)[0].tolist()) for d in range(3)]
    assert len(set(places)) == 3
    cuts = set()
    for ids in places:  # a document's segmentations of the word
        text, now = "", []
        for i in ids:
            text, now = text + p.bytes_of[i].decode(), [*now, i]
            if text == f" {word}":
                cuts.add(tuple(now))
                text, now = "", []
        assert not text
    assert len(cuts) > 6


def test_remembered_units_are_segmented_as_by_the_agenda(rows):
    p, texts = pieces.pieces_of(pieces.model_file()), [r[1] or "" for r in rows[:20]]
    memory, keys = pieces.Memory(), np.arange(len(texts))
    pieces.encode_batch(p, texts, keys + 100, rate=0.1, memory=memory)
    warm, cold = pieces.encode_batch(p, texts, keys, rate=0.1, memory=memory), pieces.encode_batch(p, texts, keys, rate=0.1)
    assert len(memory.keys) and warm[0].tolist() == cold[0].tolist() and warm[1].tolist() == cold[1].tolist()


def test_articles_in_forms_and_named_containers_are_kept():
    one, two = "The first paragraph says something of a certain length, and then more.", "The second paragraph goes on about it for a while, with no links at all."
    text, menu = f"<p>{one}</p><p>{two}</p>", "<nav><a href=1>Menu one</a></nav>"
    for page in (
        f"<body><form>{menu}<input><label>Name</label><div>{text}</div><button>Go</button></form></body>",
        f"<body><form><button>Go</button><article>{text}</article></form></body>",
        f"<body>{menu}<div class='post type-post tag-news'>{text}</div></body>",
        f"<body>{menu}<div class='social-policy'>{text}</div></body>",
        f"<body>{menu}<div class='content-side'>{text}</div></body>",
        f"<body><main><div class='elementor-widget elementor-widget-text-editor'><p>{one}</p></div><div class='elementor-widget elementor-widget-text-editor'><p>{two}</p></div></main></body>",
        f"<body><div class='sidebar'>{text}</div></body>",
    ):
        assert html.main_text(page) == f"{one}\n{two}", page
    comments = f"<section id='comments'>{text * 3}</section>"
    assert html.main_text(f"<body><article>{text}</article>{comments}</body>") == f"{one}\n{two}"
    assert html.main_text(f"<body><article>{text}<form><label>Name</label><p>Send</p></form></article></body>") == f"{one}\n{two}"


def test_letters_that_grow_in_lower_case_lose_no_text():
    one, two = "İstanbul " * 40, "The second paragraph is still there."
    assert html.main_text(f"<body><p>{one}</p><script>var x;</SCRIPT><p>{two}</p></body>") == f"{one.strip()}\n{two}"


def test_chapters_with_an_id_of_the_layout_are_kept():
    one, two = "The first paragraph says something of a certain length, and then more.", "The second paragraph goes on about it for a while, with no links at all."
    for name in ("search", "menu", "notice", "tags"):
        assert html.main_text(f"<body><article><p>{one}</p><section id='{name}'><h2>Part</h2><p>{two}</p></section></article></body>") == f"{one}\nPart\n{two}", name
    for inner in (
        f"<section id='search'><form><p>{two}</p></form></section>",
        "<section id='menu'><a href=1>One page</a> <a href=2>Another page</a></section>",
        f"<section id='menu' class='promo'><p>{two}</p></section>",
        f"<section id='comments'><p>{two}</p></section>",
        f"<section id='newsletter'><p>{two}</p></section>",
        f"<div id='search'><p>{two}</p></div>",
    ):
        assert html.main_text(f"<body><article><p>{one}</p><p>{one}</p>{inner}</article></body>") == f"{one}\n{one}", inner


def test_headline_beside_the_text_comes_first():
    one, two = "The first paragraph says something of a certain length, and then more.", "The second paragraph goes on about it for a while, with no links at all."
    text = f"<div class='text'><p>{one}</p><p>{two}</p></div>"
    for page in (f"<body><div><h1>A <b>head</b></h1>{text}</div></body>", f"<body><h1>A head</h1><div><div>{text}</div><div><a href=1>Link</a></div></div></body>"):
        assert html.main_text(page) == f"A head\n{one}\n{two}", page
    for head in ("<h1><a href=/>The site</a></h1>", "<header><h1>The site</h1></header>", "<h1> </h1>"):
        assert html.main_text(f"<body>{head}{text}</body>") == f"{one}\n{two}", head
    assert html.main_text(f"<body><h1>The site</h1><article><h1>A head</h1>{text}</article></body>") == f"A head\n{one}\n{two}"


def test_references_end_with_their_run_of_text():
    assert html.main_text("<body><p>x &<b>lt;</b> y &amp;lt; z&nbsp; &#x41;</p></body>") == "x &lt; y &lt; z A"


def test_topics_named_like_layout_are_kept():
    one, two = "The first paragraph says something of a certain length, and then more.", "The second paragraph goes on about it for a while, with no links at all."
    menu = "<div class='search-box'><a href=1>Search here for all that this site has to offer to you, its reader</a></div>"
    for name in ("related-work", "search-algorithms", "notice-of-meeting", "sharing-economy", "relatedWork"):
        page = f"<body>{menu}<article><h1>Title</h1><p>{one}</p><section id='{name}'><h2>Part</h2><p>{two}</p></section></article></body>"
        assert html.main_text(page) == f"Title\n{one}\nPart\n{two}", name
    assert html.main_text(f"<body>{menu}<div class='widget content'><p>{one}</p><p>{two}</p></div></body>") == f"{one}\n{two}"
    for name in ("newsletter-box", "related-posts", "ad-slot-3", "cookie-banner", "share-buttons", "comments", "promo", "searchForm"):
        page = f"<body><article><p>{one}</p><p>{two}</p><div class='{name}'>A short sale lasts until the end of this week, so buy our products at half the price now.</div></article></body>"
        assert html.main_text(page) == f"{one}\n{two}", name
    footer = "<div class='footer'>Copyright by the owner of this page, who reserves all rights.</div>"
    for name in ("content-sidebar-wrap", "layout-sidebar-right", "page-nav-left"):
        assert html.main_text(f"<body><div id='{name}'><div>{menu}<p>{one}</p><p>{two}</p></div></div>{footer}</body>") == f"{one}\n{two}", name
    assert html.main_text(f"<body><div><p>{one}</p><p>{two}</p></div><div class='comments-wrap'><p>{one}!</p><p>{two}!</p><p>{one}?</p></div></body>") == f"{one}\n{two}"
    comment = "<article class='comment-body'><p>A reader has a few words to say about it too.</p></article>"
    assert html.main_text(f"<body><main><article><p>{one}</p><p>{two}</p></article><section id='comments'>{comment * 2}</section></main></body>") == f"{one}\n{two}"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "x" + "</div>" * 10, "<i>" * 50_000 + "x" + "</b>" * 50_000, "<b>" + "<div>" + "<i>" * 50_000 + "x" + "</b></section>" * 50_000,
        "<ul>" + "<i>" * 30_000 + "<li>x" * 30_000, "<article>" * 50_000 + "x", "<p>" + "<i>" * 30_000 + "<i><p>x" * 30_000, "<header>" * 50_000 + "x", "<main>" + "<header>" * 50_000 + "x",
    ],
)
def test_nesting_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 8


def _random_page(rng: random.Random, depth: int = 0) -> str:
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth > 4:
            out.append(" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 9))))
        else:
            tag = rng.choice(["div", "div", "section", "ul", "b", "a", "nav"])
            out.append(f"<{tag}>{_random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_density_is_that_of_its_definition():
    import math

    def walk(node):
        """Characters, tags, linked characters and tags below a node, by recursion."""
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                c += len(re.sub(r"\s", "", x))
            elif not x.other:
                a = walk(x)
                c, t = c + a[0], t + a[1] + 1
                lc, lt = (lc + a[0], lt + a[1] + 1) if x.tag == "a" else (lc + a[2], lt + a[3])
        return (c, t, c, t) if node.tag == "a" else (c, t, lc, lt)

    def density(node, body):
        (c, t, lc, lt), (cb, _, lb, _) = walk(node), walk(body)
        if not c:
            return 0.0
        t, base = max(t, 1), math.log(1 + math.log(c / max(c - lc, 1) * lc + lb / max(cb, 1) * c + math.e))
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / base

    rng, seen = random.Random(17), 0
    for _ in range(60):
        root = html.parse(f"<body>{_random_page(rng)}</body>")
        body, within = html._candidates(root)
        for node in within:
            seen += 1
            assert node.density == pytest.approx(density(node, body))
            inner = [x for x in node.children if not isinstance(x, str) and not x.other]
            own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
            assert node.total == pytest.approx(own + sum(density(x, body) for x in inner))
    assert seen > 300


PAGES = {
    "<html><head><title>t</title></head><body><nav><a href=1>Menu one</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p><b>First para  with\n"
    "space.<br><p>Second.</p><ul><li>one<li>two</ul><section id='comments'><p>A long reader comment that says a lot of things</p></section></article><footer>foot</footer>"
    "<script>var x = '<p>no</p>';</script></body></html>": "Head & line\nFirst para with space.\nSecond.\none\ntwo",
    "<div id=header><header>Site</header></div><div class='content'><p>Body text of some length, with words.</p><form><p>Name</p></form><p>More of it.</p></div>"
    "<aside><p>Side side side side side side</p></aside>": "Body text of some length, with words.\nMore of it.",
    "": "",
    "plain &lt;text&gt;  only": "plain <text> only",
    "<body></body>": "",
    "<p>unclosed <!-- <p>no --> and <i>inline</i>text": "unclosed and inlinetext",
}


def test_extraction(spark):
    from pyspark.sql import functions as F

    pages = [(i, f"u{i}", page) for i, page in enumerate(PAGES)] + [(99, None, None), (100, "deep", "<div>" * 3000 + "x" + "</div>" * 10)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = {r.page_id: r for r in html.page_texts(frame).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[99].text == "" and got[100].text == "x"
    assert html.page_texts(frame.limit(0)).count() == 0
    again = [(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, "<p>a b</p>")]
    found = [tuple(r) for r in html.page_texts(spark.createDataFrame(again, "page_id long, url string, html string")).collect()]
    assert sorted(found, key=str) == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "a b", 3)], key=str)


_WAVES = np.exp(-2j * np.pi * np.outer(np.arange(192), np.arange(1, 97)) / 192)


def _naive_fingerprints(payload: bytes) -> list[int]:
    """Peaks of an ordinary Fourier transform, frame by frame, and their pairs."""
    spectra = []
    for at in range(0, len(payload) - 191, 96):
        frame = np.array([(b - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * k / 192)) for k, b in enumerate(payload[at : at + 192])])
        spectra.append(np.round(np.abs(frame @ _WAVES), 3))
    strongest = [(int(s.argmax()) + 1, float(s.max())) for s in spectra]
    peaks = []
    for t, (f, size) in enumerate(strongest):
        if (t == 0 or size > strongest[t - 1][1]) and (t + 1 == len(strongest) or size >= strongest[t + 1][1]):
            peaks.append((t, f))
    codes = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 4]:
            if u - t <= 63:
                codes.append(t << 20 | f << 13 | g << 6 | (u - t))
    return sorted(codes)


def test_spectrum_is_the_discrete_fourier_transform():
    rng = random.Random(3)
    payload = bytes(rng.randrange(32, 127) for _ in range(192 * 4))
    samples = np.frombuffer(payload, dtype=np.uint8)
    bins, size = media.spectral_peaks(samples, np.arange(0, len(samples) - 191, 96))
    for j, at in enumerate(range(0, len(samples) - 191, 96)):
        power = []
        for f in range(1, 97):
            angle = [2 * np.pi * f * k / 192 for k in range(192)]
            value = [(payload[at + k] - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * k / 192)) for k in range(192)]
            power.append(np.hypot(sum(v * np.cos(a) for v, a in zip(value, angle, strict=True)), sum(v * np.sin(a) for v, a in zip(value, angle, strict=True))))
        assert max(power) == pytest.approx(float(size[j]), rel=1e-4) and power[bins[j] - 1] == pytest.approx(max(power), rel=1e-4)


def test_media_round_trip_and_equal_texts(spark, docs, rows):
    got = {r.doc_id: r for r in media.media_column(docs).collect()}
    for doc, text, *_ in rows:
        r, data = got[doc], (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert media.from_wav(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        if len(payload) < 4000:
            assert list(r.fingerprints) == _naive_fingerprints(payload)
    equal = defaultdict(set)
    for doc, text, *_ in rows:
        equal[text or ""].add((got[doc].feature, got[doc].media_sha256))
    assert all(len(v) == 1 for v in equal.values())


def test_sections_add_up(spark, docs, rows):
    encode = tokens.encoder(tokens.vocabulary())
    got = defaultdict(list)
    for r in attribution.section_tokens(docs).collect():
        got[r.doc_id].append(r)
    for doc, text, *_ in rows:
        ids, starts, ends = encode.offsets(text or "")
        own = sorted(got[doc], key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(ids)
        want = Counter()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            shares = [(-(min(e, r.end) - max(s, r.start)), r.section) for r in own if r.start < e and s < r.end]
            want[min(shares)[1]] += 1
        assert {r.section: r.n_tokens for r in own if r.n_tokens} == dict(want)


def test_given_sections_and_gaps(spark):
    rows = [(1, "alpha beta gamma", [(7, 0, 6), (8, 10, 16)]), (2, "x y", []), (3, "x y", None), (4, None, [(1, 0, 0)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<section: long, start: long, end: long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in attribution.section_tokens(frame, sections="s").collect()}
    encode = tokens.encoder(tokens.vocabulary())
    total = len(encode.ids("alpha beta gamma"))
    assert sum(v for (d, _), v in got.items() if d == 1) == total
    assert got[2, -1] == got[3, -1] == 2 and got[4, 1] == 0
    with pytest.raises(ValueError):
        attribution.section_tokens(frame, rule="none")


def test_first_and_largest_rules_differ():
    begin, stop = np.array([0, 1]), np.array([1, 5])
    assert attribution.allocate(np.array([0]), np.array([4]), begin, stop)[0].tolist() == [1]
    assert attribution.allocate(np.array([0]), np.array([4]), begin, stop, "first")[0].tolist() == [0]


def _language(rng: random.Random, name: str) -> str:
    parts = {"en": ["th", "ing", "the", "wh", "ed"], "de": ["sch", "ung", "ein", "ö", "keit"], "fr": ["eau", "é", "que", "ion", "les"], "es": ["ción", "ñ", "ado", "ll", "os"]}[name]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))


def test_language_of_held_out_texts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(i, _language(rng, lang), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr", "es"], k=600))]
    rows += [(9000, None, "en"), (9001, "", "de"), (9002, "12 34 !!", "fr"), (9003, _language(rng, "en"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = {r.doc_id: r for r in langid.predict_language(docs, model).collect()}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[d].lang_pred == lang for d, _, lang in held]) > 0.97
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (9000, 9001, 9002)) and got[9003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict_language(docs, None).collect()} == {"und"}


def test_languages_are_predicted_machine_by_machine(spark):
    """Features counted with a dictionary, then the family's best margin and the votes of its pairs."""
    from pyspark.sql import functions as F
    from math import sqrt

    def features(text: bytes) -> list[float]:
        data, counts = text.translate(K.LOWER) + b"  ", Counter()
        for i in range(len(text)):
            pair = (data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA77) % 2**32
            follows = data[i + 2] if i + 2 < len(data) else 32
            for h in (pair, (pair * 0xC2B2AE3D + follows * 0x27D4EB2F) % 2**32):
                counts[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 21] += 1
        norm = sqrt(sum(counts.values())) or 1
        return [sqrt(counts[k]) / norm for k in range(langid.DIMENSIONS)]

    rng = random.Random(2)
    rows = [(i, _language(rng, lang), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr", "es"], k=200))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    more = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("score", "lang_pred", "x", "held_out")})
    again = langid.predict_language(more, langid.train(more))
    assert again.columns == ["doc_id", "lang_pred", "score"] and Counter(r.doc_id for r in again.collect()) == {r[0]: 2 for r in rows}
    some = [r[1].encode() for r in rows[:40]]
    x = np.array([[*features(t), 1.0] for t in some])
    assert np.allclose(langid.ngram_features(some), x[:, :-1])
    which, _ = model.predict(x[:, :-1])
    for row, got in zip(x, which.tolist(), strict=True):
        margins = [sum(a * b for a, b in zip(row, w, strict=True)) for w in model.top.tolist()]
        members = model.members[margins.index(max(margins))]
        votes = Counter({m: 0 for m in members})
        for (a, b), w in model.pairs.items():
            if a in members and b in members:
                votes[a if row @ w > 0 else b] += 1
        assert votes[got] == max(votes.values())


def test_features_don_t_depend_on_neighbours():
    one = langid.ngram_features([b"abc def"])
    assert np.allclose(langid.ngram_features([b"zz", b"abc def", b"", b"q"])[1], one[0])
    a = K.shingles(K.Words([b"a b c d e f", b"x"], lower=True))[0]
    b = K.shingles(K.Words([b"y z", b"a b c d e f"], lower=True))[0]
    assert set(a[:2].tolist()) == set(b[1:].tolist())


EMPTY = [
    (lambda s, d: minhash.near_duplicates(s, d)), (lambda s, d: repeats.find_repeats(s, d, DIGEST, repeats._digest)), (lambda s, d: rules.quality_rules(s, d)),
    (lambda s, d: packing.packed(s, d)), (lambda s, d: pieces.encoded(d)), (lambda s, d: media.media_column(d)), (lambda s, d: attribution.section_tokens(d)),
    (lambda s, d: langid.predict_language(d, langid.train(d))), (lambda s, d: quality.quality_scores(s, d, s.createDataFrame([], "doc_id long, quality int"))),
]


@pytest.mark.parametrize("n", range(len(EMPTY)))
def test_empty_tables_and_null_rows(spark, n):
    assert EMPTY[n](spark, spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (None, "some words here", "en", "s", 15), (2, "a\x00b", "en", "s", 3)]
    found = EMPTY[n](spark, spark.createDataFrame(odd, SCHEMA)).collect()
    # each of these texts is one piece and one section, so there is a row for each row: none is lost, none is made
    assert Counter(r.doc_id for r in found) == {None: 2, 1: 2, 2: 1}
