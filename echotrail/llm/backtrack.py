"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A word's segmentation by merges is the only one whose neighbouring tokens all
get along: two tokens do if the merges of their joined bytes leave them as
they are. So no merging is done. An Aho-Corasick automaton of the reversed
tokens gives the longest token that starts at each byte; the encoder takes it
if it gets along with the token before, else the next shorter prefix of it,
and goes back one token where none does. A byte from which no way led on is
marked and never entered again, so a word takes time linear in its length.
Whether two tokens get along is found from their merge trees (see
:meth:`Codec.fits`) and kept in a table.

Texts are cut at spaces that follow other than white space, where no word
reaches across; the ids of pieces and words are remembered by the process, up
to a number of them. The words of a batch that are new take their steps side by
side, as arrays; very long ones one by one. Decoding gathers each id's bytes
from one table by offset.

A null text is an empty one and has no ids. A text that isn't valid UTF-8 is
encoded with U+FFFD in place of the wrong bytes. Texts of any length are
encoded whole; a piece beyond LONGEST characters is not remembered. Equal texts
have equal ids: there are no ties, and repeated rows or rows without a doc_id
are rows like others. An empty table gives an empty one; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, slices, table, texts_of
from .tokens import decoded, vocabulary

#: Fixed value: the words of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces (and as many words) that a process remembers, and the characters a remembered one has at most.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes from which on a word takes its steps alone.
ALONE = 192
#: The pair table has twice as many places as entries at most, then it starts anew.
PAIRS = 1 << 20
_CUT = re.compile(r" (?<=\S )")
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def cut(text: str) -> list[str]:
    """The pieces of a text; each but the first had a space before it, which is left out.

    The cuts are at spaces behind anything but white space, so a word of
    ``WORDS`` (whose spaces come first) never reaches over one.
    """
    return _CUT.split(text)


class Decoder:
    """The bytes of each id of a vocabulary file, and nothing of its merges."""

    def __init__(self, path: str, spec: dict | None = None):
        if spec is None:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        id_of, n = spec["model"]["vocab"], 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * n
        for token, i in id_of.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.sizes = [len(b) for b in self.bytes_of]

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))

    @cached_property
    def blob(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids: run k is ids[bounds[k]:bounds[k + 1]]. Ids that the vocabulary hasn't got give nothing."""
        known = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(known, ids, 0).astype(np.int64)
        size = np.where(known, self.offsets[ids + 1] - self.offsets[ids], 0)
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - size), size)
        data, upto = self.blob[at].tobytes(), np.concatenate(([0], ends))[bounds].tolist()
        return [decoded(data[lo:hi]) for lo, hi in pairwise(upto)]


class Codec(Decoder):
    """Encoder and decoder of a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not (plain and splits and spec["normalizer"] is None and spec["post_processor"] is None):
            raise ValueError(f"{path} is no plain byte-level BPE")
        super().__init__(path, spec)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        odd = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd:
            raise ValueError(f"{path}: added tokens that take their surroundings along: {odd}")
        self._special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self._read_merges(model["merges"], model["vocab"], len(self.bytes_of))
        self._words, self._agreed, self._doubtful = regex.compile(WORDS), set(), set()
        self._piece_ids, self._word_ids, self._long = {}, {}, []
        self._new_pairs()

    def _read_merges(self, merges: list, id_of: dict[str, int], n: int) -> None:
        """The rank of each pair, and of each token its two parts and when it is made; then which tokens can come out at all."""
        self.rank, self.parts, self.made = {}, [None] * n, [-1] * n
        for rank, merge in enumerate(merges):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = id_of[a], id_of[b], id_of[a + b]
            if self.parts[whole] is not None:
                raise ValueError(f"{self.path}: token {whole} is made by two merges")
            self.rank[left << 32 | right] = rank
            self.parts[whole], self.made[whole] = (left, right), rank
        self._last, self._first = [None] * n, [None] * n
        kept = np.zeros(n, dtype=bool)
        singles = {self.bytes_of[i]: i for i in id_of.values() if self.sizes[i] == 1 and self.parts[i] is None}
        if len(singles) < 256:
            raise ValueError(f"{self.path} lacks some bytes")
        for i in sorted(id_of.values(), key=self.made.__getitem__):
            if self.parts[i] is None:
                kept[i] = self.sizes[i] == 1
                spine = (i,), (i,)
            else:
                left, right = self.parts[i]
                kept[i] = kept[left] and kept[right] and self._apart(left, right, self.made[i])
                spine = (*self._last[right], i), (*self._first[left], i)
            self._last[i], self._first[i] = spine
        self.id_of_bytes = {self.bytes_of[i]: int(i) for i in np.flatnonzero(kept)}
        self.shorter = [-1] * n
        for b, i in self.id_of_bytes.items():
            self.shorter[i] = next((t for k in range(len(b) - 1, 0, -1) if (t := self.id_of_bytes.get(b[:k])) is not None), -1)
        self._single = [self.id_of_bytes[bytes([b])] for b in range(256)]
        self._ends = ahocorasick.Automaton()
        for b, i in self.id_of_bytes.items():
            if len(b) > 1:
                self._ends.add_word(b[::-1].decode("latin-1"), i)
        self._ends.make_automaton()
        self._as_arrays = np.array(self.shorter), np.array(self.sizes), np.array(self._single)

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether tokens next to each other stay apart under all merges ranked below ``until``.

        Their own merges go on by rank on both sides; at each time the last
        part so far of ``a`` and the first of ``b`` touch. They stay apart if
        the pair that touches is never the next to be merged: a merge inside
        ``a`` of the same rank stands further left and comes first, one inside
        ``b`` comes after.
        """
        left, right = self._last[a], self._first[b]
        i = j = 0
        while True:
            grows_a = self.made[left[i + 1]] if i + 1 < len(left) else until
            grows_b = self.made[right[j + 1]] if j + 1 < len(right) else until
            rank = self.rank.get(left[i] << 32 | right[j], _NEVER)
            if rank < until and rank < grows_a and rank <= grows_b:
                return False
            if grows_a >= until and grows_b >= until:
                return True
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1

    def _new_pairs(self) -> None:
        self._keys, self._fits, self._known = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool), 0

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table: whether merging the bytes of both gives ``a`` and ``b``. Missing pairs are worked out."""
        most = PAIRS // 2
        if len(a) > most:
            return np.concatenate([self.fits(a[lo : lo + most], b[lo : lo + most]) for lo in range(0, len(a), most)])
        if self._known + len(a) > most:
            self._new_pairs()
        keys = a << 32 | b
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        wrong = np.flatnonzero(self._keys[slot] != keys)
        while len(wrong):
            new = wrong[self._keys[slot[wrong]] < 0]
            for i in new.tolist():
                at = slot[i]
                if self._keys[at] < 0:
                    self._keys[at], self._fits[at] = keys[i], self._apart(int(a[i]), int(b[i]))
                    self._known += 1
            wrong = wrong[self._keys[slot[wrong]] != keys[wrong]]
            slot[wrong] = (slot[wrong] + 1) & (PAIRS - 1)
            wrong = wrong[self._keys[slot[wrong]] != keys[wrong]]
        return self._fits[slot]

    def longest(self, words: bytes, bounds: list[int]) -> np.ndarray:
        """The longest token that starts at each byte and ends in its word; word k is words[bounds[k]:bounds[k + 1]]."""
        found, backwards = self._as_arrays[2][np.frombuffer(words, dtype=np.uint8)], words[::-1].decode("latin-1")
        ends = [len(words) - b for b in reversed(bounds)]
        spread = "\u0100".join(backwards[lo:hi] for lo, hi in pairwise(ends))  # no token has this character
        match = list(self._ends.iter(spread))
        match.reverse()
        first = dict(match)  # the longest match comes first, and so last here
        at = np.fromiter(first.keys(), dtype=np.int64, count=len(first))
        at -= np.searchsorted(np.array(ends[1:]) + np.arange(len(ends) - 1), at, side="right")  # separators before it
        found[len(words) - 1 - at] = np.fromiter(first.values(), dtype=np.int64, count=len(first))
        return found

    def segment(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words (none of them empty).

        All words take a step at a time: the candidate is taken if it ends at
        an open byte and gets along with the token before; if not, its next
        shorter prefix is the candidate; if there is none, the byte is closed
        and the token before is the candidate again, which now ends at a
        closed byte.
        """
        text, bounds = b"".join(words), np.concatenate(([0], np.cumsum([len(w) for w in words])))
        longest = np.append(self.longest(text, bounds.tolist()), -1)
        shorter, sizes, _ = self._as_arrays
        taken, before = np.full(len(text) + 1, -1, dtype=np.int64), np.full(len(text) + 1, -1, dtype=np.int64)
        closed = np.zeros(len(text) + 1, dtype=bool)
        at, end = bounds[:-1].copy(), bounds[1:]
        last, token = np.full(len(words), -1, dtype=np.int64), longest[at]
        while len(at):
            to = at + sizes[token]
            good = ~closed[to]
            ask = np.flatnonzero(good & (last >= 0))
            good[ask] = self.fits(last[ask], token[ask])
            back = ~good
            i = np.flatnonzero(good)
            here, now = at[i], token[i]
            before[here], taken[here] = last[i], now
            last[i], at[i], token[i] = now, to[i], longest[to[i]]
            i = np.flatnonzero(back)
            token[i] = shorter[token[i]]
            i = i[token[i] < 0]
            closed[at[i]] = True
            token[i] = last[i]
            at[i] -= sizes[last[i]]
            taken[at[i]] = -1
            last[i] = before[at[i]]
            on = at < end
            at, end, last, token = at[on], end[on], last[on], token[on]
        # what was taken on the way that led on: follow it from each word's start
        ids = taken[:-1]
        kept = self._reached(ids, sizes, bounds)
        out, upto = ids[kept].astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(kept)))[bounds] * 4
        return [out[lo:hi] for lo, hi in pairwise(upto.tolist())]

    def walk(self, word: bytes) -> bytes:
        """The packed ids of one long word, by the same steps as in ``segment``."""
        longest, shorter, sizes = self.longest(word, [0, len(word)]).tolist(), self.shorter, self.sizes
        n, at, ids, closed, pairs = len(word), 0, [], bytearray(len(word) + 1), {}
        token = longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0:
                if not closed[at + sizes[token]]:
                    key = last << 32 | token
                    good = last < 0 or pairs.get(key)
                    if good is None:
                        good = pairs[key] = self._apart(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                token = longest[at] if at < n else -1
            else:
                closed[at] = 1
                token = ids.pop()
                at -= sizes[token]
        return np.array(ids, dtype="<u4").tobytes()

    @staticmethod
    def _reached(ids: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        kept, at, end = np.zeros(len(ids), dtype=bool), bounds[:-1], bounds[1:]
        while len(at):
            kept[at] = True
            at = at + sizes[ids[at]]
            on = at < end
            at, end = at[on], end[on]
        return kept

    def packed_words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of words, remembered ones included; the dictionary is the memory itself, valid until the next call."""
        memory, new = self._word_ids, []
        if len(memory) > REMEMBERED:
            memory.clear()
        for w in dict.fromkeys(words):
            if w not in memory:
                data = w.encode()
                whole = self.id_of_bytes.get(data)
                if whole is not None:
                    memory[w] = whole.to_bytes(4, "little")
                elif len(data) > ALONE:
                    memory[w] = self.walk(data)
                    self._long.append((memory, w))
                else:
                    new.append((w, data))
        for lo, hi in slices([d for _, d in new], 1 << 18):
            for (w, _), ids in zip(new[lo:hi], self.segment([d for _, d in new[lo:hi]]), strict=True):
                memory[w] = ids
        return memory

    def forget_long(self) -> None:
        """Forget long pieces and words: a text of one piece would fill the memory."""
        for memory, key in self._long:
            memory.pop(key, None)
        self._long = []

    def packed_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces with a space before each; the dictionary is the memory, valid until the next call."""
        memory = self._piece_ids
        if len(memory) > REMEMBERED:
            memory.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in memory]
        split = [self.words(" " + p) for p in new]
        flat = [w for ws in split for w in ws]
        ids = self.packed_words(flat)
        for p, ws in zip(new, split, strict=True):
            memory[p] = b"".join(map(ids.__getitem__, ws))
            if len(p) > LONGEST:
                self._long.append((memory, p))
        return memory

    @cached_property
    def library(self):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def words(self, piece: str) -> list[str]:
        """The words of a piece.

        ``regex`` and the library may know different versions of Unicode, so a
        character outside ASCII is first tried with both, once; a piece with
        one that they class differently is split by the library.
        """
        if not piece.isascii():
            for c in set(piece) - self._agreed - self._doubtful:
                probe = f"a{c}a1{c}1!{c}! {c} "
                same = self._words.findall(probe) == self._by_library(probe)
                (self._agreed if same else self._doubtful).add(c)
            if self._doubtful and not self._doubtful.isdisjoint(piece):
                return self._by_library(piece)
        return self._words.findall(piece)

    def _by_library(self, piece: str) -> list[str]:
        return [piece[lo:hi] for _, (lo, hi) in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def packed(self, texts: list[str], special: bool = True) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers.

        ``special``: a special token's string stands for the token, as it does
        in the library unless it is told otherwise; else it is plain text.
        """
        parts = [self._parts(t, special) for t in texts]
        cuts = [[cut(p) for p in ps[::2]] for ps in parts]
        pieces = self.packed_pieces([p for cs in cuts for c in cs for p in c[1:]])
        firsts = [self.words(c[0]) for cs in cuts for c in cs]
        flat = [w for ws in firsts for w in ws]
        words, first, out = self.packed_words(flat), iter(firsts), []
        for ps, cs in zip(parts, cuts, strict=True):
            row = []
            for k, c in enumerate(cs):
                if k:
                    row.append(self.special[ps[2 * k - 1]].to_bytes(4, "little"))
                row += map(words.__getitem__, next(first))
                row += map(pieces.__getitem__, c[1:])
            out.append(b"".join(row))
        self.forget_long()
        return out

    def _parts(self, text: str, special: bool) -> list[str]:
        """The text around special tokens' strings, and these, in turn."""
        if special and self._special is not None and any(s in text for s in self.special):
            return self._special.split(text)
        return [text]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec to a process and file."""
    return Codec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encoded(docs: DataFrame, path: str | None = None, column: str = "text", packed: bool = True, special: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids of every row: packed as little-endian unsigned 32-bit integers, or as array<int>."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = texts_of(batch.column(1)), []
        for lo, hi in slices(texts, 1 << 21):
            rows += codec(path).packed([decoded(t) for t in texts[lo:hi]], special)
        sizes = np.array([len(r) // 4 for r in rows], dtype=np.int64)
        if packed:
            ids = pa.array(rows, pa.binary())
        else:
            flat = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat))
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

    return map_batches(docs, ["doc_id", column], run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decoded_texts(ids: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (packed) with their decoded text."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = texts_of(batch.column(2)), []
        for lo, hi in slices(rows):
            bounds = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows[lo:hi]])))
            texts += decoder(path).decode(np.frombuffer(b"".join(rows[lo:hi]), dtype="<u4").astype(np.int64), bounds)
        return pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return map_batches(ids, ["doc_id", "n_tokens", "ids"], run, "doc_id long, n_tokens long, ids binary, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, then decoded; the columns are digests of both."""
    found = decoded_texts(encoded(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
