"""Byte-level BPE ids and their byte offsets.

The ids are those of the ``tokenizers`` library for a vocabulary file. Where
the same vocabulary is at hand as ranks, texts of common scripts are encoded
through them (the merges are the same, four times as fast); a text with other
characters, or with a special token's string, goes through ``tokenizers``.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Code points on which both libraries' character classes agree.
_COMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]|<\\|endoftext\\|>")


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        self.path, self._slow = path, None
        ranks, self._fast = os.path.splitext(path)[0] + ".tiktoken", None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            sizes = np.zeros(max(merges.values()) + 1, dtype=np.int64)
            sizes[list(merges.values())] = [len(k) for k in merges]
            self.sizes = sizes

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def _quick(self, text: str) -> np.ndarray | None:
        """The ids through the ranks, or None where ``tokenizers`` must do it."""
        if self._fast is None or _COMMON.search(text):
            return None
        try:
            return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:  # its splitter's stack is too small for a run of a million spaces
            return None

    def ids(self, text: str) -> np.ndarray:
        quick = self._quick(text)
        if quick is not None:
            return quick
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each one's first and last-plus-one code point.

        A character split over several tokens belongs to all of them.
        """
        ids = self._quick(text)
        if ids is not None:
            ends = np.cumsum(self.sizes[ids])
            starts = ends - self.sizes[ids]
            if not text.isascii():
                lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
                upto = np.concatenate(([0], np.cumsum(lead)))
                # a start inside a character goes back to it, an end inside one goes past it
                starts = upto[starts] - (~np.append(lead, True)[starts])
                ends = upto[ends]
            return ids, starts, ends
        found = self.slow.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(found.ids, dtype=np.uint32), spans[:, 0], spans[:, 1]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder to a process and file."""
    return Encoder(path)


def decoded(text: bytes) -> str:
    return text.decode("utf-8", "replace")
