"""Byte-level BPE encoding inside tasks.

The vocabulary file is a parameter: a path that every node has, or by default
the public 50k byte-level vocabulary that the ``public_tokenizers`` package of
the node names. Texts are encoded with the rank form of the vocabulary, which
gives the same ids as its ``tokenizers`` form at about four times the speed;
texts with an extremely long run without a break go to the ``tokenizers`` form,
whose merge step does not grow with the square of the run. The added tokens of the
``tokenizers`` form, such as ``<|endoftext|>``, are matched inside texts as there:
the text around them is encoded piece by piece.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

RANKS = "byte_bpe_50k.tiktoken"
MERGES = "byte_bpe_50k.json"
#: The vocabulary's rule for pieces, and the same rule without backtracking (fixed values).
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_QUICK_RULE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_STEP = 1500
_LONG_RUN = re.compile(r"\S{3000}|\s{3000}")


def _path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def has_long_run(text: str) -> bool:
    """Whether 3000 characters or more in a row are all white space or all not.

    Such a run covers a whole aligned piece of half its length, so one look at
    each piece rules nearly all texts out.
    """
    pieces = (text[k:k + _STEP] for k in range(0, len(text) - _STEP + 1, _STEP))
    return any(x.isspace() or len(x.split(None, 1)) == 1 for x in pieces) and bool(_LONG_RUN.search(text))


class Encoder:
    """``ids(text)`` as a uint32 array, and lookup tables over the vocabulary."""

    def __init__(self, ranks: str, merges: str):
        import public_tokenizers
        import tiktoken
        with open(_path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rule = public_tokenizers.PATTERN
        self._fast = tiktoken.Encoding("ranks", pat_str=_QUICK_RULE if rule == _RULE else rule, mergeable_ranks=table,
                                       special_tokens={})
        self._merges, self._slow = merges, None
        with open(_path(merges), encoding="utf-8") as f:
            added = [t for t in json.load(f).get("added_tokens", ()) if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on the text beside them are not supported")
        self._added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        size = max([*table.values(), *self._added.values()]) + 2
        self.ends_sentence = np.zeros(size, bool)   # . ! ? at the end, quotes and brackets aside
        self.ends_line = np.zeros(size, bool)
        self.starts_space = np.zeros(size, bool)
        for piece, i in table.items():
            self.ends_sentence[i] = piece.rstrip(b"\"')]").endswith((b".", b"!", b"?", "…".encode(), "。".encode()))
            self.ends_line[i] = piece.endswith(b"\n")
            self.starts_space[i] = piece[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        if not any(x in text for x in self._added):
            return self._plain(text)
        pieces = [np.array([self._added[x]], np.uint32) if k % 2 else self._plain(x)
                  for k, x in enumerate(self._split.split(text))]
        return np.concatenate(pieces)

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        if not has_long_run(text):
            return np.asarray(self._fast.encode_to_numpy(text), dtype=np.uint32)
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(_path(self._merges))
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS, merges: str = MERGES) -> Encoder:
    """One per Python worker."""
    return Encoder(ranks, merges)
