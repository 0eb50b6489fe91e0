"""The pair scores by their definition, one pair at a time; the reference that the batch kernel is tested against."""

from __future__ import annotations

import math
import re
from functools import cached_property, lru_cache

SCORE_FIELDS = ["ratio", "partial", "token_set", "ptl_token_set", "token_sort", "ptl_token_sort", "weighted"]

# letters, digits and the underscore of any script
_NON_WORD = re.compile(r"\W", re.UNICODE)


def intr(x: float) -> int:
    return int(math.floor(x + 0.5))


@lru_cache(maxsize=1 << 16)
def lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, O(|a|*|b|/w))."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if a == b:
        return 100
    return intr(100 * (2.0 * lcs_len(a, b) / (len(a) + len(b))))


def partial_ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if a == b:
        return 100
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    n = len(s)
    if s in l:
        return 100
    best = 0
    for i in range(len(l) - n + 1):
        best = max(best, lcs_len(s, l[i:i + n]))
        if best == n:
            break
    return intr(100 * (2.0 * best / (n + n)))


def proc(s: str) -> str:
    return _NON_WORD.sub(" ", s).lower().strip()


def _sorted_tokens(p: str) -> str:
    return " ".join(sorted(p.split())).strip()


class PairScores:
    """The scores of one pair; each is computed when asked for, on shared intermediate strings."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b

    @cached_property
    def processed(self) -> tuple[str, str]:
        return proc(self.a), proc(self.b)

    @cached_property
    def ordered(self) -> tuple[str, str]:
        p1, p2 = self.processed
        return _sorted_tokens(p1), _sorted_tokens(p2)

    @cached_property
    def sets(self) -> tuple[str, str, str]:
        """Shared tokens; shared and only the first's; shared and only the second's."""
        p1, p2 = self.processed
        t1, t2 = set(p1.split()), set(p2.split())
        both = " ".join(sorted(t1 & t2))
        return both, f"{both} {' '.join(sorted(t1 - t2))}".strip(), f"{both} {' '.join(sorted(t2 - t1))}".strip()

    def _over_sets(self, f) -> int:
        if not all(self.processed):
            return 0
        both, c12, c21 = self.sets
        return max(f(both, c12), f(both, c21), f(c12, c21))

    @cached_property
    def ratio(self) -> int:
        return ratio(self.a, self.b)

    @cached_property
    def partial(self) -> int:
        return partial_ratio(self.a, self.b)

    @cached_property
    def token_set(self) -> int:
        return self._over_sets(ratio)

    @cached_property
    def ptl_token_set(self) -> int:
        if all(self.processed) and self.sets[0]:
            return 100  # the shared tokens stand in either string
        return self._over_sets(partial_ratio)

    @cached_property
    def token_sort(self) -> int:
        return ratio(*self.ordered)

    @cached_property
    def ptl_token_sort(self) -> int:
        return partial_ratio(*self.ordered)

    @cached_property
    def weighted(self) -> int:
        p1, p2 = self.processed
        if not p1 or not p2:
            return 0
        base, same = ratio(p1, p2), p1 == p2
        longer = float(max(len(p1), len(p2))) / min(len(p1), len(p2))
        if longer < 1.5:
            return intr(max(base, self.token_sort * 0.95, (100 if same else self.token_set) * 0.95))
        scale = 0.6 if longer > 8 else 0.9
        return intr(max(base, partial_ratio(p1, p2) * scale, self.ptl_token_sort * 0.95 * scale,
                        (100 if same else self.ptl_token_set) * 0.95 * scale))


def all_scores(a, b) -> tuple:
    """All scores of a pair in the order of SCORE_FIELDS; nulls for a null side."""
    if a is None or b is None:
        return (None,) * len(SCORE_FIELDS)
    s = PairScores(a, b)
    return tuple(getattr(s, f) for f in SCORE_FIELDS)


def token_set(a: str, b: str) -> int:
    return PairScores(a, b).token_set


def partial_token_set(a: str, b: str) -> int:
    return PairScores(a, b).ptl_token_set


def token_sort(a: str, b: str) -> int:
    return PairScores(a, b).token_sort


def partial_token_sort(a: str, b: str) -> int:
    return PairScores(a, b).ptl_token_sort


def weighted(a: str, b: str) -> int:
    return PairScores(a, b).weighted
