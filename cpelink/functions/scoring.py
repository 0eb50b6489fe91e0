"""Fuzzy pair scores (0..100 ints) and the native version gate.

Scores are defined on insert/delete similarity: ``ratio(a, b)`` is
``intr(100 * 2 * LCS(a, b) / (|a| + |b|))`` with ``intr(x) = floor(x + 0.5)``.
``partial_ratio`` takes the best full-length window of the longer string.
The token variants work on ``proc``-essed strings (non-word chars -> blank,
lower-case, trimmed). ``weighted`` combines them like the usual "WRatio".

Spark prepares the strings: processed, sorted by token, split into shared and
own tokens, all with built-in expressions. One Arrow-batched pandas UDF then
computes the scores that a query asks for, a whole batch at once and without a
loop over pairs: every comparison of the batch (two strings, whole or partial)
is numbered once, the distinct ones go through a bit-parallel LCS in numpy
whose lanes are the pairs. A character of the shorter string is a bit, of a few
64-bit words where it is long; a step takes one character of the longer string,
in all pairs, and for ``partial`` in all windows of it, at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import normalize as N

SCORE_FIELDS = [
    "ratio", "partial", "token_set", "ptl_token_set",
    "token_sort", "ptl_token_sort", "weighted",
]

#: Prepared strings that a score needs beside the pair itself.
_NEEDS = {
    "ratio": (), "partial": (), "token_set": ("sets",), "ptl_token_set": ("sets",), "token_sort": ("sorted",),
    "ptl_token_sort": ("sorted",), "weighted": ("processed", "sorted", "sets"),
}
#: Characters compared at a time; bounds the memory of a batch.
_CELLS = 1 << 22


# --- the kernel ---------------------------------------------------------------------

def _codes(strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code points, one row a string; what lies beyond its end means nothing."""
    width = max(int(sizes.max(initial=0)), 1)
    return strings.astype(f"U{width}").view(np.uint32).reshape(len(strings), width)


def _padded(short: np.ndarray, n: np.ndarray, long: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' codes, in single bytes where they fit, with paddings that match nothing."""
    narrow = max(int(short.max(initial=0)), int(long.max(initial=0))) < 254
    kind, pads = (np.uint8, (254, 255)) if narrow else (np.uint32, (0x110000, 0x110001))
    short, long = short.astype(kind), long.astype(kind)
    for codes, sizes, pad in ((short, n, pads[0]), (long, size, pads[1])):
        codes[np.arange(codes.shape[1]) >= sizes[:, None]] = pad
    return short, long


def _matches(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """(position of long, word, pair): a bit for each position of ``short`` that holds the same character."""
    pairs, n = short.shape
    words = -(-n // 64)
    bits = np.packbits(long[:, :, None] == short[:, None, :], axis=2, bitorder="little")
    whole = np.zeros((pairs, long.shape[1], words * 8), np.uint8)
    whole[:, :, :bits.shape[2]] = bits
    return np.ascontiguousarray(whole.view("<u8").transpose(1, 2, 0))


def _advance(v: np.ndarray, match: np.ndarray) -> None:
    """One step of the bit-parallel LCS; ``v`` is (word, ...), its cleared bits count the subsequence."""
    u = v & match
    total = v + u
    carry = total < u
    for w in range(1, len(v)):
        with_carry = total[w] + carry[w - 1]
        carry[w] |= with_carry < total[w]
        total[w] = with_carry
    v -= u
    v |= total


def _cleared(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)


def _whole(match: np.ndarray) -> np.ndarray:
    """LCS of each pair."""
    v = np.full(match.shape[1:], ~np.uint64(0))
    for m in match:
        _advance(v, m)
    return _cleared(v)


def _windowed(match: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best LCS of each pair's shorter string (``n`` characters) with a window as long of the longer (``size``)."""
    windows = int((size - n).max()) + 1
    v = np.full((match.shape[1], windows, match.shape[2]), ~np.uint64(0))
    for k in range(int(n.max())):
        m = match[k:k + windows].transpose(1, 0, 2)
        if len(match) < k + windows:    # windows that begin too late for this step are no windows of their pair
            m = np.concatenate((m, np.zeros((m.shape[0], k + windows - len(match), m.shape[2]), m.dtype)), axis=1)
        _advance(v, np.where(k < n, m, np.uint64(0)))
    best = _cleared(v)
    best[np.arange(windows)[:, None] > size - n] = 0
    return best.max(axis=0)


def _parts(n: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs in groups of like lengths, none with more than ``_CELLS`` cells unless it is a single pair."""
    order = np.lexsort((size, -(-n // 8)))
    begin = 0
    while begin < len(order):
        end, widest, longest = begin, 0, 0
        while end < len(order):
            # look ahead in steps that double: the bound must hold for the group's largest lengths
            ahead = min(len(order), begin + max(1, 2 * (end - begin)))
            w = max(widest, int(n[order[end:ahead]].max()))
            g = max(longest, int(size[order[end:ahead]].max()))
            if end > begin and ((ahead - begin) * w * g > _CELLS or w > 2 * widest + 8 or g > 2 * longest + 16):
                break
            end, widest, longest = ahead, w, g
        yield order[begin:end]
        begin = end


def lcs_lengths(a: np.ndarray, b: np.ndarray, partial: bool) -> np.ndarray:
    """LCS lengths of pairs of non-empty strings; with ``partial`` the best over windows of the longer string."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    swap = size_a > size_b
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    n, size = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    out = np.zeros(len(a), np.int64)
    for some in _parts(n, size):
        match = _matches(*_padded(_codes(short[some], n[some]), n[some], _codes(long[some], size[some]), size[some]))
        out[some] = _windowed(match, n[some], size[some]) if partial else _whole(match)
    return out


def _percent(twice: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.floor(100 * (twice / total) + 0.5).astype(np.int64)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


class _Batch:
    """The comparisons of a batch: the distinct pairs of strings of a request are compared once, and only where it needs them."""

    def __init__(self, strings: dict[str, pd.Series]):
        names = list(strings)
        codes, values = pd.factorize(pd.concat([strings[k] for k in names], ignore_index=True).fillna(""))
        self.values = np.asarray(values, object)
        self.code = dict(zip(names, codes.reshape(len(names), -1)))
        self.size = np.fromiter(map(len, self.values), np.int64, len(self.values))
        self.done: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _compare(self, x: str, y: str, partial: bool, where: np.ndarray | None) -> np.ndarray:
        """Scores of two columns' strings, right where ``where`` holds; what was compared before is not compared again."""
        a, b = self.code[x], self.code[y]
        some = (a != b) & (self.size[a] > 0) & (self.size[b] > 0)
        if (x, y, partial) not in self.done:
            self.done[x, y, partial] = np.where((a == b) & (self.size[a] > 0), 100, 0), ~some
        out, known = self.done[x, y, partial]
        todo = ~known if where is None else where & ~known
        if todo.any():
            pairs, back = np.unique(np.minimum(a, b)[todo] * len(self.values) + np.maximum(a, b)[todo], return_inverse=True)
            i, j = pairs // len(self.values), pairs % len(self.values)
            lcs = lcs_lengths(self.values[i], self.values[j], partial)
            n, m = self.size[i], self.size[j]
            shorter = np.minimum(n, m)
            out[todo] = (_percent(2.0 * lcs, shorter + shorter) if partial else _percent(2.0 * lcs, n + m))[back]
            known |= todo
        return out

    def ratio(self, x: str, y: str, where: np.ndarray | None = None) -> np.ndarray:
        return self._compare(x, y, False, where)

    def partial(self, x: str, y: str, where: np.ndarray | None = None) -> np.ndarray:
        return self._compare(x, y, True, where)

    def over_sets(self, compare, where: np.ndarray | None = None) -> np.ndarray:
        """Best of shared tokens, shared and the first's own, shared and the second's own; 0 where a side has no token."""
        best = np.maximum(np.maximum(compare("both", "first", where), compare("both", "second", where)),
                          compare("first", "second", where))
        return np.where((self.size[self.code["p1"]] > 0) & (self.size[self.code["p2"]] > 0), best, 0)

    def token_set(self, where: np.ndarray | None = None) -> np.ndarray:
        return self.over_sets(self.ratio, where)

    def ptl_token_set(self, where: np.ndarray | None = None) -> np.ndarray:
        shared = self.size[self.code["both"]] > 0           # they stand in either string
        open_ = ~shared if where is None else where & ~shared
        return np.where(shared, 100, self.over_sets(self.partial, open_))

    def weighted(self) -> np.ndarray:
        n1, n2 = self.size[self.code["p1"]], self.size[self.code["p2"]]
        some = (n1 > 0) & (n2 > 0)
        base, same = self.ratio("p1", "p2"), self.code["p1"] == self.code["p2"]
        longer = np.maximum(n1, n2) / np.maximum(np.minimum(n1, n2), 1)
        near, far = some & (longer < 1.5), some & (longer >= 1.5)
        whole = np.maximum(self.ratio("o1", "o2", near) * 0.95, np.where(same, 100, self.token_set(near)) * 0.95)
        scale = np.where(longer > 8, 0.6, 0.9)
        part = np.maximum(np.maximum(self.partial("p1", "p2", far) * scale, self.partial("o1", "o2", far) * 0.95 * scale),
                          np.where(same, 100, self.ptl_token_set(far)) * 0.95 * scale)
        return np.where(some, _rounded(np.maximum(base, np.where(longer < 1.5, whole, part))), 0)

    def score(self, field: str) -> np.ndarray:
        if field in ("ratio", "partial"):
            return getattr(self, field)("a", "b")
        if field in ("token_sort", "ptl_token_sort"):
            return (self.ratio if field == "token_sort" else self.partial)("o1", "o2")
        return getattr(self, field)()


def batch_scores(strings: dict[str, pd.Series], fields: tuple[str, ...]) -> pd.DataFrame:
    """The named scores of a batch of prepared pairs; null where a or b is."""
    missing = np.asarray(strings["a"].isna() | strings["b"].isna())
    if not len(missing):
        return pd.DataFrame({f: pd.array([], "Int32") for f in fields})
    batch = _Batch(strings)
    return pd.DataFrame({f: pd.arrays.IntegerArray(batch.score(f).astype(np.int32), missing) for f in fields})


# --- columns --------------------------------------------------------------------------

def _prepared(a: Column, b: Column, fields: tuple[str, ...]) -> tuple[Column, tuple[str, ...]]:
    """A struct of the strings that the scores compare, by built-in expressions, and its field names."""
    needs = {x for f in fields for x in _NEEDS[f]}
    if not needs:
        return F.struct(a.alias("a"), b.alias("b")), ("a", "b")

    def joined(tokens: Column) -> Column:
        return F.array_join(F.sort_array(tokens), " ")

    def strings(p: Column) -> Column:
        t1, t2 = (F.array_remove(F.split(p[k], " "), "") for k in ("p1", "p2"))
        out = {"a": a, "b": b, "p1": p["p1"], "p2": p["p2"]}
        if "sorted" in needs:
            out |= {"o1": joined(t1), "o2": joined(t2)}
        if "sets" in needs:
            both = joined(F.array_intersect(t1, t2))
            out |= {"both": both} | {k: F.trim(F.concat(both, F.lit(" "), joined(F.array_except(x, y))))
                                     for k, x, y in (("first", t1, t2), ("second", t2, t1))}
        return F.struct(*[c.alias(k) for k, c in out.items()])

    # the processed strings are bound to a variable, so that their patterns run once a row
    whole = N.let(F.struct(N.proc(a).alias("p1"), N.proc(b).alias("p2")), strings)
    names = ["a", "b", "p1", "p2", *(["o1", "o2"] if "sorted" in needs else []), *(["both", "first", "second"] if "sets" in needs else [])]
    return whole, tuple(names)


@lru_cache(maxsize=None)
def _pair_scores_udf(fields: tuple[str, ...], names: tuple[str, ...]):
    """A UDF that computes the named scores only, from the prepared strings."""
    schema = T.StructType([T.StructField(f, T.IntegerType()) for f in fields])

    @F.pandas_udf(schema)
    def udf(strings: pd.DataFrame) -> pd.DataFrame:
        return batch_scores({k: strings[k] for k in names}, fields)

    # Scores are pure functions, but they are declared non-deterministic so the
    # optimizer never pushes a filter on a score below the de-duplication of
    # string pairs (it would re-run the scorer on every pre-distinct row).
    return udf.asNondeterministic()


def pair_scores(a, b, fields: list[str] | None = None) -> Column:
    """struct of the named scores, all of SCORE_FIELDS by default."""
    ship_package()
    fields = tuple(fields or SCORE_FIELDS)
    strings, names = _prepared(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, fields)
    return _pair_scores_udf(fields, names)(strings)


def pair_ratio(a, b) -> Column:
    """struct<ratio, partial> only (for version strings)."""
    return pair_scores(a, b, ["ratio", "partial"])


def version_gate(release, version) -> Column:
    """True when the pair survives the version rule.

    Either side '-' passes. Otherwise ``ratio >= 90 and partial_ratio == 100``,
    which for these scores is: the shorter string is contained in the longer
    one (so LCS = shorter length) and ``intr(200*m/(m+n)) >= 90``.
    """
    r = F.col(release) if isinstance(release, str) else release
    v = F.col(version) if isinstance(version, str) else version
    m = F.least(F.char_length(r), F.char_length(v))
    n = F.greatest(F.char_length(r), F.char_length(v))
    shorter = F.when(F.char_length(r) <= F.char_length(v), r).otherwise(v)
    longer = F.when(F.char_length(r) <= F.char_length(v), v).otherwise(r)
    close = F.floor(F.lit(100.0) * (F.lit(2.0) * m / (m + n)) + F.lit(0.5)) >= 90
    ok = (r == v) | ((m > 0) & longer.contains(shorter) & close)
    return (r == F.lit("-")) | (v == F.lit("-")) | ok
