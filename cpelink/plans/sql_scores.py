"""DuckDB SQL twins of the pair scores (oracle side only).

LCS is computed row by row with ``list_reduce``: row ``i`` of the DP table
is ``D[i][j] = max(D[i-1][j], D[i-1][k-1] + 1)`` where ``k`` is the last
position ``<= j`` of character ``a[i]`` in ``b`` (found with ``strpos`` on
the reversed prefix). Arguments are column names (scores are layered over
CTEs so expressions do not grow).
"""

from __future__ import annotations

D = "CAST({} AS DOUBLE)"


def lcs(a: str, b: str) -> str:
    pos = f"strpos(reverse(left({b}, j)), ch)"
    row = (f"list_transform(range(0, length({b}) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE "
           f"greatest(acc[j + 1], CASE WHEN {pos} > 0 THEN acc[j - {pos} + 1] + 1 ELSE 0 END) END)")
    init = f"list_transform(range(0, length({b}) + 1), lambda j: 0)"
    return f"list_reduce(string_split({a}, ''), lambda acc, ch: {row}, {init})[length({b}) + 1]"


def _intr(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS INTEGER)"


def _sim(m: str, la: str, lb: str) -> str:
    return f"(100.0 * ((2.0 * {D.format(m)}) / {D.format(f'({la}) + ({lb})')}))"


def ratio(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN {a} = {b} THEN 100 "
            f"ELSE {_intr(_sim(lcs(a, b), f'length({a})', f'length({b})'))} END)")


def _best_window(s: str, l: str) -> str:
    w = f"substr({l}, wi + 1, length({s}))"
    return f"list_max(list_transform(range(0, length({l}) - length({s}) + 1), lambda wi: {lcs(s, w)}))"


def partial_ratio(a: str, b: str) -> str:
    best = (f"(CASE WHEN length({a}) <= length({b}) THEN {_best_window(a, b)} "
            f"ELSE {_best_window(b, a)} END)")
    n = f"least(length({a}), length({b}))"
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN {a} = {b} THEN 100 "
            f"ELSE {_intr(_sim(best, n, n))} END)")


def proc(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"


def _toks(p: str) -> str:
    return f"list_filter(string_split({p}, ' '), lambda t: t <> '')"


def sorted_tokens(p: str) -> str:
    return f"array_to_string(list_sort({_toks(p)}), ' ')"


def set_parts(p1: str, p2: str) -> dict[str, str]:
    """sect / c12 / c21 strings of the token-set scores (p1, p2 processed)."""
    a, b = f"list_distinct({_toks(p1)})", f"list_distinct({_toks(p2)})"
    sect = f"array_to_string(list_sort(list_filter({a}, lambda t: list_contains({b}, t))), ' ')"
    d12 = f"array_to_string(list_sort(list_filter({a}, lambda t: NOT list_contains({b}, t))), ' ')"
    d21 = f"array_to_string(list_sort(list_filter({b}, lambda t: NOT list_contains({a}, t))), ' ')"
    return {"sect": sect, "c12": f"trim({sect} || ' ' || {d12})", "c21": f"trim({sect} || ' ' || {d21})"}


def token_set(p1: str, p2: str, sect: str, c12: str, c21: str, partial: bool) -> str:
    f = partial_ratio if partial else ratio
    return (f"(CASE WHEN {p1} = '' OR {p2} = '' THEN 0 ELSE "
            f"greatest({f(sect, c12)}, {f(sect, c21)}, {f(c12, c21)}) END)")


def stage_columns(a: str, b: str, prefix: str) -> tuple[str, str]:
    """Two SELECT-list fragments: processed strings, then sorted / set strings."""
    pa, pb = f"{prefix}pa", f"{prefix}pb"
    first = f"{proc(a)} AS {pa}, {proc(b)} AS {pb}"
    parts = set_parts(pa, pb)
    second = (f"{sorted_tokens(pa)} AS {prefix}sa, {sorted_tokens(pb)} AS {prefix}sb, "
              f"{parts['sect']} AS {prefix}sect, {parts['c12']} AS {prefix}c12, {parts['c21']} AS {prefix}c21")
    return first, second


def scores(a: str, b: str, prefix: str) -> dict[str, str]:
    """All seven scores over staged columns (see :func:`stage_columns`)."""
    pa, pb, sa, sb = (f"{prefix}{x}" for x in ("pa", "pb", "sa", "sb"))
    sect, c12, c21 = (f"{prefix}{x}" for x in ("sect", "c12", "c21"))
    ts = token_set(pa, pb, sect, c12, c21, partial=False)
    pts = token_set(pa, pb, sect, c12, c21, partial=True)
    lr = f"({D.format(f'greatest(length({pa}), length({pb}))')} / {D.format(f'least(length({pa}), length({pb}))')})"
    scale = f"(CASE WHEN {lr} > 8 THEN 0.6 ELSE 0.9 END)"
    tser = f"(CASE WHEN {pa} = {pb} THEN 100 ELSE {ts} END)"
    ptser = f"(CASE WHEN {pa} = {pb} THEN 100 ELSE {pts} END)"
    dbl = lambda x: D.format(x)
    weighted = (
        f"(CASE WHEN {pa} = '' OR {pb} = '' THEN 0 WHEN {lr} < 1.5 THEN "
        f"{_intr(f'greatest({dbl(ratio(pa, pb))}, {dbl(ratio(sa, sb))} * 0.95, {dbl(tser)} * 0.95)')} "
        f"ELSE {_intr(f'greatest({dbl(ratio(pa, pb))}, {dbl(partial_ratio(pa, pb))} * {scale}, ({dbl(partial_ratio(sa, sb))} * 0.95) * {scale}, ({dbl(ptser)} * 0.95) * {scale})')} END)"
    )
    return {
        "ratio": ratio(a, b),
        "partial": partial_ratio(a, b),
        "token_set": ts,
        "ptl_token_set": pts,
        "token_sort": ratio(sa, sb),
        "ptl_token_sort": partial_ratio(sa, sb),
        "weighted": weighted,
    }
