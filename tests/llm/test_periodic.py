import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from cpelink.llm import periodic as P


def runs_of(w):
    """Every run by looking at every period: (start, length, period)."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j + p), p)  # periods rise, so the first is the smallest
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def tiled(w):
    """The tiles of one word list, solved and stitched without Spark."""
    parts = {}
    for t in P.tiles(P.word_ids(w)):
        for p, lo, hi in P.solve(*t):
            parts.setdefault(p, []).append((lo, hi))
    out = []
    for p, some in parts.items():
        lo, hi = None, -1
        for a, b in [*sorted(some), (1 << 60, 0)]:
            if lo is None or a > hi:
                if lo is not None:
                    out.append((lo, hi + p - lo, p))
                lo, hi = a, b
            hi = max(hi, b)
    return sorted(x for x in out if x[1] >= max(24, 3 * x[2]))


def report_of(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and w:
            g, old = h // 10, list(w)
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [old[i] if i < a else old[a + (i - a) % p] for i in range(len(w))]
        runs = runs_of(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        out.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(), len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_every_run(seed):
    rnd, found = random.Random(seed), 0
    for _ in range(150):
        k, n = rnd.choice([1, 2, 3, 5, 50]), rnd.randint(0, 300)
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 30:
                a = rnd.randrange(n)
                p, long = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(0, n - a)
                w[a:a + long] = (w[a:a + p] * (long // p + 1))[:long]
                if rnd.random() < .3:
                    w[rnd.randrange(n)] = b"x"
        want = runs_of(w)
        found += len(want)
        assert tiled(w) == want
    assert found > 20


def test_lengths_and_periods_at_the_limits():
    base = [b"w%d" % i for i in range(200)]
    for p in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64):
        least = max(24, 3 * p)
        for long in (least - 1, least, least + 1):
            for before in (0, 1, 8, 13):
                w = base[100:100 + before] + (base[:p] * (long // p + 1))[:long] + [b"end"]
                assert tiled(w) == runs_of(w) == ([(before, long, p)] if long >= least else [])


def test_z_function():
    rnd = random.Random(3)
    for _ in range(100):
        s = [rnd.randrange(2) for _ in range(rnd.randint(0, 40))]
        assert P.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_report_over_hard_rows(make_docs, hard_texts):
    rnd = random.Random(4)
    line = " ".join("t%d" % rnd.randrange(99) for _ in range(40))
    rows = [(i, t) for i, t, _ in hard_texts]
    rows += [(1000 + k, f"{line} " * k + "rest of it " * 9 + f"{line}\n" * 4) for k in range(40)]
    rows += [(77, "the same row " * 30)] * 3 + [(None, "a b c d " * 20), (88, "x " * 3000), (89, "x " * 23), (90, "x " * 24)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and t)
    got = P.run_report(make_docs([(i, t, "en") for i, t in rows]))
    assert got.columns == [c.split()[0] for c in P.SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == report_of(rows)


def test_report_of_nothing(make_docs):
    assert P.run_report(make_docs([])).collect() == []
