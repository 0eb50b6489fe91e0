"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers, so the scatter matrix n * sum(x x^T) - S S^T, which is n^2
times the covariance, is known exactly. Its eigenvalues are found without floating point:

1. Tasks add up counts, sums and products of their vectors (matrix products of limbs
   small enough to be exact in double), the parts are summed by key as 32-bit limbs.
2. The characteristic polynomial is computed modulo many 31-bit primes, a set of primes
   per task: reduction to Hessenberg form by similarity, then the recurrence over its
   leading blocks. Its coefficients are, but for the sign, the elementary symmetric
   functions of the eigenvalues, which are not negative and bounded by Maclaurin's
   inequality; Chinese remainders give them back exactly.
3. All roots are real, so the sign variations of the polynomial shifted to ``a`` count
   the roots beyond ``a`` exactly, with multiplicity. Bisection over integers isolates
   the roots and refines them to ``DIGITS`` bits; roots that stay together are a multiple one.
4. Each component comes from two steps of inverse iteration on the null space of
   scatter - root, in fixed-point integers of a few hundred bits, as many start vectors
   as the root has multiplicity, made orthonormal.
5. Tasks project the centred vectors. The error of the whitened covariance against the
   identity is measured from the projections in a pass of its own.

What passes through the driver is of the size of the matrix, whatever the table's.

Defined cases: a null vector, one with null or non-finite entries, or one without entries
is dropped, as are vectors of another length than most have (of two lengths met as
often, the longer counts); entries beyond 2^62 / 64 count as that bound; a null id is
returned as null; rows that repeat an id or a whole row are vectors of their own, in the
fit and in the result; vectors are whole whatever their length; a direction without
variance has no component, so fewer than 32 may come out, none of them for an empty
table or for equal vectors; a deviation that no long can hold is null; columns beside
id and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: Entries become floor(SCALE * c) + SHIFT; the shift changes sums only (fixed values of the contract).
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Relative precision of the roots in bits, and what the fixed point of inverse iteration has beyond it.
DIGITS, GUARD = 112, 160
_LIMB = 20
_ROWS = 1 << 12          # rows whose limb products add up exactly in double: 2^(20 + 20 + 12)
_MOST = 2.0 ** 62
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, eigenvalue double")


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, y): the vectors that count, as integers without the shift."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    y = F.transform(v, lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-_MOST)), F.lit(_MOST))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), y.alias("y"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a batch."""
    col = batch.column("y")
    offsets, flat = np.asarray(col.offsets), np.asarray(col.values)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as a sum of limbs times powers of 2^20, the highest one signed; one limb where products stay exact anyway."""
    parts = []
    while int(np.abs(y).max(initial=0)) >= 1 << _LIMB:
        parts.append((y & ((1 << _LIMB) - 1)).astype(np.float64))
        y = y >> _LIMB
    return [*parts, y.astype(np.float64)]


def products(y: np.ndarray) -> np.ndarray:
    """y^T y as Python integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for k in range(0, len(y), _ROWS):
        limbs = _limbs(y[k:k + _ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, limb, value) of a partition: products at (i, j), sums at (i, -1), the count at (-1, -1)."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, y in _matrices(batch):
            d = y.shape[1]
            n, s, m = held.get(d, (0, np.zeros(d, object), np.zeros((d, d), object)))
            each = [int(x) for x in (y & 0xFFFFFFFF).sum(axis=0)]
            upper = [int(x) << 32 for x in (y >> 32).sum(axis=0)]
            held[d] = [n + len(y), s + np.array(each, object) + np.array(upper, object), m + products(y)]
    rows = []
    for d, (n, s, m) in held.items():
        values = [(-1, -1, n), *((i, -1, s[i]) for i in range(d)), *((i, j, m[i, j]) for i in range(d) for j in range(i, d))]
        for i, j, v in values:
            limb, v = 0, int(v)
            while not -2 ** 31 <= v < 2 ** 31:
                rows.append((d, i, j, limb, v & 0xFFFFFFFF))
                limb, v = limb + 1, v >> 32
            rows.append((d, i, j, limb, v))
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "i", "j", "limb", "value"]).astype(
            {"dim": "int32", "i": "int32", "j": "int32", "limb": "int32", "value": "int64"}), preserve_index=False)


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """(n, sums, n * products - sums sums^T) over the vectors of the commonest length; None without vectors."""
    sums = materialize(vectors.select("y").mapInArrow(_sums, "dim int, i int, j int, limb int, value long")
                       .groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")), "scatter_sums")
    counts: dict[int, int] = {}
    for r in sums.where("i = -1").collect():
        counts[r.dim] = counts.get(r.dim, 0) + (r.value << 32 * r.limb)
    if not counts:
        return None
    d = max(counts, key=lambda k: (counts[k], k))
    n, s, m = counts[d], [0] * d, np.zeros((d, d), object)
    for r in sums.where((F.col("dim") == d) & (F.col("i") >= 0)).collect():
        if r.j < 0:
            s[r.i] += r.value << 32 * r.limb
        else:
            m[r.i, r.j] += r.value << 32 * r.limb
    m = m + np.triu(m, 1).T
    t = np.array(s, object)
    return n, s, n * m - np.outer(t, t)


# --- characteristic polynomial -------------------------------------------------

def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if p % 2 == 0:
        return p == 2
    d, r = p - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, p)
        if x in (1, p - 1) or a == p:
            continue
        for _ in range(r - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    found, size, p = [], 0.0, 2 ** 31 - 1
    while size <= bits:
        if _is_prime(p):
            found.append(p)
            size += 30.9
        p -= 2
    return found


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.ones_like(base)
    for bit in range(31):
        out = np.where((exponent >> bit) & 1, out * base % p, out)
        base = base * base % p
    return out


def polynomial_modulo(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo each prime, lowest power first; all primes side by side."""
    d, many = len(matrix), len(primes)
    h = np.stack([(matrix % int(p)).astype(np.int64) for p in primes])
    p = primes.astype(np.int64)
    p1, p2 = p[:, None], p[:, None, None]
    who = np.arange(many)
    for k in range(1, d - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        h[who, k], h[who, pivot] = h[who, pivot], h[who, k]
        h[who, :, k], h[who, :, pivot] = h[who, :, pivot], h[who, :, k]
        inverse = _power(h[:, k, k - 1], p - 2, p)            # 0 where the column is zero already
        u = h[:, k + 1:, k - 1] * inverse[:, None] % p1
        h[:, k + 1:] = (h[:, k + 1:] - u[:, :, None] * h[:, k, None, :]) % p2
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1:] * u[:, None, :] % p2).sum(axis=2)) % p1
    blocks = np.zeros((d + 1, many, d + 1), np.int64)
    blocks[0, :, 0] = 1
    for k in range(1, d + 1):
        at = blocks[k]
        at[:, 1:] = blocks[k - 1, :, :-1]
        at -= h[:, k - 1, k - 1, None] * blocks[k - 1] % p1
        chain = np.ones(many, np.int64)
        for i in range(k - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % p
            at -= (h[:, i - 1, k - 1] * chain % p)[:, None] * blocks[i - 1] % p1
        at %= p1
    return blocks[d]


def symmetric_functions(matrix: np.ndarray, run: Callable[[list[int]], dict[int, list[int]]]) -> list[int]:
    """e_0 .. e_d of the eigenvalues of a matrix that has none below 0; ``run`` gives the polynomial modulo primes."""
    d, trace = len(matrix), int(np.trace(matrix))
    mean = trace // d + 1
    bits = max(comb(d, k).bit_length() + k * mean.bit_length() for k in range(d + 1)) + 1
    primes = primes_beyond(bits)
    residues = run(primes)
    e, modulus = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        for k in range(d + 1):
            r = residues[p][d - k] * (-1) ** k
            e[k] += modulus * ((r - e[k]) * inverse % p)
        modulus *= p
    return e


def _in_tasks(spark, matrix: np.ndarray) -> Callable[[list[int]], dict[int, list[int]]]:
    """Runs ``polynomial_modulo`` over sets of primes, one set per task."""
    def run(primes: list[int]) -> dict[int, list[int]]:
        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = np.array([primes[k] for k in b["id"]], np.int64)
                if len(own):
                    yield pd.DataFrame({"p": own, "c": list(polynomial_modulo(matrix, own))})

        sets = max(1, min(-(-len(primes) // 16), spark.sparkContext.defaultParallelism))
        found = spark.range(0, len(primes), 1, sets).mapInPandas(some, "p long, c array<long>").collect()
        return {r.p: r.c for r in found}
    return run


# --- roots -----------------------------------------------------------------------

def _beyond(c: list[int], a: int) -> int:
    """Roots greater than ``a``, with multiplicity, of a polynomial (highest power first) whose roots are all real."""
    c = list(c)
    for end in range(len(c), 1, -1):
        for k in range(1, end):
            c[k] += a * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(c: list[int], a: int) -> int:
    out = 0
    for x in c:
        out = out * a + x
    return out


def roots(e: list[int], wanted: int) -> tuple[list[tuple[int, int]], int]:
    """([(root * 2^s, multiplicity)], s): the largest positive roots, falling, ``wanted`` or more counted with multiplicity."""
    rank = max((k for k, x in enumerate(e) if x), default=0)
    if not rank:
        return [], 0
    least = (e[rank] << 64) // e[rank - 1] if rank else 0     # no positive root is below e_r / e_(r-1)
    s = max(0, DIGITS + 64 - least.bit_length() + 1)
    c = [(-1) ** k * x << s * k for k, x in enumerate(e[:rank + 1])]
    top = (e[1] << s) + 1                                    # the sum of all roots
    found, stack = [], [(0, top, rank, 0)]                   # roots in (lo, hi], counted beyond lo and hi
    while stack:
        lo, hi, n_lo, n_hi = stack.pop()
        if n_lo == n_hi or n_hi >= wanted:
            continue
        if n_lo - n_hi == 1 and _value(c, hi):
            above = _value(c, hi) > 0
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if (v := _value(c, mid)) == 0:
                    lo = hi = mid
                elif (v > 0) == above:
                    hi = mid
                else:
                    lo = mid
            found.append((hi, 1))
        elif hi - lo == 1:
            found.append((hi, n_lo - n_hi))
        else:
            mid = (lo + hi) // 2
            n_mid = _beyond(c, mid)
            stack += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]   # the upper half is taken first
    return found, s


# --- components --------------------------------------------------------------------

def _eliminate(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Solves a x = b in fixed point by elimination with row exchange; a vanishing pivot counts as one unit."""
    a, b, d = a.copy(), b.copy(), len(a)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]], b[[k, best]] = a[[best, k]], b[[best, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            m = (a[k + 1:, k] << bits) // a[k, k]
            a[k + 1:, k:] -= (m[:, None] * a[k, k:]) >> bits
            b[k + 1:] -= (m[:, None] * b[k]) >> bits
    x = np.zeros_like(b)
    for k in range(d - 1, -1, -1):
        rest = b[k] - ((a[k, k + 1:, None] * x[k + 1:]).sum(axis=0) >> bits if k + 1 < d else 0)
        x[k] = (rest << bits) // a[k, k]
    return x


def _orthonormal(x: np.ndarray, bits: int) -> np.ndarray:
    """Columns made orthogonal and of length one, in fixed point."""
    out = []
    for column in x.T:
        big = max(max(map(abs, column)), 1).bit_length()
        v = column << bits - big if bits >= big else column >> big - bits
        for _ in range(2):
            for u in out:
                v = v - ((u * (int((u * v).sum()) >> bits)) >> bits)
            v = (v << bits) // max(isqrt(int((v * v).sum())), 1)
        out.append(v)
    return np.array(out, object).T


def null_vectors(matrix: np.ndarray, root: int, s: int, many: int) -> list[list[float]]:
    """``many`` unit vectors of the null space of matrix - root / 2^s, as doubles; the largest entry of each is positive."""
    d = len(matrix)
    size = (int(np.trace(matrix)) << s).bit_length()
    bits = size + GUARD                    # a unit of the fixed point is far below a unit of the root
    lift = bits - size
    a = (matrix << (s + lift)) - np.diag(np.array([root << lift] * d, object))
    x = np.array([[((i + 1) * 0x9E3779B1 ** (j + 1) % 2003 - 1001) << bits - 12 for j in range(many)] for i in range(d)], object)
    for _ in range(2):
        x = _orthonormal(_eliminate(a, x, bits), bits)
    out = []
    for v in x.T:
        sign = 1 if max(v, key=abs) > 0 else -1
        out.append([sign * int(c) / (1 << bits) for c in v])
    return out


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: list[float]     # of the covariance, falling
    explained: list[float]
    components: np.ndarray       # one unit vector per row

    @property
    def weights(self) -> np.ndarray:
        return (self.components / np.sqrt(np.array(self.eigenvalues))[:, None]).T


def whitening_of(n: int, sums: list[int], matrix: np.ndarray, run=None, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of an exact scatter matrix; None without variance."""
    d = len(matrix)
    if not int(np.trace(matrix)):
        return None
    e = symmetric_functions(matrix, run or (lambda ps: dict(zip(ps, polynomial_modulo(matrix, np.array(ps)).tolist()))))
    found, s = roots(e, min(most, d))
    trace = int(np.trace(matrix))
    values, shares, vectors = [], [], []
    for root, many in found:
        vectors += null_vectors(matrix, root, s, many)
        values += [root / (n * n << s)] * many
        shares += [root / (trace << s)] * many
    return Whitening(n, sums, values[:most], shares[:most], np.array(vectors[:most]))


# --- projection ----------------------------------------------------------------------

def _centred(y: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """(y - S / n, exact sum of (n y - S)^2) of each row; None where no long can hold it."""
    most = max(w.n * int(np.abs(y).max(initial=0)), max(map(abs, w.sums)))
    if 2 * most < 2 ** 62:
        z = y * w.n - np.array(w.sums, np.int64)
        if int(np.abs(z).max(initial=0)) ** 2 * y.shape[1] < 2 ** 63:
            return z / w.n, (z * z).sum(axis=1).tolist()
    z = y.astype(object) * w.n - np.array(w.sums, object)
    squares = [int(x) for x in (z * z).sum(axis=1)]
    return (z / w.n).astype(np.float64), [x if x < 2 ** 63 else None for x in squares]


def _moments(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(w.eigenvalues)
        total, one = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            for _, y in _matrices(batch):
                if y.shape[1] == len(w.sums):
                    x = _centred(y, w)[0] @ w.weights
                    total += x.T @ x
                    one += x.sum(axis=0)
        i, j = np.triu_indices(m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((i, np.arange(m))), pa.int32()), pa.array(np.concatenate((j, np.full(m, -1))), pa.int32()),
             pa.array(np.concatenate((total[i, j], one)))], names=["i", "j", "value"])
    return run


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    found = vectors.select("y").mapInArrow(_moments(w), "i int, j int, value double") \
        .groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    at = {(r.i, r.j): r.value / w.n for r in found}
    return max(abs(v - at[i, -1] * at[j, -1] - (i == j)) for (i, j), v in at.items() if j >= 0)


def _project(w: Whitening, error: float):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    m = len(w.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                ids = batch.column("vec_id")
                for rows, y in _matrices(batch):
                    if y.shape[1] != len(w.sums):
                        continue
                    x, deviation = _centred(y, w)
                    many = len(rows)
                    each = np.repeat(np.arange(many), m)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(np.repeat(rows, m))), pa.array(np.tile(np.arange(1, m + 1), many), pa.int32()),
                        pa.array(np.full(many * m, w.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                        pa.array((x @ w.weights).reshape(-1)), pa.array(np.tile(w.explained, many)),
                        pa.array(np.full(many * m, error)), pa.array(np.tile(w.eigenvalues, many))], names=names)
    return run


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of ``integer_vectors``."""
    ship_package(vectors.sparkSession)
    found = scatter(vectors)
    if found is None:
        return None
    n, sums, matrix = found
    return whitening_of(n, sums, matrix, _in_tasks(vectors.sparkSession, matrix))


def whitening_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component."""
    vectors = integer_vectors(df, id_col, vector_col)
    w = fit(vectors)
    if w is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return vectors.mapInArrow(_project(w, identity_error(vectors, w)), SCHEMA)
