"""Periodic run detection: scale-tiled search with boundary Z-functions, stitched by document and period.

A run of period p is a stretch of words that equal the word p later; the stretch
[lo, hi) of such positions belongs to the run [lo, hi + p). Runs are asked for from
three periods and ``MIN_WORDS`` words on, so a stretch holds 2 p positions, 16 at least.

1. Explode. Periods fall into octaves: 1-7, 8-15, 16-31, ... An octave lays a boundary
   every ``step`` words (its smallest period, 8 in the first), so each stretch of the
   octave holds two boundaries or more. The tile of a boundary reaches one step to its
   left, and one step and the octave's longest period to its right; tiles overlap, and
   an octave's tiles add up to about four times the document. A tile is laid out only
   where the eight words from the boundary on, or the eight before it, come again at a
   distance of the octave: of a stretch of 16 positions around a boundary one of the
   two lies inside it, so no run is lost.
2. Solve. In a tile, one Z-function of the words from the boundary on and one of the
   reversed words give, for all periods of the octave at once, how far equality at that
   distance reaches to the right and to the left, a step at most. Fragments shorter than
   a step belong to no run. A fragment that has a proper divisor q of p as a period is
   left to q: the fragment and p cover more than p + q words, so the whole run has it.
3. Stitch. Fragments of neighbouring tiles are put together as they come, then shuffled
   by (document, period), where those that touch become one stretch.

Only documents that repeat eight words in a row anywhere are handed on to step 2 and
the last join with their words; all others are done in the scan.

Defined cases: a null or empty text, or one of white space only, has no words and no
run; a null id counts as the empty string and is returned as null; rows that repeat an
id or a whole row are documents of their own; very long texts become more tiles of
bounded length up to the octave of a third of their words; an empty table gives an
empty result; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .textcols import NULL_ID, text_of

#: Least words and least periods of a run (fixed values of the contract).
MIN_WORDS, MIN_PERIODS = 24, 3
GRAM = 8
FIRST_STEP = 8
#: Words of tiles sent on together.
_BATCH_WORDS = 1 << 20

_KEY = "__id long, __th long, "
_DOC = "n long, plain_sha string, body binary"
_TILED = _KEY + _DOC + ", low int, step int, at int, tile array<int>"
_SOLVED = _KEY + _DOC + ", period int, lo int, hi int"
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, n_words long")


def make_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the checksum of its id repeats some of its words from a place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    numbers = dict(zip(dict.fromkeys(words), count()))
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` words from each position on."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    size = 1
    while size < GRAM:  # doubling: a gram of 2 k words from two of k
        x = (x[:-size] * np.uint64(0xBF58476D1CE4E5B9)) ^ (x[size:] + (x[size:] << np.uint64(7)))
        x ^= x >> np.uint64(31)
        size *= 2
    return x


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(least period, first period beyond, step) of each octave that a document of ``n`` words can hold."""
    if n >= MIN_WORDS:
        yield 1, FIRST_STEP, FIRST_STEP
    low = FIRST_STEP
    while MIN_PERIODS * low <= n:
        yield low, 2 * low, low
        low *= 2


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(least period, step, boundary, words) of the tiles in which a run of their octave may lie."""
    n = len(ids)
    if n < MIN_WORDS:
        return
    grams = _grams(ids)
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return
    m = len(grams)
    for low, beyond, step in octaves(n):
        at = np.arange(step, n, step)
        hit = np.zeros(len(at), bool)
        # a gram and those up to an octave later; places past the end repeat the gram before the octave begins
        later = sliding_window_view(np.concatenate((grams, np.zeros(beyond, np.uint64))), beyond - low)
        for shift in (0, GRAM):
            k = np.flatnonzero(at - shift + low < m)
            here = at[k] - shift
            same = later[here + low] == grams[here][:, None]
            same &= (here + low)[:, None] + np.arange(beyond - low) < m
            hit[k] |= same.any(axis=1)
        for b in at[hit].tolist():
            yield low, step, b, ids[b - step:b + step + beyond]


def z_function(s: list[int]) -> list[int]:
    """For each position the length of the longest prefix of ``s`` that begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def _primes(p: int) -> tuple[int, ...]:
    found, f = [], 2
    while f * f <= p:
        if p % f == 0:
            found.append(f)
            while p % f == 0:
                p //= f
        f += 1
    return (*found, p) if p > 1 else tuple(found)


def solve(low: int, step: int, at: int, tile: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, lo, hi): the stretches around a tile's boundary, cut a step away from it on either side."""
    beyond = 2 * low if low > 1 else FIRST_STEP
    x = tile.tolist()
    ahead = z_function(x[step:])
    last = min(beyond, len(ahead)) - 1                  # the longest period that the document has room for
    back = z_function([*x[step - 1::-1], -1, *x[step + last - 1::-1]] if last else [])
    for p in range(low, last + 1):
        r = min(ahead[p], step)
        l = back[step + 1 + last - p]
        if l + r < step:
            continue
        for f in _primes(p):
            q = p // f
            if back[step + 1 + last - q] >= l and ahead[q] >= r + p - q:
                break
        else:
            yield p, at - l, at + r


def _batches(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, and one per tile."""
    schema = pa.schema([("__id", pa.int64()), ("__th", pa.int64()), ("n", pa.int64()), ("plain_sha", pa.string()),
                        ("body", pa.binary()), ("low", pa.int32()), ("step", pa.int32()), ("at", pa.int32()),
                        ("tile", pa.list_(pa.int32()))])
    for batch in batches:
        rows, held = [], 0
        for key, th, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = make_periodic(text.split(), doc_id)  # bytes split at ASCII white space only
            some = 0
            for low, step, at, tile in tiles(word_ids(words)) if len(words) >= MIN_WORDS else ():
                rows.append((key, th, None, None, None, low, step, at, tile))
                held += len(tile)
                some += 1
                if held >= _BATCH_WORDS:
                    yield _batches(rows, schema)
                    rows, held = [], 0
            body = b" ".join(words)
            held += len(words)
            done = (hashlib.sha256(body).hexdigest(), None) if not some else (None, body)
            rows.append((key, th, len(words), *done, None, None, None, None))
        if rows:
            yield _batches(rows, schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile rows become rows of fragments, put together where they touch; document rows pass."""
    schema = pa.schema([("period", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
    names = ["__id", "__th", "n", "plain_sha", "body", "period", "lo", "hi"]
    for batch in batches:
        is_doc = np.asarray(batch.column("low").is_null())
        docs = batch.filter(pa.array(is_doc))
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*docs.columns[:5], none, none, none], names=names)
        rest = batch.filter(pa.array(~is_doc))
        if not rest.num_rows:
            continue
        open_: dict[tuple, list[int]] = {}
        found = []
        tile = rest.column("tile")
        offsets, flat = np.asarray(tile.offsets), np.asarray(tile.values)
        heads = zip(*(rest.column(c).to_pylist() for c in ("__id", "__th", "low", "step", "at")))
        for k, (key, th, low, step, at) in enumerate(heads):
            for p, lo, hi in solve(low, step, at, flat[offsets[k]:offsets[k + 1]]):
                held = open_.get((key, th, p))
                if held and held[0] <= hi and lo <= held[1]:
                    held[0], held[1] = min(held[0], lo), max(held[1], hi)
                else:
                    if held:
                        found.append((key, th, p, *held))
                    open_[key, th, p] = [lo, hi]
        found += [(*k, *v) for k, v in open_.items()]
        if found:
            key, th, p, lo, hi = zip(*found)
            none = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(th, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()),
                 pa.nulls(none, pa.binary()), *(pa.array(c, t) for c, t in zip((p, lo, hi), schema.types))], names=names)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of documents that went through the search."""
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, n, body, runs in zip(*(c.to_pylist() for c in batch.columns)):
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs or ())
            best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
            words = body.split()
            keep = np.ones(len(words), bool)
            for start, period, length in runs:
                keep[start + period:start + length] = False
            collapsed = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
            listed = "".join(f"{s},{length},{p}\n" for s, p, length in runs).encode()
            shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
            rows.append((doc_id, len(runs), *shown, hashlib.sha256(listed).hexdigest(),
                         hashlib.sha256(collapsed).hexdigest(), n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def explode_tiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (with its words where the search goes on, else with their digest) and one per tile."""
    ship_package(docs.sparkSession)
    the_id, text = F.col(id_col).cast("long"), text_of(text_col)
    return docs.select(F.coalesce(the_id, F.lit(NULL_ID).cast("long")).alias("__id"),
                       F.xxhash64(text, the_id.isNull()).alias("__th"), the_id.alias("doc_id"),
                       text.cast("binary").alias("text")).mapInArrow(_scan, _TILED)


def fragments(tiled: DataFrame) -> DataFrame:
    """Tile rows solved, document rows as they are."""
    return tiled.mapInArrow(_solve, _SOLVED)


def stitch(found: DataFrame) -> DataFrame:
    """(__id, __th, start, length, period): the runs of fragments that touch."""
    by = Window.partitionBy("__id", "__th", "period")
    before = F.max("hi").over(by.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("lo") <= before, 0).otherwise(1)
    stretch = (found.select("__id", "__th", "period", "lo", "hi", opens.alias("opens"))
               .withColumn("part", F.sum("opens").over(by.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("__id", "__th", "period", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    length = F.col("hi") + F.col("period") - F.col("lo")
    return stretch.select("__id", "__th", F.col("lo").alias("start"), length.alias("length"), "period") \
        .where((F.col("length") >= MIN_WORDS) & (F.col("length") >= MIN_PERIODS * F.col("period")))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, runs): the written scan's document rows, and their runs; both carry the row keys."""
    solved = materialize(fragments(explode_tiles(docs, id_col, text_col)), "periodic_fragments", "zstd")
    runs = stitch(solved.where(F.col("period").isNotNull()))
    return solved.where(F.col("n").isNotNull()).select("__id", "__th", "n", "plain_sha", "body"), runs


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, its most periodic run and the digests."""
    found, runs = periodic_runs(docs)
    per_doc = runs.groupBy("__id", "__th").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    shown = F.when(F.col("__id") != NULL_ID, F.col("__id")).alias("doc_id")
    searched = (found.where(F.col("body").isNotNull()).join(per_doc, ["__id", "__th"], "left")
                .select(shown, "n", "body", "runs").mapInArrow(_finish, SCHEMA))
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    plain = found.where(F.col("body").isNull()).select(
        shown, F.lit(0).cast("long").alias("n_runs"), *none, F.sha2(F.lit(""), 256).alias("runs_sha256"),
        F.col("plain_sha").alias("collapsed_sha256"), F.col("n").alias("n_words"))
    return searched.unionByName(plain)


#: Every pair of equal words of a document, islands of positions per distance; the plain definition of a run.
ORACLE = r"""
WITH src AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w0 FROM documents),
hashed AS (
  SELECT rn, doc_id, w0, len(w0) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT,
    CASE WHEN doc_id IS NULL THEN []::BIGINT[] ELSE list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) END),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) AS h FROM src),
placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a,
    CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
docs AS (
  SELECT rn, doc_id, n, CASE WHEN a IS NULL THEN w0
    ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % p + 1] END) END AS w FROM placed),
words AS (SELECT rn, n, unnest(w) AS x, unnest(range(n)) AS i FROM docs),
pairs AS (
  SELECT l.rn, l.i, r.i - l.i AS p FROM words l JOIN words r ON l.rn = r.rn AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
islands AS (
  SELECT rn, p, min(i) AS s, count(*) AS k FROM (
    SELECT rn, p, i, i - row_number() OVER (PARTITION BY rn, p ORDER BY i) AS g FROM pairs) GROUP BY rn, p, g),
runs AS (
  SELECT rn, s, k + p AS len, min(p) AS p FROM (SELECT rn, p, s, k, k + p AS all_words, s + k + p AS e FROM islands)
  WHERE all_words >= greatest(24, 3 * p) GROUP BY rn, s, e, k + p),
first_of AS (SELECT rn, s, min(p) AS p, len FROM runs GROUP BY rn, s, len),
per_doc AS (
  SELECT rn, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed,
    first(struct_pack(s := s, len := len, p := p) ORDER BY len::DOUBLE / p DESC, s, p) AS best FROM first_of GROUP BY rn),
dropped AS (SELECT DISTINCT rn, unnest(range(s + p, s + len)) AS i FROM first_of),
kept AS (
  SELECT words.rn, string_agg(x, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (rn, i) GROUP BY words.rn)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.len // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(body, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM docs LEFT JOIN per_doc USING (rn) LEFT JOIN kept USING (rn)
"""
