"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of digits, a-z and non-ASCII characters of the text with A-Z
lower-cased. Each benchmark item gives its windows of ``width`` words; a shorter
item gives one window of all its words, an item without words none.

The window hashes of the benchmark are counted first. Up to ``max_set`` distinct
windows they become a literal hash set in the plan, and every document scans its
own token windows against it inside one projection: no row per word, no shuffle.
A larger benchmark stays a table: documents emit (row, window hash) rows that
meet it in a join Spark picks, and only the hit positions go on. Either way each
hit is verified by the window's words, not by its hash.

Defined cases: null and empty texts have no words and no hits; a null document
id is kept as null; an item whose id is null is ignored in the list of items but
its words still count as hits; repeated rows each get their result; empty tables
give empty results or no hits. Other columns pass through ``remove_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release_scratch, scratch_count
from .textcols import alnum_words, ascii_lower, let, row_key, text_of, upto, without

WIDTH = 10
#: Distinct benchmark windows that may become a literal set in the plan (about 8 bytes each).
MAX_SET = 100_000


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(win, len, items): each distinct window's words, its length and the items that have it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             alnum_words(ascii_lower(text_of("text"))).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(width))
    wins = words.select("item", span.alias("len"), F.explode(let(F.col("w"), lambda w: F.transform(
        upto(F.greatest(F.size(w) - width, F.lit(0)) + 1),
        lambda i: F.array_join(F.slice(w, i + 1, F.least(F.size(w), F.lit(width))), " ")))).alias("win"))
    return wins.groupBy("win", "len").agg(F.collect_set("item").alias("items"))


def _hash(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.slice(w, i + 1, n))


def _starts(w: Column, n: int) -> Column:
    return upto(F.size(w) - (n - 1))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              width: int = WIDTH, max_set: int = MAX_SET) -> DataFrame:
    """(__id, __th, n_words, n_hit, items): one row per document row."""
    wins = materialize(benchmark_windows(benchmark, width), "benchmark_windows")
    lengths = [r["len"] for r in wins.select("len").distinct().orderBy("len").collect()]  # 1..width at most
    n_wins = wins.count()
    words = alnum_words(ascii_lower(text_of(text_col)))
    hashed = wins.select("len", F.xxhash64(F.split("win", " ")).alias("h"))

    if n_wins <= max_set:
        sets: dict[int, list[int]] = {}
        for r in hashed.collect():  # at most max_set rows of 12 bytes
            sets.setdefault(r["len"], []).append(r["h"])

        def hits_of(w: Column, n: int) -> Column:
            found = F.filter(_starts(w, n), lambda i: _hash(w, i, n).isin(sets[n]))
            return F.transform(found, lambda i: F.struct(
                i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("win")))

        def hits(w: Column) -> Column:
            return (F.concat(*[hits_of(w, n) for n in lengths]) if lengths
                    else F.array().cast("array<struct<pos:int,len:int,win:string>>"))

        scanned = docs.select(*row_key(id_col, text_of(text_col)), let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), hits(w).alias("hits"))).alias("r"))
        scanned = scanned.select("__id", "__th", "r.n_words", "r.hits")
    else:
        keyed = docs.select(*row_key(id_col, text_of(text_col)), words.alias("w"))

        def starts_of(w: Column, n: int) -> Column:
            return F.transform(_starts(w, n), lambda i: F.struct(
                i.alias("pos"), F.lit(n).alias("len"), _hash(w, i, n).alias("h")))

        def starts(w: Column) -> Column:
            return F.concat(*[starts_of(w, n) for n in lengths])

        near = (keyed.select("__id", "__th", F.explode(let(F.col("w"), starts)).alias("s"))
                .select("__id", "__th", "s.pos", "s.len", "s.h")
                .join(hashed.distinct(), ["len", "h"], "left_semi")
                .groupBy("__id", "__th").agg(F.collect_set(F.struct("pos", "len")).alias("at")))
        scanned = (keyed.join(near, ["__id", "__th"], "left")
                   .select("__id", "__th", F.size("w").cast("long").alias("n_words"),
                           let(F.col("w"), lambda w: F.transform(F.coalesce(F.col("at"), F.array()), lambda s: F.struct(
                               s["pos"].alias("pos"), s["len"].alias("len"),
                               F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").alias("win")))).alias("hits")))
    scanned = materialize(scanned, "window_hits")

    verified = (scanned.select("__id", "__th", F.explode("hits").alias("x"))
                .select("__id", "__th", "x.pos", "x.len", "x.win").distinct().join(wins.drop("len"), "win")
                .groupBy("__id", "__th")
                .agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("at"),
                     F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda a, s: F.struct(
        F.greatest(a["end"], s["pos"] + s["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n")),
        lambda a: a["n"])
    return (scanned.select("__id", "__th", "n_words")
            .join(verified.select("__id", "__th", covered.alias("n_hit"), "items"), ["__id", "__th"], "left")
            .select("__id", "__th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    doc_id = F.when(F.col("__id") != F.lit(-(2 ** 63)), F.col("__id"))
    return found.select(
        doc_id.alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", max_share: float = 0.0) -> DataFrame:
    """The rows whose share of hit words is at most ``max_share`` (0: no hit at all)."""
    mark = scratch_count(docs.sparkSession)
    found = find_hits(docs, benchmark, id_col, text_col)
    dirty = materialize(found.where((F.col("n_hit") > 0) & (F.col("n_hit") > max_share * F.col("n_words")))
                        .select("__id", "__th").distinct(), "contaminated")
    release_scratch(docs.sparkSession, since=mark, keep=1)
    return without(docs, dirty, id_col, text_col)


ORACLE = r"""
WITH dw AS (
  SELECT rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rn, * FROM documents)),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
pos AS (
  SELECT rn, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT rn, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, lens)),
hits AS (SELECT p.rn, p.n, p.i, s.item_id FROM pos p JOIN wins s USING (n, win)),
cover AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rn),
items AS (
  SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (rn) LEFT JOIN items USING (rn)
"""
