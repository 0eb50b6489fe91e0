"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are encoded where they are read; only (length, count) rows are
shuffled, combined map-side, so a third of all documents at one length costs one
row a task. Suffix sums over the histogram then answer, for every length taken
as a context limit, how many documents and tokens reach it, what truncation at
the limit keeps, and the share of documents that fit (the quantiles). The sums
run inside blocks of lengths and are joined with the sums of the blocks above,
so no task holds more than one block or one row per block.

Defined cases: null and empty texts have length 0; repeated rows count each
time; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .textcols import text_of
from .tokens import MERGES, RANKS, encoder

BLOCK = 256


def length_histogram(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, merges: str = MERGES) -> DataFrame:
    """(length, n_docs): how many texts have each encoded length."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def encoded_length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = encoder(ranks, merges).ids
        for texts in batches:
            yield pd.Series([len(ids(t)) for t in texts], dtype="int64")

    return (docs.select(encoded_length(text_of(text_col)).alias("length"))
            .groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what lies at each length and above, and what a limit of that length keeps.

    Reads ``hist`` twice: hand it over written, or the texts are encoded twice.

    docs_from, tokens_from: documents and tokens of length >= this one;
    truncated_total: tokens left if every document is cut to this length;
    fit_share: share of documents of at most this length.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"),
                    F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(  # one row per BLOCK lengths
        "block", F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("t0"),
        F.sum("bd").over(whole).alias("all_docs"), F.sum("bt").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(blocks, "block")
    docs_from, tokens_from = F.col("d") + F.col("d0"), F.col("t") + F.col("t0")
    over = docs_from - F.col("n_docs")
    return s.select(
        "length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("tokens") + F.col("length") * over).alias("truncated_total"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("fit_share"), "all_docs", "all_tokens")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, total, truncated_total, cut_docs): what each context limit keeps, present as a length or not."""
    # the first length over the limit has all that is cut in its suffix sums
    firsts = [F.min(F.when(F.col("length") > x, F.struct("length", "docs_from", "tokens_from"))).alias(f"x{x}")
              for x in limits]
    row = sums.groupBy().agg(F.max("all_tokens").alias("total"), *firsts)
    stacked = row.select("total", F.explode(F.array(*[
        F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"x{x}.docs_from").alias("d"),
                 F.col(f"x{x}.tokens_from").alias("t")) for x in limits])).alias("a"))
    kept = F.col("total") - F.coalesce("a.t", F.lit(0)) + F.col("a.limit") * F.coalesce("a.d", F.lit(0))
    return stacked.select("a.limit", "total", kept.alias("truncated_total"),
                          F.coalesce("a.d", F.lit(0)).alias("cut_docs"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed."""
    row = sums.groupBy().agg(*[F.min(F.when(F.col("fit_share") >= q, F.col("length"))).alias(f"q{i}")
                               for i, q in enumerate(shares)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)]))
        .alias("a")).select("a.share", "a.length")


def token_histogram_report(docs: DataFrame) -> DataFrame:
    return suffix_sums(materialize(length_histogram(docs), "length_histogram"))
