"""Out-of-fold evaluation, and the classifier families that Spark ML lacks.

Labelled pairs get a fold by a hash of their keys, so folds are the same in every
run and on every cluster. An evaluation is a table: one row per pair with its
fold, its label and what a model that has not seen its fold predicts. Accuracy,
precision and recall are aggregations over that table.

* Nearest centroid and ridge need sums only. They are aggregated once per (fold, class)
  or per fold; the sums that a fold is judged by are those of all others.
* k nearest neighbours and passive-aggressive learn from a bounded sample of labelled
  rows (``max_rows``, the rows with the smallest hashes), which travels to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Labelled rows that a neighbour search or an online learner keeps in memory.
MAX_ROWS = 50_000
NEIGHBOURS = 5


def labelled_rows(pairs: DataFrame, keys: list[str], features: list[str], folds: int) -> DataFrame:
    """(keys, features, match, mark, fold): one complete row per key (of two labels the positive one)."""
    complete = pairs.select(*keys, *features, "match").dropna()
    rows = complete.groupBy(*keys).agg(*[F.max(f).alias(f) for f in features], F.max("match").cast("int").alias("match"))
    mark = F.md5(F.concat_ws("|", *keys))
    fold = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % folds).cast("int")
    return rows.select(*keys, *features, "match", mark.alias("mark"), fold.alias("fold"))


def out_of_fold(rows: DataFrame, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``rows`` with ``predicted``: each fold by the model that ``fit`` makes of the others.

    ``fit`` takes training rows and returns what adds the column to other rows.
    """
    out = None
    for k in range(folds):
        part = fit(rows.where(F.col("fold") != k))(rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def confusion(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, tp, fp, fn, tn, accuracy, precision, recall); ratios without a denominator are null."""
    yes, said = F.col("match") == 1, F.col("predicted") == 1
    counts = predicted.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in (
            ("tp", yes & said), ("fp", ~yes & said), ("fn", yes & ~said), ("tn", ~yes & ~said))])

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*(by or []), "n", "tp", "fp", "fn", "tn", share(tp + F.col("tn"), F.col("n")).alias("accuracy"),
                         share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


# --- families ---------------------------------------------------------------------------

def nearest_centroid(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``predicted``: the class whose mean over the other folds is nearest (ties: the lower class)."""
    sums = rows.groupBy("fold", "match").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in features])
    other = sums.select(F.col("fold").alias("own"), "match", "n", *features)
    left = sums.select("fold").distinct().join(other, F.col("fold") != F.col("own"))   # folds x folds x classes
    means = left.groupBy("fold", "match").agg(
        F.array(*[F.sum(f) / F.sum("n") for f in features]).alias("mean"))
    by_fold = means.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("match", "mean"))).alias("classes"))

    def away(mean: Column) -> Column:
        total = F.lit(0.0)
        for i, f in enumerate(features):
            total = total + (F.col(f) - mean[i]) * (F.col(f) - mean[i])
        return total

    near = F.transform("classes", lambda c: F.struct(away(c["mean"]).alias("d"), c["match"].alias("m")))
    return rows.join(by_fold, "fold").withColumn("predicted", F.array_min(near)["m"]).drop("classes")


def ridge(rows: DataFrame, features: list[str], folds: int, alpha: float = 1.0) -> DataFrame:
    """``rows`` with ``predicted``: the sign of a ridge regression on -1 / 1, from the normal equations of the other folds."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.when(F.col("match") == 1, 1.0).otherwise(-1.0)
    cells = [(f"x{i}_{j}", a * b) for i, a in enumerate(x) for j, b in enumerate(x) if i <= j] + [(f"y{i}", a * y) for i, a in enumerate(x)]
    sums = {r.fold: r for r in rows.groupBy("fold").agg(*[F.sum(c).alias(n) for n, c in cells]).collect()}  # one row per fold
    m = len(x)
    expr = F.lit(None).cast("double")
    for k in range(folds):
        others = [r for f, r in sums.items() if f != k]
        if not others:
            continue
        total = {n: sum(r[n] for r in others) for n, _ in cells}
        a = np.array([[total[f"x{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        a += alpha * np.diag([0.0] + [1.0] * (m - 1))       # the intercept is not penalised
        w = np.linalg.lstsq(a, np.array([total[f"y{i}"] for i in range(m)]), rcond=None)[0]
        value = F.lit(0.0)
        for c, xi in zip(w, x):
            value = value + float(c) * xi
        expr = F.when(F.col("fold") == k, value).otherwise(expr)
    return rows.withColumn("predicted", F.when(expr > 0, 1).otherwise(0))


def _sample(train: DataFrame, features: list[str], max_rows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most ``max_rows`` training rows in the order of their marks, on the driver."""
    got = train.orderBy("mark").limit(max_rows).select(*features, "match", "mark").toPandas()
    return got[features].to_numpy(np.int64), got["match"].to_numpy(np.int64), got["mark"].tolist()


def nearest_neighbours(train: DataFrame, features: list[str], k: int = NEIGHBOURS,
                       max_rows: int = MAX_ROWS) -> Callable[[DataFrame], DataFrame]:
    """The majority of the ``k`` nearest training rows (equal distances: smaller marks first; a tie of votes says no)."""
    x, y, _ = _sample(train, features, max_rows)

    def add(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            square = (x * x).sum(axis=1)
            for b in batches:
                own = b[features].to_numpy(np.int64)
                votes = np.zeros(len(b), np.int64)
                for lo in range(0, len(b) if len(x) else 0, 256):
                    part = own[lo:lo + 256]
                    near = (part * part).sum(axis=1)[:, None] + square - 2 * (part.astype(float) @ x.T.astype(float)).astype(np.int64)
                    rank = near * len(x) + np.arange(len(x))
                    best = np.argpartition(rank, min(k, len(x)) - 1, axis=1)[:, :k]
                    votes[lo:lo + 256] = (2 * y[best] - 1).sum(axis=1)
                yield b.assign(predicted=(votes > 0).astype("int32"))

        return rows.mapInPandas(run, rows.withColumn("predicted", F.lit(0)).schema)
    return add


def passive_aggressive(train: DataFrame, features: list[str], passes: int = 5, limit: float = 1.0, seed: int = 42,
                       max_rows: int = MAX_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A linear classifier that moves, for each row inside the margin, just as far as it must (at most ``limit``)."""
    x, y, _ = _sample(train, features, max_rows)
    mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(features)), np.ones(len(features)))
    spread = np.where(spread > 0, spread, 1.0)
    z = np.hstack(((x - mean) / spread, np.ones((len(x), 1))))
    w, order = np.zeros(len(features) + 1), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(z)):
            sign = 2 * y[i] - 1
            loss = 1 - sign * (w @ z[i])
            if loss > 0:
                w += min(limit, loss / (z[i] @ z[i])) * sign * z[i]
    value = F.lit(float(w[-1]))
    for c, m, s, f in zip(w, mean, spread, features):
        value = value + float(c) * (F.col(f) - float(m)) / float(s)
    return lambda rows: rows.withColumn("predicted", F.when(value > 0, 1).otherwise(0))


def other_families(pairs: DataFrame, keys: list[str], features: list[str], folds: int = 5,
                   max_rows: int = MAX_ROWS) -> dict[str, DataFrame]:
    """Out-of-fold predictions of the families that Spark ML lacks."""
    rows = materialize(labelled_rows(pairs, keys, features, folds), "labelled_rows")
    return {
        "nearest_centroid": nearest_centroid(rows, features),
        "ridge": ridge(rows, features, folds),
        "nearest_neighbours": out_of_fold(rows, folds, lambda t: nearest_neighbours(t, features, max_rows=max_rows)),
        "passive_aggressive": out_of_fold(rows, folds, lambda t: passive_aggressive(t, features, max_rows=max_rows)),
    }
