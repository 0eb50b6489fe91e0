"""Connected components of a distributed edge list: union-find per partition, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition; at most one edge per node leaves it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b["hi"].tolist(), b["lo"].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pd.DataFrame({"hi": np.array(nodes, "int64"), "lo": np.array([root(x) for x in nodes], "int64")})


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _directed(sym.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = e.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    moved = e.withColumnRenamed("hi", "u").join(least, "u").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return _directed(moved.union(least))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node in ``pairs`` (a, b); the label is the smallest node of the component.

    Each round writes its edges to the shared folder. Rounds end when the edges
    stay as they are: then every edge leads straight to its component's smallest node.
    """
    ship_package(pairs.sparkSession)
    edges = materialize(_directed(pairs).mapInPandas(_local_forest, "hi long, lo long").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "large_star")), "small_star")
        if (now := mark(edges)) == seen:
            break
        seen = now
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(roots)
