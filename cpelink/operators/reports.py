"""Report frames: top-k, criticality pivots, profiles, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def top_counts(df: DataFrame, key: str, k: int, where: Column | None = None,
               count_name: str = "n") -> DataFrame:
    """k most frequent non-null ``key`` values (ties: smaller key first).

    Partial counts are combined map-side; ``orderBy + limit`` plans as
    TakeOrderedAndProject, so only k rows per partition reach the final merge.
    """
    src = df if where is None else df.where(where)
    return (src.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count_name))
            .orderBy(F.col(count_name).desc(), F.col(key).asc()).limit(k))


def top_high(df: DataFrame, k: int = K.TOP_HIGH_K, where: Column | None = None) -> DataFrame:
    """Most installed products with a High rating (counts installed rows)."""
    cond = F.col("crit_X_cat") == "High"
    if where is not None:
        cond = cond & where
    return top_counts(df, "t_cve_name", k, cond)


def by_criticality(df: DataFrame, dim: str, all_values: DataFrame | None = None) -> DataFrame:
    """Row counts by (dim, criticality) pivoted to High / Low / Medium columns, missing -> 0.

    Null ``dim`` values are dropped (as a group-by on them would). With
    ``all_values`` (one column named ``dim``), values without any row are
    kept with zero counts.
    """
    out = (df.where(F.col(dim).isNotNull()).groupBy(dim).pivot("crit_X_cat", K.CRIT_PIVOT)
           .count().na.fill(0, K.CRIT_PIVOT))
    if all_values is not None:
        out = all_values.select(dim).dropna().distinct().join(out, dim, "left").na.fill(0, K.CRIT_PIVOT)
    return out


def top_sites(df: DataFrame, k: int = K.TOP_SITES_K, all_sites: DataFrame | None = None) -> DataFrame:
    """Sites with most High, then most Medium installs (``all_sites`` keeps empty sites)."""
    return by_criticality(df, "Site_X", all_sites).orderBy(
        F.col("High").desc(), F.col("Medium").desc(), F.col("Site_X")).limit(k)


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Counts per non-null value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))


def _cell_hash(c: str) -> Column:
    """128 bits of hash of a column's value, null for null."""
    v = F.col(f"`{c}`")
    return F.when(v.isNotNull(), F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")))


def _cells(df: DataFrame, times: str | None = None) -> DataFrame:
    """(column_name, h, times): one row per cell; ``h`` is the hash of its value, null for null."""
    cells = [F.struct(F.lit(c).alias("column_name"), _cell_hash(c).alias("h")) for c in df.columns if c != times]
    n = (F.lit(1) if times is None else F.col(times)).cast("long").alias("times")
    return df.select(F.explode(F.array(*cells)).alias("x"), n).select("x.*", "times")


def _every_column(df: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    """``found`` by column name, with the columns of a table without rows."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    return names.join(found, "column_name", "left")


def profile_distinct(df: DataFrame, approx: bool = False, times: str | None = None) -> DataFrame:
    """One row per column: column name, non-null count and distinct count.

    One aggregation over (column, value hash) for all columns: repeated values
    combine map-side, so what is shuffled follows the distinct values and not
    columns times rows. ``approx`` estimates from sketches, whose size is fixed.
    ``times`` names a column that says for how many rows a row stands (not profiled itself).
    """
    if approx and times is not None:
        raise ValueError("sketches are made of whole rows")
    if approx:
        return sketch_counts(distinct_sketches(df))
    values = _cells(df, times).groupBy("column_name", "h").agg(F.sum("times").alias("n"))
    found = values.groupBy("column_name").agg(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))).alias("k"),
                                              F.count("h").alias("d"), F.sum("n").alias("r"))
    return _every_column(df, [c for c in df.columns if c != times], found).select("column_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (
        ("k", "non_null"), ("d", "n_distinct"), ("r", "n_rows"))])


#: log2 of a sketch's registers: a relative standard error of 0.65 % in 16 kB.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame) -> DataFrame:
    """(column_name, non_null, n_rows, sketch): mergeable sketches of each column's distinct values, one per column.

    One aggregation of whole rows: a row is met once and not once for each of its columns.
    """
    names = df.columns
    # hashes are columns of their own: inside the aggregates they would be computed without compiled code
    hashes = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(_cell_hash(c))).alias(f"h{i}") for i, c in enumerate(names)])
    found = hashes.agg(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.count(f"h{i}").alias("non_null"), F.count(F.lit(1)).alias("n_rows"),
        F.hll_sketch_agg(f"h{i}", SKETCH_BITS).alias("sketch")) for i, c in enumerate(names)]).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*").where("n_rows > 0")


def merge_sketches(profiles: DataFrame) -> DataFrame:
    """Profiles of several tables or parts as the profile of their union, without another look at the rows."""
    return profiles.groupBy("column_name").agg(F.sum("non_null").alias("non_null"), F.sum("n_rows").alias("n_rows"),
                                               F.hll_union_agg("sketch").alias("sketch"))


def sketch_counts(profiles: DataFrame) -> DataFrame:
    """Profiles in the form of ``profile_distinct``; the distinct counts are estimates."""
    return profiles.select("column_name", "non_null", F.hll_sketch_estimate("sketch").alias("n_distinct"), "n_rows")


#: One value of the first key in so many gives the bound under which a sample's rows are sought.
BOUND_PART = 64


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Reproducible pseudo-random sample of ``n`` rows: the rows whose seeded
    MD5 of the keys is smallest (top-k, so each task keeps only ``n`` rows).

    The ``n`` smallest hashes of a part of the table are not below those of the whole: their
    largest is a bound, and only the hash is computed of a row above it. A part of fewer than
    ``n`` rows gives no bound.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    hashed = df.withColumn("__h", h)
    part = hashed.where(F.pmod(F.xxhash64(keys[0]), F.lit(BOUND_PART)) == 0).select("__h").orderBy("__h").limit(n)
    bound = part.agg(F.count(F.lit(1)).alias("rows"), F.max("__h").alias("h")).first()
    if bound.rows == n and n > 0:
        hashed = hashed.where(F.col("__h") <= bound.h)
    return hashed.orderBy("__h", *keys).limit(n).drop("__h")


# --- all count reports of a run from one aggregation -------------------------------

_CUBE = ["Site_X", "HostFn_X", "VIP_X", "crit_X_cat", "t_cve_name", "high", "vip", "server"]
_SETS = {"sites": ["Site_X", "crit_X_cat"], "functions": ["HostFn_X", "crit_X_cat"], "groups": ["VIP_X"],
         "products": ["t_cve_name", "high", "vip", "server"]}


def count_cube(vulns: DataFrame, region: str, times: str | None = None) -> DataFrame:
    """(grouped, dimensions, n): the counts that every report of a run is made of, by one pass of grouping sets.

    Rows of the host x vulnerability table combine map-side to one row per
    value and set, so the written result follows the dimensions, not the rows.
    ``times`` names a column that says for how many rows of that table a row stands.
    """
    n = F.lit(1) if times is None else F.col(times)
    server = F.coalesce((F.col("HostFn_X") == "server") & (F.col("Region_X") == region), F.lit(False))
    flagged = vulns.select(
        "Site_X", "HostFn_X", "VIP_X", "crit_X_cat", "t_cve_name", F.coalesce(F.col("crit_X_cat") == "High", F.lit(False)).alias("high"),
        F.col("VIP_X").isNotNull().alias("vip"), server.alias("server"), n.cast("long").alias("__n"))
    sets = [[F.col(c) for c in v] for v in _SETS.values()]
    counted = flagged.groupingSets(sets, *_CUBE).agg(F.grouping_id().alias("gid"), F.sum("__n").alias("n"))
    # bit k from the left is set where column k is not part of the set
    gid = {sum(1 << (len(_CUBE) - 1 - k) for k, c in enumerate(_CUBE) if c not in v): name for name, v in _SETS.items()}
    named = F.create_map(*[F.lit(x) for kv in gid.items() for x in kv])
    return counted.select(F.element_at(named, F.col("gid").cast("int")).alias("grouped"), *_CUBE, "n")


def _pivoted(cube: DataFrame, grouped: str, dim: str) -> DataFrame:
    rows = cube.where((F.col("grouped") == grouped) & F.col(dim).isNotNull())
    return rows.groupBy(dim).agg(*[F.coalesce(F.sum(F.when(F.col("crit_X_cat") == c, F.col("n"))), F.lit(0)).alias(c)
                                   for c in K.CRIT_PIVOT])


def _top_of(cube: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    rows = cube.where((F.col("grouped") == "products") & F.col("high") & F.col("t_cve_name").isNotNull())
    rows = rows if where is None else rows.where(where)
    return rows.groupBy("t_cve_name").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "t_cve_name").limit(k)


def run_reports(cube: DataFrame) -> dict[str, DataFrame]:
    """The reports of a run from its ``count_cube``, which should be a written table."""
    groups = cube.where((F.col("grouped") == "groups") & F.col("VIP_X").isNotNull())
    return {
        "top25_sft_high": _top_of(cube, K.TOP_HIGH_K),
        "site_by_criticality": _pivoted(cube, "sites", "Site_X").orderBy(
            F.col("High").desc(), F.col("Medium").desc(), "Site_X").limit(K.TOP_SITES_K),
        "host_vuln_by_fn": _pivoted(cube, "functions", "HostFn_X"),
        "num_hosts_AD_gps": groups.select("VIP_X", "n"),
        "VIP_high": _top_of(cube, K.TOP_HIGH_K, F.col("vip")),
        "servers_high": _top_of(cube, K.TOP_HIGH_K, F.col("server")),
    }
