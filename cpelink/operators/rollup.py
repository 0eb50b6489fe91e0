"""Worst-case vulnerability per product and the host x vulnerability table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from ..session import materialize
from . import clean as C


def worst_case(cve: DataFrame) -> DataFrame:
    """Per CPE product: max score, max complexity / vector level, criticality.

    Input: cleaned CVE rows (cve_id, product, score, complexity, vector).
    Partial + final hash aggregation; one shuffle on ``cpe_prod``.
    """
    renamed = C.cve_rename(C.cve_apps_only(cve))
    agg = renamed.groupBy("cpe_prod").agg(
        F.max("cvss_score").alias("cvss_score"),
        F.max("cmpl_ord").alias("cmpl_ord"),
        F.max("vect_ord").alias("vect_ord"),
    )
    cmpl = N.level("cmpl_ord", K.COMPLEXITY_LEVELS)
    vect = N.level("vect_ord", K.VECTOR_LEVELS)
    return agg.select(
        "cpe_prod", "cvss_score",
        cmpl.alias("cvss_acc_cmpl_cat"),
        vect.alias("cvss_acc_vect_cat"),
        N.criticality(F.col("cvss_score"), cmpl, vect).alias("crit_X_cat"),
    )


def vulnerable_products(match: DataFrame, worst: DataFrame) -> DataFrame:
    """Matched products that carry a vulnerability (small: bounded by the catalogue)."""
    return match.join(worst, match["t_cve_name"] == worst["cpe_prod"], "inner").drop("cpe_prod")


#: Products up to which their table is sent to every task; above, the planner decides by its size.
LISTED_PRODUCTS = 100_000
PRODUCT_KEYS = ["DisplayName0", "Version0"]


def listed(products: DataFrame) -> DataFrame:
    """A table of products as the side of a join that the inventory meets.

    Written once and counted: a catalogue of up to ``LISTED_PRODUCTS`` rows is broadcast,
    a larger one is joined as the planner finds best by its real size.
    """
    out = materialize(products, "products")
    return F.broadcast(out) if out.count() <= LISTED_PRODUCTS else out


def inv_with_products(software: DataFrame, products: DataFrame) -> DataFrame:
    """Installed software x products of the same title and version (matches, or vulnerable products)."""
    return software.join(listed(products), PRODUCT_KEYS, "inner")


def _on_hosts(hosts: DataFrame, software: DataFrame, vp: DataFrame) -> DataFrame:
    """hosts x software x ``vp``, the join that multiplies rows last: nothing behind it is shuffled."""
    keys = ["ResourceID", *PRODUCT_KEYS]
    names = ["ResourceID", *[c for c in hosts.columns if c != "ResourceID"], *PRODUCT_KEYS,
             *[c for c in software.columns if c not in keys], *[c for c in vp.columns if c not in PRODUCT_KEYS]]
    return hosts.join(software, "ResourceID", "inner").join(vp, PRODUCT_KEYS, "inner").select(names)


def hosts_with_vulns(hosts: DataFrame, software: DataFrame, match: DataFrame,
                     worst: DataFrame, fill_version_on_join: bool = False) -> DataFrame:
    """hosts x installed software x product match x worst case (all inner joins).

    The product-level tables are joined first (match x worst-case is bounded by
    the catalogue) and the inventory meets the hosts on ResourceID, one row per
    installed item. Only then the two meet on (DisplayName0, Version0) as in the
    original; the vendor is not part of the key, so that an item has a row for
    each vendor that has such a product, and these rows are not shuffled again.
    """
    inv = C.inv_drop_unused(software)
    if fill_version_on_join:
        inv = inv.withColumn("Version0", N.fill_version("Version0"))
    return _on_hosts(hosts, inv, listed(vulnerable_products(match, worst)))


#: Column of a nested table: the product columns of each row of the whole table that one of its rows holds.
NESTED = "__products"
#: Products of one title and version that a list holds; more make several lists.
LIST_PRODUCTS = 1_000


def nested_hosts_with_vulns(hosts: DataFrame, software: DataFrame, match: DataFrame,
                            worst: DataFrame, fill_version_on_join: bool = False) -> DataFrame:
    """``hosts_with_vulns`` as a stage table: an installed item once, with all its products in a list.

    The rows of an item differ in the product columns only. Their values are all kept,
    one entry for each row; those of the item and its host are not repeated.
    ``flatten`` gives the rows.
    """
    inv = C.inv_drop_unused(software)
    if fill_version_on_join:
        inv = inv.withColumn("Version0", N.fill_version("Version0"))
    products = materialize(vulnerable_products(match, worst), "products")
    few = products.count() <= LISTED_PRODUCTS
    nested = product_lists(products)
    return _on_hosts(hosts, inv, F.broadcast(nested) if few else nested)


def product_lists(products: DataFrame) -> DataFrame:
    """The products of each title and version in lists of some ``LIST_PRODUCTS`` at most, without their keys."""
    own = product_columns(products)
    lists = products.groupBy(PRODUCT_KEYS).agg(F.ceil(F.count("*") / LIST_PRODUCTS).alias("__lists"))
    entries = products.join(lists, PRODUCT_KEYS).withColumn("__list", F.pmod(F.xxhash64(*own), F.col("__lists")))
    return entries.groupBy(*PRODUCT_KEYS, "__list").agg(F.collect_list(F.struct(*own)).alias(NESTED)).drop("__list")


def product_columns(products: DataFrame) -> list[str]:
    """The columns of ``products`` that its rows add to those of an installed item."""
    return [c for c in products.columns if c not in PRODUCT_KEYS]


#: Column of a grouped table: the installed items, without the columns that they share.
INSTALLED = "__installed"
#: Hosts whose items of one title and version may stand in one list; of more, they make several.
LIST_HOSTS = 50_000


def grouped_hosts_with_vulns(hosts: DataFrame, software: DataFrame, match: DataFrame, worst: DataFrame,
                             by: list[str]) -> tuple[DataFrame, list[str]]:
    """(``hosts_with_vulns`` as a stage table of one row for each title, version and ``by``, the columns of its rows).

    Such items differ in their hosts only and have the same products: a row holds both
    lists, an entry for each item and one for each product, and stands for every item
    with every product. ``flatten`` gives the rows. ``by`` are columns of the hosts.
    """
    inv = C.inv_drop_unused(software)
    products = materialize(vulnerable_products(match, worst), "products")
    few = products.count() <= LISTED_PRODUCTS
    lists, keys = product_lists(products), products.select(PRODUCT_KEYS).distinct()
    lists, keys = (F.broadcast(lists), F.broadcast(keys)) if few else (lists, keys)
    items = hosts.join(inv.join(keys, PRODUCT_KEYS, "left_semi"), "ResourceID", "inner")
    own = [c for c in items.columns if c not in (*by, *PRODUCT_KEYS)]
    part = F.pmod(F.xxhash64("ResourceID"), F.lit(-(-hosts.count() // LIST_HOSTS) or 1)).alias("__part")
    grouped = items.groupBy(*by, *PRODUCT_KEYS, part).agg(F.collect_list(F.struct(*own)).alias(INSTALLED)).drop("__part")
    names = ["ResourceID", *[c for c in hosts.columns if c != "ResourceID"], *PRODUCT_KEYS,
             *[c for c in inv.columns if c not in ("ResourceID", *PRODUCT_KEYS)], *product_columns(products)]
    return grouped.join(lists, PRODUCT_KEYS, "inner"), names


def flatten(nested: DataFrame) -> DataFrame:
    """The rows of a nested table, columns as of ``hosts_with_vulns``; those of a grouped one in another order."""
    if INSTALLED in nested.columns:
        nested = nested.select(*[c for c in nested.columns if c != INSTALLED], F.inline(INSTALLED))
    return nested.select(*[c for c in nested.columns if c != NESTED], F.inline(NESTED))


#: Column of a folded table: for how many rows of the whole table one of its rows stands.
TIMES = "__times"


def folded_hosts_with_vulns(hosts: DataFrame, software: DataFrame, match: DataFrame,
                            worst: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, products): ``hosts_with_vulns`` before the join that multiplies its rows.

    ``items`` has one row per installed item with a vulnerable product and says in ``TIMES``
    how many such products its title has; ``products`` are the vulnerable products.
    """
    products = materialize(vulnerable_products(match, worst), "products")
    few = products.count() <= LISTED_PRODUCTS
    per = products.groupBy(PRODUCT_KEYS).agg(F.count("*").alias(TIMES))
    products, per = (F.broadcast(products), F.broadcast(per)) if few else (products, per)
    inv = C.inv_drop_unused(software).join(per, PRODUCT_KEYS, "inner")
    return hosts.join(inv, "ResourceID", "inner"), products


def unfold(items: DataFrame, products: DataFrame) -> DataFrame:
    """The rows that folded ``items`` stand for, with the columns of their products."""
    return items.drop(TIMES).join(products, PRODUCT_KEYS, "inner")


def fold_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """The products of folded ``items``, with the rows that each stands for in ``TIMES``."""
    held = items.groupBy(PRODUCT_KEYS).agg(F.count("*").alias(TIMES))
    return held.join(products, PRODUCT_KEYS, "inner")


def count_folded(items: DataFrame, products: DataFrame, dims: list[str]) -> DataFrame:
    """The whole table counted by ``dims`` of the items and by product: combinations, with their rows in ``TIMES``.

    Items combine before they meet the products, so that what is multiplied are
    the counts and not the rows.
    """
    counted = items.groupBy(*dims, *[c for c in PRODUCT_KEYS if c not in dims]).agg(F.count("*").alias(TIMES))
    return counted.join(products, PRODUCT_KEYS, "inner")


def hosts_with_vulns_bucketed(hosts: DataFrame, light: DataFrame, heavy: DataFrame, match: DataFrame,
                              worst: DataFrame) -> DataFrame:
    """``hosts_with_vulns`` over an inventory stage bucketed by (DisplayName0, Version0).

    The stage is first reduced to installed items of vulnerable products, for which
    the bucketed part is not shuffled, however many reports are made of it; the few
    most installed products, kept beside it, are met apart, where the planner may
    split them. What is left goes to the hosts and meets the products last.
    """
    products = materialize(vulnerable_products(match, worst), "products")
    few = products.count() <= LISTED_PRODUCTS
    keys = products.select(PRODUCT_KEYS).distinct()
    vp, keys = (F.broadcast(products), F.broadcast(keys)) if few else (products, keys)
    met = light.join(keys, PRODUCT_KEYS, "left_semi").unionByName(heavy.join(keys, PRODUCT_KEYS, "left_semi"))
    return _on_hosts(hosts, met, vp)
