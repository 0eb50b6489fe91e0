"""Cleaning of the four raw inputs: hosts, installed software, CPE, CVE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N

HOST_COLUMNS = [
    "ResourceID", "Active0", "AD_Site_Name0", "Distinguished_Name0",
    "Resource_Domain_OR_Workgr0",
]
INVENTORY_UNUSED = ["AgentID", "GroupID", "ProdID0", "RevisionID", "TimeStamp"]


def host_project(raw: DataFrame) -> DataFrame:
    """Keep the five host columns and add ``Site_X``."""
    return raw.select(*HOST_COLUMNS, F.col("AD_Site_Name0").alias("Site_X"))


def host_active(hosts: DataFrame) -> DataFrame:
    """``Active0 > 0``; null activity is dropped."""
    return hosts.where(F.col("Active0") > 0)


def clean_hosts(raw: DataFrame) -> DataFrame:
    return host_active(host_project(raw))


def inv_arch_tag(df: DataFrame, x64: bool) -> DataFrame:
    return df.withColumn("arch_X", F.lit(x64))


def union_arch(x86: DataFrame, x64: DataFrame) -> DataFrame:
    """x86 and x64 inventories, tagged, outer column union."""
    return inv_arch_tag(x86, False).unionByName(inv_arch_tag(x64, True), allowMissingColumns=True)


def inv_not_null(df: DataFrame) -> DataFrame:
    return df.where(F.col("Publisher0").isNotNull() & F.col("DisplayName0").isNotNull())


def inv_not_microsoft(df: DataFrame) -> DataFrame:
    return df.where(~F.lower(F.col("Publisher0")).contains(K.SKIP_VENDOR))


def clean_inventory(df: DataFrame) -> DataFrame:
    """Inventory rows usable for matching (already arch-tagged)."""
    return inv_not_microsoft(inv_not_null(df))


def clean_software(x86: DataFrame, x64: DataFrame) -> DataFrame:
    return clean_inventory(union_arch(x86, x64))


def inv_drop_unused(df: DataFrame) -> DataFrame:
    return df.drop(*INVENTORY_UNUSED)


# --- CPE dictionary ---------------------------------------------------------

def cpe_from_xml(xml: DataFrame) -> DataFrame:
    """Flatten the XML shape (one row per cpe-item) to name / cpe23 / title / deprecated."""
    return xml.select(
        F.col("_name").alias("name"),
        F.col("`cpe-23:cpe23-item`._name").alias("cpe23"),
        N.title_en("title").alias("title"),
        F.col("_deprecated").alias("deprecated"),
    )


def cpe_not_deprecated(cpe: DataFrame) -> DataFrame:
    """Drop ``deprecated == 'true'`` (null-safe) and the deprecation column."""
    return cpe.where(~F.coalesce(F.col("deprecated") == "true", F.lit(False))).drop("deprecated")


def cpe_apps_only(cpe: DataFrame, col: str = "cpe23") -> DataFrame:
    """Drop operating-system and hardware entries."""
    return cpe.where(~F.coalesce(F.col(col).rlike(K.CPE23_NOT_APP), F.lit(False)))


def cpe_parse(cpe: DataFrame) -> DataFrame:
    """Add vendor_X / software_X / release_X from the CPE 2.3 name."""
    return cpe.select(
        "*",
        N.cpe_part("cpe23", 1).alias("vendor_X"),
        N.cpe_part("cpe23", 2).alias("software_X"),
        N.cpe_part("cpe23", 3).alias("release_X"),
    )


def clean_cpe(flat: DataFrame) -> DataFrame:
    """Catalogue rows: cpe_name, cpe23, title_X, vendor_X, software_X, release_X."""
    df = cpe_apps_only(cpe_not_deprecated(flat))
    return cpe_parse(df).select(
        F.col("name").alias("cpe_name"), "cpe23", F.col("title").alias("title_X"),
        "vendor_X", "software_X", "release_X",
    )


def cpe_project(cpe: DataFrame) -> DataFrame:
    return cpe.select("vendor_X", "software_X", "release_X", "title_X", "cpe23", "cpe_name")


# --- CVE feeds --------------------------------------------------------------

CVSS = "`vuln:cvss`.`cvss:base_metrics`"
CVSS_FIELDS = {
    "cvss:score": "score",
    "cvss:access-vector": "vector",
    "cvss:access-complexity": "complexity",
    "cvss:authentication": "authentication",
    "cvss:confidentiality-impact": "confidentiality",
    "cvss:integrity-impact": "integrity",
    "cvss:availability-impact": "availability",
    "cvss:source": "cvss_src",
}


def cve_has_cvss(xml: DataFrame) -> DataFrame:
    return xml.where(F.col("`vuln:cvss`").isNotNull())


def entry_columns() -> list:
    """Columns of a feed entry: its id, time, product list and flattened CVSS metrics."""
    return [
        F.col("`vuln:cve-id`").alias("cve_id"),
        F.col("`vuln:last-modified-datetime`").alias("modified"),
        F.col("`vuln:vulnerable-software-list`.`vuln:product`").alias("products"),
        F.col("`vuln:cvss`").isNotNull().alias("has_cvss"),
        *[F.col(f"{CVSS}.`{k}`").cast("string").alias(v) for k, v in CVSS_FIELDS.items()],
    ]


def cve_entries(xml: DataFrame) -> DataFrame:
    """One row per feed entry, entries without products or CVSS included."""
    return xml.select(*entry_columns())


def cve_products(entries: DataFrame, latest_only: bool = True) -> DataFrame:
    """One row per (cve, product). The same CVE id seen in several feed files is
    kept once, newest ``last-modified`` first; only then entries without CVSS are
    dropped and the product list exploded, so an entry whose newest version lost
    either does not come back with an older one."""
    df = dedup_latest(entries, ["cve_id"], "modified") if latest_only else entries
    return df.where("has_cvss").select("cve_id", F.explode("products").alias("product"), *CVSS_FIELDS.values())


def cve_from_xml(xml: DataFrame, latest_only: bool = True) -> DataFrame:
    """One row per (cve, product) with the flattened CVSS metrics; see :func:`cve_products`."""
    return cve_products(cve_entries(xml), latest_only)


def dedup_latest(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keep one row per key: the greatest ``order_col`` (null last; ties: smallest row).

    A ``max_by`` aggregation (combines map-side, so a repeated key never
    forms one large group in a single task).
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col), row)
    picked = F.max_by(row, rank).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]) \
        .select(*df.columns)


def cve_apps_only(cve: DataFrame, col: str = "product") -> DataFrame:
    return cve.where(~F.coalesce(F.col(col).rlike(K.CPE22_NOT_APP), F.lit(False)))


def cve_rename(cve: DataFrame) -> DataFrame:
    """cve_id, cpe_prod, cvss_score (double), ordinal complexity / vector, cvss_src."""
    cols = cve.columns
    return cve.select(
        "cve_id",
        F.col("product").alias("cpe_prod"),
        N.score_num(F.col("score")).alias("cvss_score"),
        N.ordinal("complexity", K.COMPLEXITY_LEVELS).alias("cmpl_ord"),
        N.ordinal("vector", K.VECTOR_LEVELS).alias("vect_ord"),
        (F.col("cvss_src") if "cvss_src" in cols else F.lit(None).cast("string")).alias("cvss_src"),
    )
