"""Host enrichment and custom reports (the two extension hooks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from . import reports as R

EnrichHook = Callable[[DataFrame], DataFrame]
ReportHook = Callable[[DataFrame], dict]


def default_site_regions(spark: SparkSession) -> DataFrame:
    """Site -> region table of the sample company (fixed lists)."""
    rows = [(s, "Region_A") for s in K.REGION_A_SITES] + [(s, "Region_B") for s in K.REGION_B_SITES]
    return spark.createDataFrame(rows, "site string, region string")


def region_of_site(hosts: DataFrame, site_regions: DataFrame) -> DataFrame:
    """Add ``Region_X`` by a lookup join on the site; unknown sites -> 'Unknown'.

    A site listed in several regions belongs to the first of them by name. The
    planner broadcasts the lookup table if its measured size allows it.
    """
    lk = site_regions.groupBy(F.col("site").alias("_site")).agg(F.min("region").alias("_region"))
    return (hosts.join(lk, hosts["Site_X"] == lk["_site"], "left")
            .withColumn("Region_X", F.coalesce(F.col("_region"), F.lit(K.REGION_UNKNOWN)))
            .drop("_site", "_region"))


def add_host_function(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("HostFn_X", N.host_function("Distinguished_Name0"))


def host_vip(hosts: DataFrame, group_members: DataFrame) -> DataFrame:
    """``VIP_X = 'vip'`` for hosts whose DN is in the AD group, else null.

    Left join against the distinct member DNs (one row per DN, so no fan-out);
    the member list is shuffled, not broadcast, as its size is not bounded.
    """
    members = (group_members.select(F.col("distinguishedName").alias("_dn")).dropna().distinct()
               .withColumn("_vip", F.lit("vip")))
    return (hosts.join(members, hosts["Distinguished_Name0"] == members["_dn"], "left")
            .withColumnRenamed("_vip", "VIP_X").drop("_dn"))


def enrich_hosts(hosts: DataFrame, site_regions: DataFrame, group_members: DataFrame) -> DataFrame:
    """The sample enrichment: region, host function, VIP membership."""
    return host_vip(add_host_function(region_of_site(hosts, site_regions)), group_members)


def only_vip(df: DataFrame) -> DataFrame:
    return df.where(F.col("VIP_X").isNotNull())


def only_server(df: DataFrame) -> DataFrame:
    return df.where(F.col("HostFn_X").isNotNull() & (F.col("HostFn_X") == "server"))


REPORT_SCHEMA = "report string, item string, n long, High long, Low long, Medium long"


def report_rows(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of one dimension as one long table: report, item, n or High / Low / Medium."""
    def tagged(name: str, df: DataFrame) -> DataFrame:
        dim = next(c for c in df.columns if c not in ("n", "High", "Low", "Medium"))
        cells = [(F.col(c) if c in df.columns else F.lit(None)).cast("long").alias(c) for c in ("n", "High", "Low", "Medium")]
        return df.select(F.lit(name).alias("report"), F.col(dim).cast("string").alias("item"), *cells)

    frames = [tagged(k, v) for k, v in reports.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def custom_reports(vulns: DataFrame, region: str = "Region_A") -> dict[str, DataFrame]:
    """The sample extra reports over the host x vulnerability table."""
    return {
        "host_vuln_by_fn": R.by_criticality(vulns, "HostFn_X"),
        "num_hosts_AD_gps": R.value_counts(vulns, "VIP_X"),
        "VIP_high": R.top_high(only_vip(vulns)),
        "servers_high": R.top_high(only_server(vulns), where=F.col("Region_X") == region),
    }
