"""Inventory / catalogue shaped inputs derived from the driver's tables.

The same SQL text runs in Spark (tables bound as DataFrame parameters) and
in DuckDB (tables are views), so every registered query and its oracle start
from identical rows. The views grow with the underlying tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Table -> columns each fixture needs (lets the parquet scan prune columns).
TABLE_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_linestatus"],
    "orders": ["o_orderkey", "o_custkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
}

F_HOSTS = """
SELECT c_custkey AS ResourceID, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS Active0, n_name AS AD_Site_Name0,
 'CN=' || c_name || ',OU=' || CASE c_mktsegment WHEN 'BUILDING' THEN 'HQ Desktop' WHEN 'AUTOMOBILE' THEN 'Field Laptop'
   WHEN 'MACHINERY' THEN 'DC Server' ELSE 'Other' END || ',DC=mycorp,DC=com' AS Distinguished_Name0,
 r_name AS Resource_Domain_OR_Workgr0
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Parts of one brand in two also stand for installed JDKs; one part in 31 has a
# long version, close to but not equal to the catalogue's.
F_INVENTORY = """
SELECT o_custkey AS ResourceID,
 CASE WHEN p_brand = 'Brand#5' AND p_partkey % 2 = 0 THEN 'Oracle JDK 1.' || CAST(p_size % 9 AS STRING) || ' Update '
   || CAST(p_partkey % 60 AS STRING) ELSE p_name END AS DisplayName0,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN p_brand = 'Brand#1' THEN 'Microsoft Corporation'
      ELSE replace(p_brand, '#', '') || ' Inc' END AS Publisher0,
 CASE WHEN l_linenumber = 6 THEN NULL
      WHEN p_brand = 'Brand#5' AND p_partkey % 2 = 0 THEN '1.' || CAST(p_size % 9 AS STRING) || '.0.'
       || CAST(p_partkey % 60 AS STRING) || '0'
      WHEN p_partkey % 31 = 5 THEN CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) || '.20170412'
      ELSE CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) END AS Version0,
 l_linestatus = 'F' AS arch_X
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

F_CPE = """
SELECT 'cpe:/' || k || ':' || v || ':' || s || ':' || r AS name,
 'cpe:2.3:' || k || ':' || v || ':' || s || ':' || r || ':*:*:*:*:*:*:*' AS cpe23, title, deprecated
FROM (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'o' WHEN p_type = 'LARGE' THEN 'h' ELSE 'a' END AS k,
  lower(replace(p_brand, '#', '')) AS v, replace(p_name, ' ', '_') AS s,
  CASE WHEN p_partkey % 29 = 3 THEN '-' ELSE CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING)
   || CASE WHEN p_partkey % 31 = 5 THEN '.20170412.1' ELSE '' END END AS r,
  CASE WHEN p_partkey % 37 <> 2 THEN replace(p_brand, '#', '') || ' ' || p_name END AS title,
  CASE WHEN p_size = 50 THEN 'true' END AS deprecated FROM {part}
 UNION SELECT 'a', 'oracle', 'jdk', '1.' || CAST(p_size % 9 AS STRING) || '.0:update_' || CAST(p_partkey % 60 AS STRING),
  'Oracle JDK 1.' || CAST(p_size % 9 AS STRING) || ' Update ' || CAST(p_partkey % 60 AS STRING), NULL
  FROM {part} WHERE p_brand = 'Brand#5') d
"""

F_CVE = """
SELECT 'CVE-' || CAST(2000 + p_size % 20 AS STRING) || '-' || CAST(p_partkey AS STRING) AS cve_id,
 'cpe:/' || CASE WHEN p_type = 'PROMO' THEN 'o' WHEN p_type = 'LARGE' THEN 'h' ELSE 'a' END || ':' ||
   lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '_') || ':' ||
   CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) AS product,
 CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(CAST((p_partkey * 7 % 101) / 10.0 AS DECIMAL(4,1)) AS STRING) END AS score,
 CASE p_partkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' END AS complexity,
 CASE p_partkey % 3 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'LOCAL' ELSE 'ADJACENT_NETWORK' END AS vector
FROM {part}
"""

# VIP group members: distinguished names of customers with a large balance.
F_AD_GROUP = """
SELECT 'CN=' || c_name || ',OU=' || CASE c_mktsegment WHEN 'BUILDING' THEN 'HQ Desktop' WHEN 'AUTOMOBILE' THEN 'Field Laptop'
   WHEN 'MACHINERY' THEN 'DC Server' ELSE 'Other' END || ',DC=mycorp,DC=com' AS distinguishedName
FROM {customer} WHERE c_acctbal > 9000
"""

# Site -> region lookup: sites of AMERICA and EUROPE form Region_A, of ASIA and
# AFRICA Region_B; the remaining region stays Unknown.
F_SITE_REGIONS = """
SELECT n_name AS site, CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'Region_A' ELSE 'Region_B' END AS region
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'EUROPE', 'ASIA', 'AFRICA')
"""

# Hand labels in the original's layout. Vendor: every brand's publisher is a
# positive for its own vendor; two-digit brands starting with 1 are labelled
# negatives for vendor brand1 (the containment false candidates); the brand2x
# ones stay unlabelled for the classifier.
F_VENDOR_LABELS = """
SELECT DISTINCT lower(replace(p_brand, '#', '')) || '_inc' AS publisher0, lower(replace(p_brand, '#', '')) AS vendor_X,
 1 AS match FROM {part} WHERE p_brand <> 'Brand#1'
UNION ALL
SELECT DISTINCT lower(replace(p_brand, '#', '')) || '_inc' AS publisher0, 'brand1' AS vendor_X, 0 AS match
FROM {part} WHERE p_brand LIKE 'Brand#1_'
UNION ALL
SELECT DISTINCT 'brand5_inc', 'oracle', 1 FROM {part} WHERE p_brand = 'Brand#5'
"""

# Software: each application catalogue row is a positive for the installed
# title equal to its product name and release; the next product name of the
# same vendor and release is a labelled negative.
F_SOFTWARE_LABELS = """
SELECT vendor_X, software_X, title_X, DisplayName0, release_X, Version0, match, t_cve_name FROM (
 SELECT v AS vendor_X, s AS software_X, title AS title_X, replace(s, '_', ' ') AS DisplayName0, r AS release_X,
  r AS Version0, 1 AS match, 'cpe:/a:' || v || ':' || s || ':' || r AS t_cve_name FROM sw
 UNION ALL
 SELECT v, s, title, replace(nxt, '_', ' '), r, r, 0, 'cpe:/a:' || v || ':' || s || ':' || r FROM (
  SELECT v, s, r, title, lead(s) OVER (PARTITION BY v, r ORDER BY s) AS nxt FROM sw) n WHERE nxt IS NOT NULL
) l
"""
SW_APPS = """sw AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS v, replace(p_name, ' ', '_') AS s,
  CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) AS r,
  replace(p_brand, '#', '') || ' ' || p_name AS title
 FROM {part} WHERE p_type NOT IN ('PROMO', 'LARGE') AND p_size <> 50)"""
F_SOFTWARE_LABELS = "WITH " + SW_APPS + F_SOFTWARE_LABELS

# JDK / JRE catalogue names covering the release rules: update_NN, bare
# "update", two-digit update glued to the keyword, old releases with '_',
# plain releases; vendor and product alternate between oracle/sun, jdk/jre.
F_JAVA = """
SELECT p_partkey AS id, 'cpe:2.3:a:' || CASE WHEN p_size % 2 = 0 THEN 'oracle' ELSE 'sun' END || ':'
 || CASE WHEN p_partkey % 2 = 0 THEN 'jdk' ELSE 'jre' END || ':1.' || CAST(p_size % 9 AS STRING)
 || CASE p_partkey % 5 WHEN 0 THEN '.0:update_' || CAST(p_partkey % 60 AS STRING) WHEN 1 THEN '.2_'
 || CAST(p_partkey % 30 AS STRING) || ':' WHEN 2 THEN '.0:' WHEN 3 THEN '.0:update' ELSE '.1:update'
 || CAST(p_partkey % 40 AS STRING) END || ':*:*:*:*:*:*' AS cpe23
FROM {part}
"""

FIXTURES = {
    "f_hosts": (F_HOSTS, ["customer", "nation", "region"]),
    "f_inventory": (F_INVENTORY, ["lineitem", "orders", "part"]),
    "f_cpe": (F_CPE, ["part"]),
    "f_cve": (F_CVE, ["part"]),
    "f_ad_group": (F_AD_GROUP, ["customer"]),
    "f_site_regions": (F_SITE_REGIONS, ["nation", "region"]),
    "f_vendor_labels": (F_VENDOR_LABELS, ["part"]),
    "f_software_labels": (F_SOFTWARE_LABELS, ["part"]),
    "f_java": (F_JAVA, ["part"]),
}


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, pruned to the columns the fixtures use.

    The relation is resolved once per application and path (file listing and
    footer reads cost ~0.2 s each on the driver); DataFrames are immutable, so
    reusing the same one in several plans is safe.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        df = spark.read.parquet(path)
        cols = TABLE_COLUMNS.get(name)
        _TABLES[key] = df.select(*cols) if cols else df
    return _TABLES[key]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a lazy Spark DataFrame."""
    sql, tables = FIXTURES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def duckdb_cte(names: list[str]) -> str:
    """``WITH`` clause defining the named fixtures over DuckDB's views."""
    parts = []
    for n in names:
        sql, tables = FIXTURES[n]
        parts.append(f"{n} AS ({sql.format(**{t: t for t in tables}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
