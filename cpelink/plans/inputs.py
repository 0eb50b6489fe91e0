"""Stage inputs built from the fixture views (Spark side) and the same
definitions as DuckDB CTEs (oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as CL
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import rollup as RU
from .fixtures import fixture


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_hosts(fixture(spark, d, "f_hosts"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_inventory(fixture(spark, d, "f_inventory"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_cpe(fixture(spark, d, "f_cpe"))


def cve(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "f_cve")


def worst(spark: SparkSession, d: str) -> DataFrame:
    return RU.worst_case(cve(spark, d))


def vendor_labels(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "f_vendor_labels")


def software_labels(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "f_software_labels")


def labelled_vendor_match(spark: SparkSession, d: str) -> DataFrame:
    """(publisher0, vendor_X) from the labelled positives."""
    return CL.match_project_vendor(CL.positive_only(vendor_labels(spark, d))).distinct()


def labelled_software_match(spark: SparkSession, d: str) -> DataFrame:
    """(vendor_X, DisplayName0, Version0, t_cve_name) from the labelled positives."""
    return CL.match_project_software(CL.positive_only(software_labels(spark, d))).distinct()


def enriched_hosts(spark: SparkSession, d: str) -> DataFrame:
    return E.enrich_hosts(hosts(spark, d), fixture(spark, d, "f_site_regions"),
                          fixture(spark, d, "f_ad_group"))


def vulns(spark: SparkSession, d: str) -> DataFrame:
    """Host x vulnerable software table over the labelled matches."""
    return RU.hosts_with_vulns(enriched_hosts(spark, d), inventory(spark, d),
                               labelled_software_match(spark, d), worst(spark, d))


def grouped_vulns(spark: SparkSession, d: str, by: list[str]) -> tuple[DataFrame, list[str]]:
    """``vulns`` as a stage table, grouped by title, version and ``by``, and the columns of its rows."""
    return RU.grouped_hosts_with_vulns(enriched_hosts(spark, d), inventory(spark, d),
                                       labelled_software_match(spark, d), worst(spark, d), by)


def folded_vulns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(items, products) of ``vulns``: its rows before the products multiply them."""
    return RU.folded_hosts_with_vulns(enriched_hosts(spark, d), inventory(spark, d),
                                      labelled_software_match(spark, d), worst(spark, d))


def products(spark: SparkSession, d: str) -> DataFrame:
    """Distinct installed products of matched vendors."""
    from ..operators import candidates as CA
    return CA.products_of(inventory(spark, d), labelled_vendor_match(spark, d))


# --- DuckDB twins -------------------------------------------------------------

CPE_RX = "(?i)cpe:2.3:a:([^:]*):([^:]*):?([^:]*):"


def _cpe_part(col: str, i: int) -> str:
    return f"CASE WHEN regexp_matches({col}, '{CPE_RX}') THEN regexp_extract({col}, '{CPE_RX}', {i}) END"


CRIT_SQL = """CASE
 WHEN coalesce(cvss_score > 7, false) AND coalesce(cvss_acc_cmpl_cat IN ('LOW', 'MEDIUM'), false)
  AND coalesce(cvss_acc_vect_cat IN ('NETWORK', 'ADJACENT_NETWORK'), false) THEN 'High'
 WHEN coalesce(cvss_score < 4, false) OR (NOT coalesce(cvss_acc_cmpl_cat IN ('LOW', 'MEDIUM'), false)
  AND NOT coalesce(cvss_acc_vect_cat IN ('NETWORK', 'ADJACENT_NETWORK'), false)) THEN 'Low'
 ELSE 'Medium' END"""

DERIVED = {
    "hosts": """SELECT ResourceID, Active0, AD_Site_Name0, Distinguished_Name0, Resource_Domain_OR_Workgr0,
 AD_Site_Name0 AS Site_X FROM f_hosts WHERE Active0 > 0""",
    "inv": """SELECT * FROM f_inventory WHERE Publisher0 IS NOT NULL AND DisplayName0 IS NOT NULL
 AND NOT contains(lower(Publisher0), 'microsoft')""",
    "cpe": f"""SELECT name AS cpe_name, cpe23, title AS title_X, {_cpe_part('cpe23', 1)} AS vendor_X,
 {_cpe_part('cpe23', 2)} AS software_X, {_cpe_part('cpe23', 3)} AS release_X
 FROM f_cpe WHERE NOT coalesce(deprecated = 'true', false) AND NOT coalesce(regexp_matches(cpe23, '(?i)cpe:2.3:[oh]:'), false)""",
    "cve_r": """SELECT cve_id, product AS cpe_prod, try_cast(score AS DOUBLE) AS cvss_score,
 CAST(list_position(['HIGH', 'MEDIUM', 'LOW'], complexity) AS INTEGER) AS cmpl_ord,
 CAST(list_position(['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'], vector) AS INTEGER) AS vect_ord,
 CAST(NULL AS VARCHAR) AS cvss_src
 FROM f_cve WHERE NOT coalesce(regexp_matches(product, '(?i)cpe:/[oh]:'), false)""",
    "worst0": """SELECT cpe_prod, max(cvss_score) AS cvss_score,
 ['HIGH', 'MEDIUM', 'LOW'][max(cmpl_ord)] AS cvss_acc_cmpl_cat,
 ['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'][max(vect_ord)] AS cvss_acc_vect_cat FROM cve_r GROUP BY cpe_prod""",
    "worst": f"SELECT *, {CRIT_SQL} AS crit_X_cat FROM worst0",
    "vmatch": "SELECT DISTINCT publisher0, vendor_X FROM f_vendor_labels WHERE match = 1",
    "lmatch": "SELECT DISTINCT vendor_X, DisplayName0, Version0, t_cve_name FROM f_software_labels WHERE match = 1",
    "ehosts": """SELECT h.*, coalesce(sr.region, 'Unknown') AS Region_X,
 nullif(regexp_extract(lower(trim(h.Distinguished_Name0)), 'ou=[0-9A-Za-z_ ]*(desktop|laptop|server)', 1), '') AS HostFn_X,
 CASE WHEN g.dn IS NOT NULL THEN 'vip' END AS VIP_X
 FROM hosts h LEFT JOIN f_site_regions sr ON h.Site_X = sr.site
 LEFT JOIN (SELECT DISTINCT distinguishedName AS dn FROM f_ad_group WHERE distinguishedName IS NOT NULL) g
 ON h.Distinguished_Name0 = g.dn""",
    "vp": "SELECT m.*, w.cvss_score, w.cvss_acc_cmpl_cat, w.cvss_acc_vect_cat, w.crit_X_cat FROM lmatch m JOIN worst w ON m.t_cve_name = w.cpe_prod",
    "vulns": """SELECT h.*, i.DisplayName0, i.Version0, i.Publisher0, i.arch_X, vp.vendor_X, vp.t_cve_name,
 vp.cvss_score, vp.cvss_acc_cmpl_cat, vp.cvss_acc_vect_cat, vp.crit_X_cat
 FROM ehosts h JOIN inv i ON h.ResourceID = i.ResourceID
 JOIN vp ON i.DisplayName0 = vp.DisplayName0 AND i.Version0 = vp.Version0""",
    "invv": """SELECT lower(replace(i.Publisher0, ' ', '_')) AS publisher0, i.DisplayName0, i.Version0, v.vendor_X
 FROM inv i JOIN vmatch v ON lower(replace(i.Publisher0, ' ', '_')) = v.publisher0""",
    "products": """SELECT DISTINCT vendor_X, DisplayName0, coalesce(Version0, '-') AS Version0 FROM invv
 WHERE vendor_X IS NOT NULL AND DisplayName0 IS NOT NULL""",
}

FIXTURE_NAMES = ["f_hosts", "f_inventory", "f_cpe", "f_cve", "f_ad_group", "f_site_regions",
                 "f_vendor_labels", "f_software_labels", "f_java"]


def prelude() -> str:
    """WITH clause with every fixture and derived table (unused ones are pruned)."""
    from .fixtures import duckdb_cte
    head = duckdb_cte(FIXTURE_NAMES).rstrip()
    rest = ",\n".join(f"{k} AS ({v})" for k, v in DERIVED.items())
    return f"{head},\n{rest}\n"


def sql(body: str) -> str:
    return prelude() + body


# --- original nested shapes (as the XML sources yield them) --------------------

def cpe_xml_shape(spark: SparkSession, d: str) -> DataFrame:
    """Fixture catalogue in the XML row shape: attributes, title list, nested 2.3 name.

    Titles: some entries carry a French and an English title, some only an
    English one, some only a German one.
    """
    f = fixture(spark, d, "f_cpe")
    t = F.col("title")
    en = F.struct(t.alias("_VALUE"), F.lit("en-US").alias("_xml:lang"))
    fr = F.struct(F.concat(t, F.lit(" (fr)")).alias("_VALUE"), F.lit("fr-FR").alias("_xml:lang"))
    de = F.struct(F.concat(t, F.lit(" (de)")).alias("_VALUE"), F.lit("de-DE").alias("_xml:lang"))
    sel = F.char_length("name") % 3
    title = F.when(sel == 0, F.array(fr, en)).when(sel == 1, F.array(en)).otherwise(F.array(de))
    return f.select(
        F.col("name").alias("_name"), F.col("deprecated").alias("_deprecated"),
        F.when(F.col("deprecated").isNotNull(), F.lit("2017-01-01T00:00:00.000Z")).alias("_deprecation_date"),
        title.alias("title"), F.struct(F.col("cpe23").alias("_name")).alias("cpe-23:cpe23-item"))


def cve_xml_shape(spark: SparkSession, d: str) -> DataFrame:
    """Fixture feed in the XML row shape.

    Entries without a score have no CVSS element; entries without a
    complexity have no product list; LOCAL entries list a second product.
    """
    f = fixture(spark, d, "f_cve")
    prods = (F.when(F.col("complexity").isNull(), F.lit(None))
             .when(F.col("vector") == "LOCAL", F.array("product", F.concat("product", F.lit(":sp1"))))
             .otherwise(F.array("product")))
    metrics = F.struct(
        F.col("score").alias("cvss:score"), F.col("vector").alias("cvss:access-vector"),
        F.col("complexity").alias("cvss:access-complexity"), F.lit("NONE").alias("cvss:authentication"),
        F.lit("PARTIAL").alias("cvss:confidentiality-impact"), F.lit("PARTIAL").alias("cvss:integrity-impact"),
        F.lit("NONE").alias("cvss:availability-impact"), F.lit("nvd").alias("cvss:source"))
    cvss = F.when(F.col("score").isNotNull(), F.struct(metrics.alias("cvss:base_metrics")))
    return f.select(
        F.col("cve_id").alias("_id"), F.col("cve_id").alias("vuln:cve-id"),
        F.lit("2017-05-01T10:00:00.000-04:00").alias("vuln:last-modified-datetime"),
        F.struct(prods.alias("vuln:product")).alias("vuln:vulnerable-software-list"),
        cvss.alias("vuln:cvss"),
        (F.lit(2000) + F.col("score").isNull().cast("int")).alias("_feed"),
    )


DERIVED.update({
    "cpe_x": """SELECT name AS name, cpe23, CASE length(name) % 3 WHEN 2 THEN title || ' (de)' ELSE title END AS title,
 deprecated FROM f_cpe""",
    "cve_x": """SELECT cve_id, product, score, vector, complexity, 'NONE' AS authentication, 'PARTIAL' AS confidentiality,
 'PARTIAL' AS integrity, 'NONE' AS availability, 'nvd' AS cvss_src
 FROM f_cve WHERE score IS NOT NULL AND complexity IS NOT NULL
 UNION ALL
 SELECT cve_id, product || ':sp1', score, vector, complexity, 'NONE', 'PARTIAL', 'PARTIAL', 'NONE', 'nvd'
 FROM f_cve WHERE score IS NOT NULL AND complexity IS NOT NULL AND vector = 'LOCAL'""",
})
