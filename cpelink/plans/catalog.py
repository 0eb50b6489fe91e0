"""Registered queries: one Spark builder per operator key, with its DuckDB twin.

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole fixture views. Twins are plain SQL over DuckDB views of the same
tables; keys without a twin are checked by row count only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from ..operators import candidates as CA
from ..operators import classify as CL
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import reports as R
from ..operators import rollup as RU
from ..session import materialize, scratch_path
from ..sources import files as SRC
from . import inputs as I
from .fixtures import fixture

from .registry import ORACLES, QUERIES, register  # noqa: F401


# --- 2.3 projections and filters ----------------------------------------------

register("host_project", "SELECT ResourceID, Active0, AD_Site_Name0, Distinguished_Name0, "
         "Resource_Domain_OR_Workgr0, AD_Site_Name0 AS Site_X FROM f_hosts")(
    lambda s, d: C.host_project(fixture(s, d, "f_hosts")))

register("host_active", "SELECT * FROM hosts")(I.hosts)


@register("inv_arch_tag", "SELECT ResourceID, DisplayName0, Publisher0, Version0, arch_X FROM f_inventory")
def _inv_arch_tag(s, d):
    inv = fixture(s, d, "f_inventory")
    x86, x64 = (inv.where(F.col("arch_X") == b).drop("arch_X") for b in (False, True))
    return C.inv_arch_tag(x86, False).unionByName(C.inv_arch_tag(x64, True))


@register("union_arch", "SELECT * FROM f_inventory")
def _union_arch(s, d):
    inv = fixture(s, d, "f_inventory")
    return C.union_arch(inv.where(~F.col("arch_X")).drop("arch_X"), inv.where("arch_X").drop("arch_X"))


register("inv_not_null", "SELECT * FROM f_inventory WHERE Publisher0 IS NOT NULL AND DisplayName0 IS NOT NULL")(
    lambda s, d: C.inv_not_null(fixture(s, d, "f_inventory")))

register("inv_not_microsoft", "SELECT * FROM f_inventory WHERE NOT contains(lower(Publisher0), 'microsoft')")(
    lambda s, d: C.inv_not_microsoft(fixture(s, d, "f_inventory")))

register("clean_software", "SELECT * FROM inv")(I.inventory)


@register("inv_drop_unused", "SELECT * FROM f_inventory")
def _inv_drop_unused(s, d):
    inv = fixture(s, d, "f_inventory")
    for c in C.INVENTORY_UNUSED:
        inv = inv.withColumn(c, F.lit("x"))
    return C.inv_drop_unused(inv)


register("cpe_not_deprecated", "SELECT name, cpe23, title FROM f_cpe WHERE NOT coalesce(deprecated = 'true', false)")(
    lambda s, d: C.cpe_not_deprecated(fixture(s, d, "f_cpe")))

register("cpe_apps_only", "SELECT * FROM f_cpe WHERE NOT coalesce(regexp_matches(cpe23, '(?i)cpe:2.3:[oh]:'), false)")(
    lambda s, d: C.cpe_apps_only(fixture(s, d, "f_cpe")))

register("clean_cpe", "SELECT * FROM cpe")(I.catalogue)

register("cpe_project", "SELECT vendor_X, software_X, release_X, title_X, cpe23, cpe_name FROM cpe")(
    lambda s, d: C.cpe_project(I.catalogue(s, d)))

register("cve_apps_only", "SELECT * FROM f_cve WHERE NOT coalesce(regexp_matches(product, '(?i)cpe:/[oh]:'), false)")(
    lambda s, d: C.cve_apps_only(I.cve(s, d)))

register("cve_rename", "SELECT * FROM cve_r")(lambda s, d: C.cve_rename(C.cve_apps_only(I.cve(s, d))))

register("inv_project", "SELECT vendor_X, DisplayName0, Version0 FROM invv")(
    lambda s, d: CA.inv_with_vendor(I.inventory(s, d), I.labelled_vendor_match(s, d))
    .select("vendor_X", "DisplayName0", "Version0"))

_ODD_PRODUCTS = """SELECT CASE length(DisplayName0) % 5 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'cisco' ELSE vendor_X END AS vendor_X,
 CASE length(DisplayName0) % 3 WHEN 0 THEN DisplayName0 || ' WebEx' ELSE DisplayName0 END AS DisplayName0, Version0 FROM {p}"""


def _odd_products(s, d):
    """Products of which some belong to the vendors and titles that the pair rules know."""
    return s.sql(_ODD_PRODUCTS.format(p="{p}"), p=I.products(s, d))


register("pair_skip_microsoft", f"SELECT * FROM ({_ODD_PRODUCTS.format(p='products')}) o WHERE vendor_X <> 'microsoft'")(
    lambda s, d: CA.pair_skip_microsoft(_odd_products(s, d)))

register("pair_skip_webex", f"""SELECT * FROM ({_ODD_PRODUCTS.format(p='products')}) o WHERE vendor_X <> 'microsoft'
 AND NOT (vendor_X = 'cisco' AND Version0 = '-' AND contains(lower(DisplayName0), 'webex'))""")(
    lambda s, d: CA.pair_skip_rules(_odd_products(s, d)))

register("match_project_vendor", "SELECT * FROM vmatch")(I.labelled_vendor_match)
register("match_project_software", "SELECT * FROM lmatch")(I.labelled_software_match)
register("match_project", "SELECT vendor_X, DisplayName0, Version0, t_cve_name FROM f_software_labels")(
    lambda s, d: CL.match_project_software(I.software_labels(s, d)))

register("only_vip", "SELECT * FROM vulns WHERE VIP_X IS NOT NULL")(lambda s, d: E.only_vip(I.vulns(s, d)))
register("only_server", "SELECT * FROM vulns WHERE HostFn_X = 'server'")(
    lambda s, d: E.only_server(I.vulns(s, d)))

register("positive_only", "SELECT * FROM f_software_labels WHERE match = 1")(
    lambda s, d: CL.positive_only(I.software_labels(s, d)))

@register("pair_complete", """SELECT * FROM (SELECT vendor_X, software_X, CASE WHEN length(software_X) % 7 <> 0 THEN title_X END AS title_X,
 DisplayName0, CASE WHEN length(title_X) % 5 <> 0 THEN release_X END AS release_X, Version0, match,
 CASE WHEN length(title_X) % 3 <> 0 THEN t_cve_name END AS t_cve_name FROM f_software_labels) l
 WHERE title_X IS NOT NULL AND release_X IS NOT NULL AND t_cve_name IS NOT NULL""")
def _pair_complete(s, d):
    """Labels with gaps in three columns."""
    n = F.char_length("title_X")
    gaps = I.software_labels(s, d).withColumns({
        "title_X": F.when(F.char_length("software_X") % 7 != 0, F.col("title_X")),
        "release_X": F.when(n % 5 != 0, F.col("release_X")), "t_cve_name": F.when(n % 3 != 0, F.col("t_cve_name"))})
    return CL.pair_complete(gaps, K.SOFTWARE_KEYS + ["t_cve_name"])


# --- 2.5 scalar functions ---------------------------------------------------------

register("norm_name", "SELECT ResourceID, DisplayName0, lower(replace(Publisher0, ' ', '_')) AS publisher0 FROM f_inventory")(
    lambda s, d: fixture(s, d, "f_inventory").select("ResourceID", "DisplayName0",
                                                     N.norm_name("Publisher0").alias("publisher0")))

_PUB_TOKS = "list_filter(string_split_regex(trim(translate(publisher0, '_.,()+!', '       ')), '\\s+'), lambda t: t <> '')"
_VEN_TOKS = "list_filter(string_split_regex(trim(translate(vendor_X, '-_', '  ')), '\\s+'), lambda t: t <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"


def _clean_sql(toks: str) -> str:
    return (f"' ' || list_reduce(list_prepend('', list_filter({toks}, lambda t: NOT list_contains({_STOP}, t) "
            f"AND length(t) > 1)), lambda a, t: a || ' ' || t)")


_PUBS = "SELECT DISTINCT lower(replace(Publisher0, ' ', '_')) AS publisher0 FROM inv WHERE Publisher0 IS NOT NULL"
_VENS = "SELECT DISTINCT lower(replace(vendor_X, ' ', '_')) AS vendor_X FROM cpe WHERE vendor_X IS NOT NULL"


@register("tokenize", f"""SELECT publisher0, array_to_string({_PUB_TOKS}, '|') AS tokens,
 CAST(len({_PUB_TOKS}) AS INTEGER) AS n_tokens FROM ({_PUBS}) p""")
def _tokenize(s, d):
    p = CA.prepare_publishers(I.inventory(s, d))
    return p.select("publisher0", F.array_join("pub0_toks", "|").alias("tokens"),
                    F.size("pub0_toks").alias("n_tokens"))


@register("clean_tokens", f"""SELECT publisher0, {_clean_sql(_PUB_TOKS)} AS pub0_cln FROM ({_PUBS}) p""")
def _clean_tokens(s, d):
    return CA.prepare_publishers(I.inventory(s, d)).select("publisher0", "pub0_cln")


@register("clean_tokens_vendor", f"""SELECT vendor_X, {_clean_sql(_VEN_TOKS)} AS ven_cln FROM ({_VENS}) v""")
def _clean_tokens_vendor(s, d):
    return CA.prepare_vendors(I.catalogue(s, d)).select("vendor_X", "ven_cln")


register("lower_publisher", "SELECT ResourceID, DisplayName0, lower(Publisher0) AS publisher0 FROM inv")(
    lambda s, d: I.inventory(s, d).select("ResourceID", "DisplayName0", F.lower("Publisher0").alias("publisher0")))

register("cpe_parse", f"""SELECT cpe23, {I._cpe_part('cpe23', 1)} AS vendor_X, {I._cpe_part('cpe23', 2)} AS software_X,
 {I._cpe_part('cpe23', 3)} AS release_X FROM f_cpe""")(
    lambda s, d: C.cpe_parse(fixture(s, d, "f_cpe")).select("cpe23", "vendor_X", "software_X", "release_X"))

_JU = "(?i)cpe:2.3:a:(oracle|sun):(jdk|jre):1.([0-9.]*):update[_]*([0-9]*)"
_JR = "(?i)cpe:2.3:a:(oracle|sun):(jdk|jre):1.([0-9._]*):"


@register("java_release", f"""SELECT id, cpe23, release_X, CASE WHEN vendor_X IN ('oracle', 'sun') AND software_X IN ('jre', 'jdk') THEN
  CASE WHEN NOT (CASE WHEN hu THEN regexp_matches(cpe23, '{_JU}') ELSE regexp_matches(cpe23, '{_JR}') END) THEN '-'
   WHEN contains(rel, '_') THEN '1.' || rel WHEN sft = 'jre' THEN tmp WHEN starts_with(rel, '8.') THEN tmp
   ELSE '1.' || tmp END
 ELSE release_X END AS rel_fixed FROM (
 SELECT *, CASE WHEN hu THEN regexp_extract(cpe23, '{_JU}', 2) ELSE regexp_extract(cpe23, '{_JR}', 2) END AS sft,
  CASE WHEN hu THEN regexp_extract(cpe23, '{_JU}', 3) ELSE regexp_extract(cpe23, '{_JR}', 3) END AS rel,
  CASE WHEN hu THEN regexp_extract(cpe23, '{_JU}', 3) || '.' || regexp_extract(cpe23, '{_JU}', 4) || '0'
   ELSE regexp_extract(cpe23, '{_JR}', 3) END AS tmp FROM (
  SELECT id, cpe23, contains(cpe23, 'update') AS hu, {I._cpe_part('cpe23', 1)} AS vendor_X,
   {I._cpe_part('cpe23', 2)} AS software_X, {I._cpe_part('cpe23', 3)} AS release_X FROM f_java) a) b""")
def _java_release(s, d):
    df = C.cpe_parse(fixture(s, d, "f_java"))
    return df.select("id", "cpe23", "release_X",
                     N.java_release("vendor_X", "software_X", "cpe23", "release_X").alias("rel_fixed"))


register("strip_vendor", """SELECT vendor_X, title_X, DisplayName0, replace(lower(title_X), vendor_X, ' ') AS title_tmp,
 replace(lower(DisplayName0), vendor_X, ' ') AS dsply_tmp FROM f_software_labels""")(
    lambda s, d: I.software_labels(s, d).select(
        "vendor_X", "title_X", "DisplayName0", N.strip_vendor("title_X", "vendor_X").alias("title_tmp"),
        N.strip_vendor("DisplayName0", "vendor_X").alias("dsply_tmp")))

register("fill_version", "SELECT ResourceID, DisplayName0, coalesce(Version0, '-') AS Version0 FROM f_inventory")(
    lambda s, d: fixture(s, d, "f_inventory").select("ResourceID", "DisplayName0", N.fill_version("Version0").alias("Version0")))


@register("name_lengths", """SELECT publisher0, vendor_X, CAST(length(vendor_X) AS INTEGER) AS ven_len,
 CAST(length(publisher0) AS INTEGER) AS pu0_len FROM f_vendor_labels""")
def _name_lengths(s, d):
    return CA.name_lengths_vendor(I.vendor_labels(s, d)).select("publisher0", "vendor_X", "ven_len", "pu0_len")


register("name_lengths_software", """SELECT title_X, DisplayName0, CAST(length(title_X) AS INTEGER) AS titlX_len,
 CAST(length(DisplayName0) AS INTEGER) AS DsplyNm0_len FROM f_software_labels""")(
    lambda s, d: I.software_labels(s, d).select(
        "title_X", "DisplayName0", F.char_length("title_X").alias("titlX_len"),
        F.char_length("DisplayName0").alias("DsplyNm0_len")))

register("cvss_score_num", "SELECT cve_id, score, try_cast(score AS DOUBLE) AS cvss_score FROM f_cve")(
    lambda s, d: I.cve(s, d).select("cve_id", "score", N.score_num(F.col("score")).alias("cvss_score")))

register("cvss_ordinal", """SELECT cve_id, CAST(list_position(['HIGH', 'MEDIUM', 'LOW'], complexity) AS INTEGER) AS cmpl_ord,
 CAST(list_position(['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'], vector) AS INTEGER) AS vect_ord FROM f_cve""")(
    lambda s, d: I.cve(s, d).select("cve_id", N.ordinal("complexity", K.COMPLEXITY_LEVELS).alias("cmpl_ord"),
                                    N.ordinal("vector", K.VECTOR_LEVELS).alias("vect_ord")))

register("criticality", "SELECT cpe_prod, crit_X_cat FROM worst")(
    lambda s, d: I.worst(s, d).select("cpe_prod", "crit_X_cat"))

register("region_of_site", "SELECT ResourceID, Site_X, Region_X FROM ehosts")(
    lambda s, d: E.region_of_site(I.hosts(s, d), fixture(s, d, "f_site_regions")).select("ResourceID", "Site_X", "Region_X"))

register("host_function", "SELECT ResourceID, Distinguished_Name0, HostFn_X FROM ehosts")(
    lambda s, d: E.add_host_function(I.hosts(s, d)).select("ResourceID", "Distinguished_Name0", "HostFn_X"))


# --- 2.7 joins ---------------------------------------------------------------------

register("inv_with_vendor", "SELECT * FROM invv")(
    lambda s, d: CA.inv_with_vendor(I.inventory(s, d), I.labelled_vendor_match(s, d)))

register("host_vip", "SELECT ResourceID, Distinguished_Name0, VIP_X FROM ehosts")(
    lambda s, d: E.host_vip(I.hosts(s, d), fixture(s, d, "f_ad_group")).select("ResourceID", "Distinguished_Name0", "VIP_X"))

register("inv_with_match", """SELECT i.*, m.vendor_X, m.t_cve_name FROM inv i JOIN lmatch m
 ON i.DisplayName0 = m.DisplayName0 AND i.Version0 = m.Version0""")(
    lambda s, d: RU.inv_with_products(I.inventory(s, d), I.labelled_software_match(s, d)))


@register("inv_with_vuln", """SELECT i.*, vp.vendor_X, vp.t_cve_name, vp.cvss_score, vp.cvss_acc_cmpl_cat,
 vp.cvss_acc_vect_cat, vp.crit_X_cat FROM inv i JOIN vp ON i.DisplayName0 = vp.DisplayName0 AND i.Version0 = vp.Version0""")
def _inv_with_vuln(s, d):
    vp = RU.vulnerable_products(I.labelled_software_match(s, d), I.worst(s, d))
    return RU.inv_with_products(I.inventory(s, d), vp)


register("host_with_vuln", "SELECT * FROM vulns")(I.vulns)
register("enrich_hosts", "SELECT * FROM ehosts")(I.enriched_hosts)


# --- 2.8 aggregations -------------------------------------------------------------

register("distinct_publishers", _PUBS)(
    lambda s, d: CA.prepare_publishers(I.inventory(s, d)).select("publisher0"))
register("distinct_vendors", _VENS)(lambda s, d: CA.prepare_vendors(I.catalogue(s, d)).select("vendor_X"))
register("distinct_products", "SELECT * FROM products")(I.products)
register("worst_case", "SELECT * FROM worst")(I.worst)

register("crit_distribution", "SELECT crit_X_cat, count(*) AS n FROM worst GROUP BY crit_X_cat")(
    lambda s, d: R.value_counts(I.worst(s, d), "crit_X_cat"))
register("crit_distribution_installed", "SELECT crit_X_cat, count(*) AS n FROM vulns GROUP BY crit_X_cat")(
    lambda s, d: R.value_counts(I.vulns(s, d), "crit_X_cat"))


def _pivot_sql(dim: str) -> str:
    return (f"SELECT {dim}, count(*) FILTER (WHERE crit_X_cat = 'High') AS High, "
            f"count(*) FILTER (WHERE crit_X_cat = 'Low') AS Low, count(*) FILTER (WHERE crit_X_cat = 'Medium') AS Medium "
            f"FROM vulns WHERE {dim} IS NOT NULL GROUP BY {dim}")


register("site_by_criticality", _pivot_sql("Site_X"))(lambda s, d: R.by_criticality(I.vulns(s, d), "Site_X"))
register("site_by_criticality_all_sites", """SELECT s.Site_X, coalesce(c.High, 0) AS High, coalesce(c.Low, 0) AS Low,
 coalesce(c.Medium, 0) AS Medium FROM (SELECT DISTINCT Site_X FROM hosts) s LEFT JOIN (""" + _pivot_sql("Site_X")
         + ") c ON s.Site_X = c.Site_X")(
    lambda s, d: R.by_criticality(I.vulns(s, d), "Site_X", I.hosts(s, d).select("Site_X")))
register("fn_by_criticality", _pivot_sql("HostFn_X"))(lambda s, d: R.by_criticality(I.vulns(s, d), "HostFn_X"))
register("vip_counts", "SELECT VIP_X, count(*) AS n FROM vulns WHERE VIP_X IS NOT NULL GROUP BY VIP_X")(
    lambda s, d: R.value_counts(I.vulns(s, d), "VIP_X"))
register("region_counts", "SELECT Region_X, count(*) AS n FROM ehosts GROUP BY Region_X")(
    lambda s, d: R.value_counts(I.enriched_hosts(s, d), "Region_X"))
register("fn_counts", "SELECT HostFn_X, count(*) AS n FROM ehosts WHERE HostFn_X IS NOT NULL GROUP BY HostFn_X")(
    lambda s, d: R.value_counts(I.enriched_hosts(s, d), "HostFn_X"))
register("label_balance", "SELECT match, count(*) AS n FROM f_software_labels GROUP BY match")(
    lambda s, d: R.value_counts(I.software_labels(s, d), "match"))
register("label_balance_vendor", "SELECT match, count(*) AS n FROM f_vendor_labels GROUP BY match")(
    lambda s, d: R.value_counts(I.vendor_labels(s, d), "match"))
register("distinct_regions", "SELECT DISTINCT Region_X FROM ehosts")(
    lambda s, d: I.enriched_hosts(s, d).select("Region_X").distinct())

_PROFILE_COLS = ["ResourceID", "Site_X", "Region_X", "HostFn_X", "VIP_X", "DisplayName0", "Version0",
                 "vendor_X", "t_cve_name", "crit_X_cat"]


def _folded_profile_cols(s, d):
    """(items, products) of the host x vulnerability table with the profiled columns; items are written once."""
    items, products = I.folded_vulns(s, d)
    held = [c for c in _PROFILE_COLS if c in items.columns]
    return materialize(items.select(*held, "arch_X", RU.TIMES), "profiled_items", "zstd"), products


def _exact_profile(items, products):
    """Items and products are profiled apart, each with the rows that they stand for."""
    found = RU.fold_products(items, products)
    of_items = [c for c in _PROFILE_COLS if c in items.columns]
    of_products = [c for c in _PROFILE_COLS if c not in of_items]
    return R.profile_distinct(items.select(*of_items, RU.TIMES), times=RU.TIMES).unionByName(
        R.profile_distinct(found.select(*of_products, RU.TIMES), times=RU.TIMES))


@register("profile_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, "
    f"(SELECT count(*) FROM vulns) AS n_rows FROM vulns" for c in _PROFILE_COLS))
def _profile(s, d):
    return _exact_profile(*_folded_profile_cols(s, d))


@register("profile_sketches", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, (SELECT count(*) FROM vulns) AS n_rows, true AS close FROM vulns"
    for c in _PROFILE_COLS))
def _profile_sketches(s, d):
    """Profiles kept with two stage tables, merged; the estimates lie within 3 % of the exact distinct counts."""
    base, (items, products) = scratch_path(s, "profiled"), _folded_profile_cols(s, d)
    v = RU.unfold(items, products)
    for name, part in (("x64", v.where("arch_X")), ("x86", v.where("NOT arch_X"))):
        SRC.save_stage(part.select(*_PROFILE_COLS), base, name, profile=True)
    merged = R.sketch_counts(R.merge_sketches(SRC.load_profiles(s, base, ["x64", "x86"])))
    exact = _exact_profile(items, products).select("column_name", F.col("n_distinct").alias("exact"))
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return merged.join(exact, "column_name").select("column_name", "non_null", "n_rows", close.alias("close"))


# --- 2.9 de-duplication ------------------------------------------------------------

@register("dedup_pairs", """SELECT vendor_X, software_X, title_X, DisplayName0, release_X, Version0, match, t_cve_name FROM (
 SELECT *, row_number() OVER (PARTITION BY vendor_X, software_X, title_X, DisplayName0, release_X, Version0
  ORDER BY src, match, t_cve_name) AS rn FROM (
  SELECT *, 0 AS src FROM f_software_labels WHERE match = 0
  UNION ALL SELECT *, 1 AS src FROM f_software_labels)) x WHERE rn = 1""")
def _dedup_pairs(s, d):
    lab = I.software_labels(s, d)
    both = CL.union_matches(lab.where("match = 0"), lab)
    return CL.dedup_pairs(both, K.SOFTWARE_KEYS, ["match", "t_cve_name"]).drop("_src")


# --- 2.10 top-k --------------------------------------------------------------------

def _top_sql(src: str, key: str, k: int, where: str = "true") -> str:
    return (f"SELECT {key}, count(*) AS n FROM {src} WHERE {key} IS NOT NULL AND ({where}) GROUP BY {key} "
            f"ORDER BY n DESC, {key} LIMIT {k}")


register("top_vendors", _top_sql("cpe", "vendor_X", 10))(lambda s, d: R.top_counts(I.catalogue(s, d), "vendor_X", 10))
register("top_products", _top_sql("cpe", "software_X", 10))(
    lambda s, d: R.top_counts(I.catalogue(s, d), "software_X", 10))
register("top_high", _top_sql("vulns", "t_cve_name", 25, "crit_X_cat = 'High'"))(lambda s, d: R.top_high(I.vulns(s, d)))
register("top_high_vip", _top_sql("vulns", "t_cve_name", 25, "crit_X_cat = 'High' AND VIP_X IS NOT NULL"))(
    lambda s, d: R.top_high(E.only_vip(I.vulns(s, d))))
register("top_high_servers_region", _top_sql(
    "vulns", "t_cve_name", 25, "crit_X_cat = 'High' AND HostFn_X = 'server' AND Region_X = 'Region_A'"))(
    lambda s, d: R.top_high(E.only_server(I.vulns(s, d)), where=F.col("Region_X") == "Region_A"))
register("top_sites", _pivot_sql("Site_X") + " ORDER BY High DESC, Medium DESC, Site_X LIMIT 10")(
    lambda s, d: R.top_sites(I.vulns(s, d)))
_SAMPLE_KEYS = ["ResourceID", "t_cve_name", "DisplayName0", "Version0", "arch_X", "Publisher0"]
register("sample_rows", f"""SELECT * FROM vulns ORDER BY md5(concat_ws('|', '42',
 {", ".join(f"CAST({k} AS VARCHAR)" for k in _SAMPLE_KEYS)})), {", ".join(_SAMPLE_KEYS)} LIMIT 20""")(
    lambda s, d: R.sample_rows(I.vulns(s, d), 20, _SAMPLE_KEYS))


# --- 2.12 hooks ----------------------------------------------------------------------

def _counted(report: str, item: str, n: str, rest: str) -> str:
    return (f"SELECT * FROM (SELECT '{report}' AS report, {item} AS item, {n} AS n, CAST(NULL AS BIGINT) AS High, "
            f"CAST(NULL AS BIGINT) AS Low, CAST(NULL AS BIGINT) AS Medium {rest}) q_{report}")


def _pivoted(report: str, dim: str, rest: str = "") -> str:
    return (f"SELECT '{report}' AS report, {dim} AS item, CAST(NULL AS BIGINT) AS n, High, Low, Medium "
            f"FROM ({_pivot_sql(dim)} {rest}) q_{report}")


def _top_report(report: str, where: str) -> str:
    return _counted(report, "t_cve_name", "count(*)", f"FROM vulns WHERE crit_X_cat = 'High' AND t_cve_name IS NOT NULL "
                    f"AND ({where}) GROUP BY t_cve_name ORDER BY n DESC, t_cve_name LIMIT 25")


CUSTOM_REPORTS_SQL = " UNION ALL ".join([
    _pivoted("host_vuln_by_fn", "HostFn_X"),
    _counted("num_hosts_AD_gps", "VIP_X", "count(*)", "FROM vulns WHERE VIP_X IS NOT NULL GROUP BY VIP_X"),
    _top_report("VIP_high", "VIP_X IS NOT NULL"),
    _top_report("servers_high", "HostFn_X = 'server' AND Region_X = 'Region_A'")])
SITE_REPORT_SQL = _pivoted("site_by_criticality", "Site_X", "ORDER BY High DESC, Medium DESC, Site_X LIMIT 10")
TOP_REPORT_SQL = _top_report("top25_sft_high", "true")

register("custom_reports", CUSTOM_REPORTS_SQL)(lambda s, d: E.report_rows(E.custom_reports(I.vulns(s, d))))


from . import catalog_io  # noqa: E402,F401  (registers source / sink / nested keys)
from . import catalog_match  # noqa: E402,F401  (registers scoring / candidate / model keys)
