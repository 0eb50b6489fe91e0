"""Registered queries for sources, sinks and nested data.

Scans are exercised on real files: the fixture rows are first landed in the
original formats (UTF-16 '|' dumps, XML documents, CSV labels, Parquet
stages) below the session's shared folder, then read back with the
library's readers. The twins are the fixture rows themselves.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import reports as R
from ..operators import rollup as RU
from ..session import materialize, scratch_path
from ..sources import files as S
from . import catalog as CAT
from . import inputs as I
from .registry import register
from .fixtures import fixture

# --- 2.1 scans ------------------------------------------------------------------

def _wide(df, columns: list[str]):
    """A dump as the original tool writes it: every column of its view, in the view's order."""
    names = columns[::-1]
    return df.select(F.lit("x").alias("View_Column0"), *names, F.lit(None).cast("string").alias("Unused0"),
                     F.col(names[0]).cast("string").alias("Copy0"))


@register("scan_hosts", "SELECT * FROM f_hosts")
def _scan_hosts(s, d):
    cols = [f.name for f in S.HOSTS_SCHEMA.fields]
    path = S.write_dump(_wide(fixture(s, d, "f_hosts"), cols), scratch_path(s, "hosts_dump"))
    return S.scan_hosts(s, path)


@register("scan_software", "SELECT * FROM f_inventory")
def _scan_software(s, d):
    inv = fixture(s, d, "f_inventory")
    extra = [F.lit(None).cast("string").alias(c) for c in ("AgentID", "GroupID", "InstallDate0", "ProdID0",
                                                            "RevisionID", "TimeStamp")]
    cols = [f.name for f in S.SOFTWARE_SCHEMA.fields]

    def dump(arch: bool, name: str) -> str:
        part = inv.where(F.col("arch_X") == arch).select("*", *extra)
        return S.write_dump(_wide(part, cols), scratch_path(s, name))

    sw = S.scan_software(s, dump(False, "sw_x86"), dump(True, "sw_x64"))
    return sw.select("ResourceID", "DisplayName0", "Publisher0", "Version0", "arch_X")


@register("scan_ad_group", "SELECT * FROM f_ad_group")
def _scan_ad_group(s, d):
    path = S.write_dump(fixture(s, d, "f_ad_group").select(
        F.lit("user").alias("objectClass"), "distinguishedName", F.lit(None).cast("string").alias("mail")),
        scratch_path(s, "ad_group"), sep=",")
    return S.scan_ad_group(s, path)


@register("scan_cpe_xml", "SELECT name, cpe23, title, deprecated FROM cpe_x")
def _scan_cpe_xml(s, d):
    path = S.write_cpe_xml(I.cpe_xml_shape(s, d), scratch_path(s, "cpe_dict"))
    return C.cpe_from_xml(S.scan_cpe_xml(s, path))


def _land_feeds(s, d) -> str:
    """Two yearly feed files plus one unrelated file; some entries are repeated
    in the second file with a later modification time."""
    base = scratch_path(s, "feeds")
    shape = I.cve_xml_shape(s, d)
    first = shape.where(F.col("_feed") == 2000).drop("_feed")
    second = shape.where(F.col("_feed") == 2001).drop("_feed")
    again = first.where(F.col("`vuln:cvss`.`cvss:base_metrics`.`cvss:access-vector`") == "NETWORK") \
        .withColumn("vuln:last-modified-datetime", F.lit("2017-06-01T10:00:00.000-04:00"))
    S.write_cve_xml(first, os.path.join(base, f"{K.CVE_FILE_PREFIX}2000.xml"))
    S.write_cve_xml(second.unionByName(again), os.path.join(base, f"{K.CVE_FILE_PREFIX}2001.xml"))
    S.write_cve_xml(first, os.path.join(base, "other-2000.xml"))
    return base


@register("scan_cve_xml", "SELECT * FROM cve_x")
def _scan_cve_xml(s, d):
    return C.cve_from_xml(S.scan_cve_xml(s, _land_feeds(s, d)))


@register("union_feeds", """SELECT cve_id, coalesce(score, '') AS score, n FROM (
 SELECT cve_id, score, 1 + CAST(score IS NOT NULL AND vector = 'NETWORK' AS INTEGER) AS n FROM f_cve) f""")
def _union_feeds(s, d):
    """Every entry of both feed files, those that both hold twice."""
    df = S.scan_cve_xml(s, _land_feeds(s, d)).select(*C.entry_columns())
    return df.groupBy("cve_id", F.coalesce("score", F.lit("")).alias("score")).agg(F.count("*").cast("int").alias("n"))


@register("scan_labels", "SELECT * FROM f_software_labels")
def _scan_labels(s, d):
    lab = I.software_labels(s, d)
    out = scratch_path(s, "label_software")
    (lab.select(F.monotonically_increasing_id().cast("string").alias("_idx"), *K.SOFTWARE_KEYS, "match",
                "t_cve_name").write.option("header", True).csv(out))
    return S.scan_labels(s, out, K.SOFTWARE_KEYS, [], ["t_cve_name"])


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"


@register("scan_stop_words", f"""SELECT tok AS word, count(*) AS n FROM (
 SELECT unnest(list_filter(string_split_regex(trim(translate(publisher0, '_.,()+!', '       ')), '\\s+'),
  lambda t: t <> '')) AS tok FROM (SELECT DISTINCT lower(replace(Publisher0, ' ', '_')) AS publisher0 FROM inv
  WHERE Publisher0 IS NOT NULL) p) t WHERE list_contains({_STOP_SQL}, tok) GROUP BY tok""")
def _scan_stop_words(s, d):
    out = scratch_path(s, "stop_words")
    s.createDataFrame(list(enumerate(K.STOP_WORDS)), "idx int, word string").coalesce(1) \
        .write.csv(out)
    stop = S.scan_stop_words(s, out)
    from ..operators import candidates as CA
    toks = CA.prepare_publishers(I.inventory(s, d)).select(F.explode("pub0_toks").alias("word"))
    return toks.where(F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n"))


@register("load_stage", "SELECT * FROM vulns")
def _load_stage(s, d):
    base = scratch_path(s, "stages")
    table, names = I.grouped_vulns(s, d, ["Site_X"])
    S.save_stage(table, base, "sft_vuln", partition_by=["Site_X"])
    rows = RU.flatten(S.load_stage(s, base, "sft_vuln"))
    return rows.select(*[c for c in names if c != "Site_X"], "Site_X")      # last, as read from its folders


@register("save_stage", "SELECT * FROM inv")
def _save_stage(s, d):
    base = scratch_path(s, "stages")
    inv = I.inventory(s, d)
    S.save_stage(inv, base, "add_rem", partition_by=["arch_X"])
    return S.load_stage(s, base, "add_rem", inv.schema)


@register("host_with_vuln_bucketed", "SELECT * FROM vulns")
def _bucketed(s, d):
    """The host x vulnerability table from an inventory stage bucketed by product."""
    base = scratch_path(s, "bucketed")
    S.save_bucketed(C.inv_drop_unused(I.inventory(s, d)), base, "add_rem", ["DisplayName0", "Version0"], 16)
    return RU.hosts_with_vulns_bucketed(I.enriched_hosts(s, d), *S.load_bucketed(s, base, "add_rem"),
                                        I.labelled_software_match(s, d), I.worst(s, d))


_WIDE, _CAST = "more fields than the header", "not a bigint: ResourceID"


@register("scan_rejects", f"""SELECT source, reason, count(*) AS n FROM (
 SELECT 'software' AS source, CASE WHEN ResourceID % 97 = 3 THEN '{_WIDE}' WHEN ResourceID % 101 = 5 THEN '{_CAST}'
  ELSE 'kept' END AS reason FROM f_inventory
 UNION ALL SELECT 'entry', CASE WHEN CAST(split_part(cve_id, '-', 3) AS INT) % 89 = 7 THEN 'malformed entry' ELSE 'kept' END
  FROM f_cve) r GROUP BY source, reason""")
def _scan_rejects(s, d):
    """Dumps and feeds with broken rows among them: what is kept and what is rejected add up to what was written."""
    cols = ["ResourceID", "DisplayName0", "Publisher0", "Version0"]
    rid = F.col("ResourceID")
    cells = [F.when(rid % 101 == 5, F.concat(F.lit("x"), rid.cast("string"))).otherwise(rid.cast("string")),
             *[F.coalesce(c, F.lit("")) for c in cols[1:]]]
    line = F.concat(F.concat_ws("|", *cells), F.when(rid % 97 == 3, "|surplus").otherwise(""))
    dump = S.write_lines(fixture(s, d, "f_inventory").select(line.alias("value")), scratch_path(s, "broken_dump"), "|".join(cols))
    wanted = T.StructType([f for f in S.SOFTWARE_SCHEMA.fields if f.name in cols])
    kept, bad = S.split_dump(s, dump, wanted, encoding="UTF-8")

    cve = F.col("cve_id")
    broken = F.split_part(cve, F.lit("-"), F.lit(3)).cast("int") % 89 == 7
    entry = F.concat(F.lit('<entry id="'), cve, F.lit('"><vuln:cve-id>'), cve,
                     F.when(broken, "</entry>").otherwise("</vuln:cve-id></entry>"))
    feed = S.write_lines(fixture(s, d, "f_cve").select(entry.alias("value")), scratch_path(s, "broken_feed"),
                         "<?xml version='1.0' encoding='UTF-8'?>\n" + S.NVD_ROOT[0], S.NVD_ROOT[1])
    fine, malformed = S.split_xml(s, feed, "entry", S.CVE_XML_SCHEMA)

    base, out = scratch_path(s, "quarantine"), None
    for source, good, rejected in (("software", kept, bad), ("entry", fine, malformed)):
        S.save_stage(rejected, base, source)
        rows = (S.load_stage(s, base, source, rejected.schema).select("reason")
                .union(good.select(F.lit("kept").alias("reason")))).groupBy("reason").agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(source).alias("source"), "reason", "n")
        out = rows if out is None else out.union(rows)
    return out


@register("export_raw_csv", "SELECT * FROM vulns")
def _export_raw_csv(s, d):
    items, products = I.folded_vulns(s, d)
    out = scratch_path(s, "sft_vuln_raw")
    S.export_raw_csv(items, out, products=products)
    names = [c for c in items.columns if c != RU.TIMES] + RU.product_columns(products)
    return s.read.schema(RU.unfold(items, products).select(names).schema).option("header", True).option("sep", S.SEP).csv(out)


@register("export_json_reports", " UNION ALL ".join([
    CAT.TOP_REPORT_SQL, CAT.SITE_REPORT_SQL, CAT.CUSTOM_REPORTS_SQL]))
def _export_json(s, d):
    """All report files from one pass over the host x vulnerability table, written and read back."""
    items, products = I.folded_vulns(s, d)
    vulns = RU.count_folded(items, products, ["Site_X", "HostFn_X", "VIP_X", "Region_X"])
    cube = materialize(R.count_cube(vulns, "Region_A", RU.TIMES), "report_counts")
    made = R.run_reports(cube)
    paths = S.export_json_reports(made, scratch_path(s, "reports"))
    return E.report_rows({k: s.read.schema(made[k].schema).json(p) for k, p in paths.items()})


# --- 2.3 / 2.4 nested data --------------------------------------------------------

register("cpe_flatten_name", "SELECT name AS _name, cpe23 FROM f_cpe")(
    lambda s, d: I.cpe_xml_shape(s, d).select("_name", F.col("`cpe-23:cpe23-item`._name").alias("cpe23")))

register("cpe_title_en", "SELECT name, title FROM cpe_x")(
    lambda s, d: C.cpe_from_xml(I.cpe_xml_shape(s, d)).select("name", "title"))

register("cve_has_cvss", "SELECT cve_id FROM f_cve WHERE score IS NOT NULL")(
    lambda s, d: C.cve_has_cvss(I.cve_xml_shape(s, d)).select(F.col("`vuln:cve-id`").alias("cve_id")))


@register("cve_flatten_cvss", """SELECT cve_id, score, vector, complexity, 'NONE' AS authentication,
 'PARTIAL' AS confidentiality, 'PARTIAL' AS integrity, 'NONE' AS availability, 'nvd' AS cvss_src
 FROM f_cve WHERE score IS NOT NULL""")
def _cve_flatten(s, d):
    x = C.cve_has_cvss(I.cve_xml_shape(s, d))
    return x.select(F.col("`vuln:cve-id`").alias("cve_id"),
                    *[F.col(f"{C.CVSS}.`{k}`").alias(v) for k, v in C.CVSS_FIELDS.items()])


register("cve_prune_columns", "SELECT * FROM cve_x")(lambda s, d: C.cve_from_xml(I.cve_xml_shape(s, d)))

register("cve_explode_products", """SELECT cve_id, product FROM f_cve WHERE complexity IS NOT NULL
 UNION ALL SELECT cve_id, product || ':sp1' FROM f_cve WHERE complexity IS NOT NULL AND vector = 'LOCAL'""")(
    lambda s, d: I.cve_xml_shape(s, d).select(
        F.col("`vuln:cve-id`").alias("cve_id"),
        F.explode("`vuln:vulnerable-software-list`.`vuln:product`").alias("product")))

register("cve_product_cvss", "SELECT cve_id, product, score, vector, complexity FROM cve_x")(
    lambda s, d: C.cve_from_xml(I.cve_xml_shape(s, d)).select("cve_id", "product", "score", "vector", "complexity"))


@register("worst_case_from_feeds", """SELECT * FROM (SELECT product AS cpe_prod, max(try_cast(score AS DOUBLE)) AS cvss_score,
 ['HIGH', 'MEDIUM', 'LOW'][max(list_position(['HIGH', 'MEDIUM', 'LOW'], complexity))] AS cvss_acc_cmpl_cat,
 ['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'][max(list_position(['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'], vector))] AS cvss_acc_vect_cat
 FROM cve_x WHERE NOT coalesce(regexp_matches(product, '(?i)cpe:/[oh]:'), false) GROUP BY product) w""")
def _worst_from_feeds(s, d):
    from ..operators import rollup as RU
    return RU.worst_case(C.cve_from_xml(I.cve_xml_shape(s, d))).drop("crit_X_cat")


# --- 2.12 incremental refresh ---------------------------------------------------------

_YEAR = r"^CVE-([0-9]+)-"


def _manifest(cve):
    """Per feed year: an order-free digest of the year's rows (sums of row hashes, combined map-side)."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("cve_id", "product", "score", "complexity", "vector")]))
    half = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    digest = F.concat_ws(":", F.count("*").cast("string"), F.sum(half).cast("string"))
    year = F.regexp_extract("cve_id", _YEAR, 1).cast("int")
    return cve.groupBy(year.alias("year")).agg(F.sha2(digest, 256).alias("sha256"))


_MANIFEST_SQL = """SELECT CAST(regexp_extract(cve_id, '^CVE-([0-9]+)-', 1) AS INTEGER) AS year,
 sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(md5(concat_ws('|', cve_id, coalesce(product, ''),
  coalesce(score, ''), coalesce(complexity, ''), coalesce(vector, ''))), 1, 15) AS HUGEINT)) AS VARCHAR)) AS sha256
 FROM {src} GROUP BY 1"""


@register("feeds_changed", f""", mnew AS ({_MANIFEST_SQL.format(src='f_cve')}),
 mold AS ({_MANIFEST_SQL.format(src="(SELECT cve_id, product, CASE WHEN cve_id LIKE '%9' THEN '0.0' ELSE score END AS score, complexity, vector FROM f_cve)")})
SELECT * FROM mnew WHERE NOT EXISTS (SELECT 1 FROM mold WHERE mold.year = mnew.year AND mold.sha256 = mnew.sha256)""")
def _feeds_changed(s, d):
    """The stored manifest is of an earlier state with other scores for some entries; both pass through metadata text."""
    from ..streaming import incremental as INC
    cve = I.cve(s, d)
    before = cve.withColumn("score", F.when(F.col("cve_id").endswith("9"), "0.0").otherwise(F.col("score")))
    new, old = (_land_meta(s, _manifest(x)) for x in (cve, before))
    return INC.feeds_changed(*[INC.scan_feed_meta(s, p).select(
        F.regexp_extract(F.col("lastModifiedDate"), "^([0-9]+)", 1).cast("int").alias("year"), "sha256") for p in (new, old)])


def _land_meta(s, manifest) -> str:
    """One metadata text per feed year: key:value lines."""
    out = scratch_path(s, "feed_meta")
    lines = manifest.select(F.explode(F.array(
        F.concat(F.lit("lastModifiedDate:"), F.col("year").cast("string"), F.lit("-05-01T03:00:00-04:00")),
        F.concat(F.lit("size:"), F.col("year").cast("string")),
        F.concat(F.lit("sha256:"), F.upper("sha256")))).alias("value"), "year")
    lines.repartition("year").write.partitionBy("year").option("lineSep", "\r\n").text(out)
    return out


@register("scan_feed_meta", f"""SELECT CAST(year AS VARCHAR) || '-05-01T03:00:00-04:00' AS "lastModifiedDate",
 CAST(year AS BIGINT) AS size, sha256 FROM ({_MANIFEST_SQL.format(src='f_cve')}) m""")
def _scan_feed_meta(s, d):
    from ..streaming import incremental as INC
    return INC.scan_feed_meta(s, _land_meta(s, _manifest(I.cve(s, d)))).drop("feed")


@register("catalogue_stale", """SELECT name, CAST(fetched AS VARCHAR) AS fetched FROM (SELECT name, CASE WHEN length(name) % 11 <> 0
 THEN DATE '2017-05-20' - CAST(length(name) % 15 AS INTEGER) END AS fetched FROM f_cpe) c
 WHERE fetched IS NULL OR date_diff('day', fetched, DATE '2017-05-20') > 7""")
def _catalogue_stale(s, d):
    """The seven-day rule, over catalogue rows with a fetch date each."""
    from ..streaming import incremental as INC
    n = F.char_length("name")
    rows = fixture(s, d, "f_cpe").select("name", F.lit("2017-05-20").cast("date").alias("now"), F.when(
        n % 11 != 0, F.date_sub(F.lit("2017-05-20").cast("date"), n % 15)).alias("fetched"))
    return INC.catalogue_stale(rows).select("name", F.col("fetched").cast("string").alias("fetched"))


# entries before and after their feeds are published again: some scores change, some entries lose their
# products, some their CVSS, some vanish
_AGAIN = """again AS (SELECT cve_id, product, CASE WHEN cve_id LIKE '%3' THEN '9.9' WHEN cve_id LIKE '%5' THEN NULL
 ELSE score END AS score, complexity, vector FROM f_cve WHERE score IS NOT NULL AND complexity IS NOT NULL
 AND cve_id NOT LIKE '%7' AND cve_id NOT LIKE '%1')"""


def _land_again(s, d, landing: str) -> None:
    shape = I.cve_xml_shape(s, d).where(F.col("_feed") == 2000).drop("_feed")
    cid, cvss = F.col("`vuln:cve-id`"), F.col("`vuln:cvss`")
    base = cvss["cvss:base_metrics"].withField("`cvss:score`", F.when(
        cid.endswith("3"), "9.9").otherwise(cvss["cvss:base_metrics"]["cvss:score"]))
    lists = "vuln:vulnerable-software-list"
    changed = (shape.where(~cid.endswith("7"))
               .withColumn("vuln:cvss", F.when(cvss.isNotNull() & ~cid.endswith("5"), F.struct(base.alias("cvss:base_metrics"))))
               .withColumn(lists, F.when(cid.endswith("1"), F.struct(F.lit(None).cast("array<string>").alias("vuln:product")))
                           .otherwise(F.col(f"`{lists}`")))
               .withColumn("vuln:last-modified-datetime", F.lit("2018-01-01T00:00:00.000-04:00")))
    S.write_cve_xml(changed, os.path.join(landing, f"{K.CVE_FILE_PREFIX}2000.xml"))
    # the other feed loses the entries it had repeated
    second = I.cve_xml_shape(s, d).where(F.col("_feed") == 2001).drop("_feed")
    S.write_cve_xml(second, os.path.join(landing, f"{K.CVE_FILE_PREFIX}2001.xml"))


@register("refresh", f""", {_AGAIN}, exploded AS (SELECT cve_id, product, score, complexity, vector FROM again WHERE score IS NOT NULL
 UNION ALL SELECT cve_id, product || ':sp1', score, complexity, vector FROM again WHERE score IS NOT NULL AND vector = 'LOCAL')
SELECT *, {I.CRIT_SQL} AS crit_X_cat FROM (SELECT product AS cpe_prod, max(try_cast(score AS DOUBLE)) AS cvss_score,
 ['HIGH', 'MEDIUM', 'LOW'][max(list_position(['HIGH', 'MEDIUM', 'LOW'], complexity))] AS cvss_acc_cmpl_cat,
 ['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'][max(list_position(['LOCAL', 'ADJACENT_NETWORK', 'NETWORK'], vector))] AS cvss_acc_vect_cat
 FROM exploded WHERE NOT coalesce(regexp_matches(product, '(?i)cpe:/[oh]:'), false) GROUP BY product) w""")
def _refresh(s, d):
    """A first load, then the same feeds published again with other content under the same names."""
    from ..streaming import incremental as INC
    landing = _land_feeds(s, d)
    base = scratch_path(s, "refresh")
    state, checkpoint = os.path.join(base, "state"), os.path.join(base, "checkpoint")
    INC.refresh(s, landing, state, checkpoint)
    _land_again(s, d, landing)
    return INC.refresh(s, landing, state, checkpoint)
