import os
import tempfile

import pytest

from cpelink.operators import clean as C
from cpelink.sources import files as S


def _tmp():
    return tempfile.mkdtemp(prefix="cpelink-src-")


def _write_utf16(path, lines):
    with open(path, "wb") as f:
        f.write("\r\n".join(lines).encode("utf-16"))  # BOM + little endian
        f.write("\r\n".encode("utf-16-le"))


def test_utf16_dump_rows(spark):
    d = _tmp()
    p = os.path.join(d, "hosts.csv")
    _write_utf16(p, [
        "ResourceID|Active0|AD_Site_Name0|Distinguished_Name0|Resource_Domain_OR_Workgr0",
        '1|1|NTH|"CN=a|b,OU=HQ Desktop"|CORP',
        "2|0|STH|CN=b,OU=Field Laptop|CORP",
        "3|1|EST",
        "4|1|WST|CN=d|CORP|extra|more",
        "5|1|Zürich|CN=é\u0000|CORP",
    ])
    rows = {r.ResourceID: r for r in S.scan_hosts(spark, p).collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert rows[1].Distinguished_Name0 == "CN=a|b,OU=HQ Desktop"
    assert rows[1].Resource_Domain_OR_Workgr0 == "CORP"
    assert rows[3].Distinguished_Name0 is None and rows[3].Resource_Domain_OR_Workgr0 is None
    assert rows[5].AD_Site_Name0 == "Zürich" and rows[5].Distinguished_Name0 == "CN=é"
    hosts = C.clean_hosts(S.scan_hosts(spark, p))
    assert {r.ResourceID for r in hosts.collect()} == {1, 3, 5}


def test_dump_columns_by_name(spark):
    d = _tmp()
    p = os.path.join(d, "hosts.csv")
    _write_utf16(p, [
        "Client0|Active0|ResourceID|Resource_Domain_OR_Workgr0|AD_Site_Name0|Distinguished_Name0|Build0",
        "c|1|1|CORP|NTH|CN=a|10",
        "c|0|2|CORP|STH|CN=b|",
        "c|1|3|CORP|EST",
        "c|1|4|CORP|WST|CN=d|10|surplus",
        "c|1|5|CORP|WST|CN=e|10||x",
        "c|1|6|CORP|WST|CN=f|10|",
        'c|1|7|CORP|WST|"CN=g|h"|10',
    ])
    df = S.scan_hosts(spark, p)
    rows = {r.ResourceID: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 7}
    assert df.select("ResourceID").count() == 4  # the width counts whatever is selected
    assert (rows[1].Active0, rows[1].AD_Site_Name0, rows[1].Distinguished_Name0) == (1, "NTH", "CN=a")
    assert rows[3].AD_Site_Name0 == "EST" and rows[3].Distinguished_Name0 is None
    assert rows[7].Distinguished_Name0 == "CN=g|h"


def test_dump_without_a_column_fails(spark):
    p = os.path.join(_tmp(), "hosts.csv")
    _write_utf16(p, ["ResourceID|Active0|AD_Site_Name0|Distinguished_Name0", "1|1|NTH|CN=a"])
    with pytest.raises(ValueError, match="Resource_Domain_OR_Workgr0"):
        S.scan_hosts(spark, p)


def test_labels_by_name(spark):
    p = os.path.join(_tmp(), "labels.csv")
    with open(p, "w") as f:
        f.write(",match,vendor_X,note,publisher0\n0,1,acme,x,acme_inc\n1,0,beta,y,acme_inc\n")
    rows = S.scan_labels(spark, p, ["publisher0", "vendor_X"], []).collect()
    assert [tuple(r) for r in rows] == [("acme_inc", "acme", 1), ("acme_inc", "beta", 0)]


def test_empty_dump_keeps_schema(spark):
    d = _tmp()
    p = os.path.join(d, "x86.csv")
    _write_utf16(p, ["ResourceID|AgentID|DisplayName0|GroupID|InstallDate0|ProdID0|Publisher0|RevisionID|TimeStamp|Version0"])
    q = os.path.join(d, "x64.csv")
    _write_utf16(q, ["ResourceID|AgentID|DisplayName0|GroupID|InstallDate0|ProdID0|Publisher0|RevisionID|TimeStamp|Version0",
                     "7|a|Foo|g|d|p|Acme Inc|r|t|1.0"])
    sw = S.scan_software(spark, p, q)
    rows = sw.collect()
    assert len(rows) == 1 and rows[0].arch_X is True and rows[0].Version0 == "1.0"
    assert "arch_X" in sw.columns


def test_ad_group_comments(spark):
    d = _tmp()
    p = os.path.join(d, "vip.csv")
    _write_utf16(p, ["#TYPE Selected.Microsoft.ActiveDirectory", '"distinguishedName"', '"CN=a,OU=x,DC=y"'])
    assert [r.distinguishedName for r in S.scan_ad_group(spark, p).collect()] == ["CN=a,OU=x,DC=y"]


CPE_DOC = """<?xml version='1.0' encoding='UTF-8'?>
<cpe-list xmlns="http://cpe.mitre.org/dictionary/2.0" xmlns:cpe-23="http://scap.nist.gov/schema/cpe-extension/2.3">
<cpe-item name="cpe:/a:acme:widget:1.0"><title xml:lang="fr-FR">Widget FR</title><title xml:lang="en-US">Acme Widget 1.0</title>
<cpe-23:cpe23-item name="cpe:2.3:a:acme:widget:1.0:*:*:*:*:*:*:*"/></cpe-item>
<cpe-item name="cpe:/a:acme:gadget:2" deprecated="true" deprecation_date="2011-01-01"><title xml:lang="en-US">Old</title>
<cpe-23:cpe23-item name="cpe:2.3:a:acme:gadget:2:*:*:*:*:*:*:*"/></cpe-item>
<cpe-item name="cpe:/o:acme:os:3"><title xml:lang="en-US">Acme OS</title>
<cpe-23:cpe23-item name="cpe:2.3:o:acme:os:3:*:*:*:*:*:*:*"/></cpe-item>
<cpe-item name="cpe:/a:acme:tool:-"><title xml:lang="de-DE">Werkzeug</title>
<cpe-23:cpe23-item name="cpe:2.3:a:acme:tool:-:*:*:*:*:*:*:*"/></cpe-item>
</cpe-list>
"""


def test_cpe_xml(spark):
    d = _tmp()
    p = os.path.join(d, "official-cpe-dictionary_v2.3.xml")
    with open(p, "w") as f:
        f.write(CPE_DOC)
    cpe = C.clean_cpe(C.cpe_from_xml(S.scan_cpe_xml(spark, p)))
    rows = {r.cpe_name: r for r in cpe.collect()}
    assert set(rows) == {"cpe:/a:acme:widget:1.0", "cpe:/a:acme:tool:-"}
    assert rows["cpe:/a:acme:widget:1.0"].title_X == "Acme Widget 1.0"
    assert rows["cpe:/a:acme:tool:-"].title_X == "Werkzeug"
    assert rows["cpe:/a:acme:tool:-"].release_X == "-"
    assert rows["cpe:/a:acme:widget:1.0"].vendor_X == "acme"


CVE_DOC = """<?xml version='1.0' encoding='UTF-8'?>
<nvd xmlns="http://scap.nist.gov/schema/feed/vulnerability/2.0" xmlns:vuln="http://scap.nist.gov/schema/vulnerability/0.4" xmlns:cvss="http://scap.nist.gov/schema/cvss-v2/0.2">
<entry id="CVE-1"><vuln:vulnerable-software-list><vuln:product>cpe:/a:acme:widget:1.0</vuln:product><vuln:product>cpe:/o:acme:os:3</vuln:product></vuln:vulnerable-software-list>
<vuln:cve-id>CVE-1</vuln:cve-id><vuln:last-modified-datetime>2017-01-01T00:00:00</vuln:last-modified-datetime>
<vuln:cvss><cvss:base_metrics><cvss:score>8.7</cvss:score><cvss:access-vector>NETWORK</cvss:access-vector><cvss:access-complexity>LOW</cvss:access-complexity></cvss:base_metrics></vuln:cvss></entry>
<entry id="CVE-2"><vuln:vulnerable-software-list><vuln:product>cpe:/a:acme:widget:1.0</vuln:product></vuln:vulnerable-software-list>
<vuln:cve-id>CVE-2</vuln:cve-id><vuln:last-modified-datetime>2017-01-01T00:00:00</vuln:last-modified-datetime></entry>
<entry id="CVE-3"><vuln:cve-id>CVE-3</vuln:cve-id><vuln:last-modified-datetime>2017-01-01T00:00:00</vuln:last-modified-datetime>
<vuln:cvss><cvss:base_metrics><cvss:score>5.0</cvss:score></cvss:base_metrics></vuln:cvss></entry>
<entry id="CVE-4"><vuln:vulnerable-software-list><vuln:product>cpe:/a:acme:tool:-</vuln:product></vuln:vulnerable-software-list>
<vuln:cve-id>CVE-4</vuln:cve-id><vuln:last-modified-datetime>2017-01-01T00:00:00</vuln:last-modified-datetime>
<vuln:cvss><cvss:base_metrics><cvss:score>x</cvss:score><cvss:access-vector>LOCAL</cvss:access-vector><cvss:access-complexity>HIGH</cvss:access-complexity></cvss:base_metrics></vuln:cvss></entry>
</nvd>
"""


def test_cve_xml_and_worst_case(spark):
    from cpelink.operators import rollup as RU
    d = _tmp()
    with open(os.path.join(d, "nvdcve-2.0-2017.xml"), "w") as f:
        f.write(CVE_DOC)
    with open(os.path.join(d, "unrelated.xml"), "w") as f:
        f.write(CVE_DOC.replace("CVE-1", "CVE-9"))
    cve = C.cve_from_xml(S.scan_cve_xml(spark, d))
    assert sorted((r.cve_id, r.product) for r in cve.collect()) == [
        ("CVE-1", "cpe:/a:acme:widget:1.0"), ("CVE-1", "cpe:/o:acme:os:3"), ("CVE-4", "cpe:/a:acme:tool:-")]
    w = {r.cpe_prod: r for r in RU.worst_case(cve).collect()}
    assert set(w) == {"cpe:/a:acme:widget:1.0", "cpe:/a:acme:tool:-"}
    assert w["cpe:/a:acme:widget:1.0"].crit_X_cat == "High"
    assert w["cpe:/a:acme:tool:-"].cvss_score is None and w["cpe:/a:acme:tool:-"].crit_X_cat == "Low"


def test_stage_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, s string, arch_X boolean")
    S.save_stage(df, d, "t", ["s"])
    back = S.load_stage(spark, d, "t")
    assert sorted((r.id, r.s, r.arch_X) for r in back.collect()) == [(1, "a", True), (2, "b", False)]


def test_ad_group_unquoted_header(spark):
    d = _tmp()
    p = os.path.join(d, "vip2.csv")
    # an unquoted DN splits into three fields: an over-long row, skipped
    _write_utf16(p, ["#TYPE x", "distinguishedName", "CN=b,OU=x,DC=y", '"CN=c,OU=x,DC=y"', "plain"])
    assert sorted(r.distinguishedName for r in S.scan_ad_group(spark, p).collect()) == [
        "CN=c,OU=x,DC=y", "plain"]


def test_folder_of_unlike_layouts(spark):
    """Files of one folder with their columns in other orders, other columns and any number of comment lines."""
    d = _tmp()
    for k, lines in enumerate([
            ["publisher0,vendor_X,match,a", "acme_inc,acme,1,5"], ["vendor_X,a,publisher0,match", "beta,6,beta_inc,0"],
            ["x,match,publisher0,vendor_X,a", '"1,2",1,"gamma, inc",gamma,7', "1,1,delta,delta,8,9"],
            ["match,a,vendor_X,publisher0", "oops,1,eps,eps_inc"]]):
        with open(os.path.join(d, f"{k}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    rows = sorted(tuple(r) for r in S.scan_labels(spark, d, ["publisher0", "vendor_X"], ["a"]).collect() if r.publisher0 != "eps_inc")
    assert rows == [("acme_inc", "acme", 1, 5), ("beta_inc", "beta", 0, 6), ("gamma, inc", "gamma", 1, 7)]
    p = os.path.join(_tmp(), "vip.csv")
    _write_utf16(p, ["#" + "x" * 40] * 3000 + ['"distinguishedName","other"', '"CN=a","b"', '"CN=c","d"'])
    got = [r.distinguishedName for r in S.scan_ad_group(spark, p).collect()]
    assert got == ["CN=a", "CN=c"]
    with pytest.raises(ValueError, match="no header line"):
        S.scan_ad_group(spark, os.path.join(_tmp(), "none*"))


def test_rejects_hold_what_is_not_kept(spark):
    d = _tmp()
    p = os.path.join(d, "hosts.csv")
    _write_utf16(p, ["ResourceID|Active0|AD_Site_Name0|Distinguished_Name0|Resource_Domain_OR_Workgr0", "1|1|s|dn|w", "x2|1|s|dn|w",
                     "3|yes|s|dn|w", "4|1|s|dn|w|more", "5||s", '6|1|"a|b"|dn|w'])
    good, bad = S.split_dump(spark, p, S.HOSTS_SCHEMA)
    assert sorted(r.ResourceID for r in good.collect()) == [1, 5, 6]
    found = sorted((r.reason, r.row.split("|")[0]) for r in bad.collect())
    assert found == [("more fields than the header", "4"), ("not a bigint: ResourceID", "x2"), ("not a int: Active0", "3")]
    assert all(r.file.endswith("hosts.csv") for r in bad.collect())


def test_malformed_entry_loses_only_itself(spark):
    d = _tmp()
    broken = CVE_DOC.replace("<vuln:cve-id>CVE-2</vuln:cve-id>", "<vuln:cve-id>CVE-2</wrong>")
    with open(os.path.join(d, "nvdcve-2.0-2017.xml"), "w") as f:
        f.write(broken)
    assert {r._id for r in S.scan_cve_xml(spark, d).where("_id IS NOT NULL").select("_id").collect()} == {"CVE-1", "CVE-3", "CVE-4"}
    good, bad = S.split_xml(spark, d, "entry", S.CVE_XML_SCHEMA)
    assert sorted(r["_id"] for r in good.collect()) == ["CVE-1", "CVE-3", "CVE-4"]
    rows = bad.collect()
    assert len(rows) == 1 and rows[0].reason == "malformed entry" and "CVE-2" in rows[0].row


def test_bucketed_stage_is_not_shuffled(spark):
    """Joins of the bucketed part by its keys, again and again; hot and null keys beside it; read in any session."""
    d, keys = _tmp(), ["DisplayName0", "Version0"]
    rows = [("hot", "1", k) for k in range(500)] + [(f"p{k % 90}", str(k % 3), k) for k in range(400)] + [("p1", None, k) for k in range(9)]
    df = spark.createDataFrame(rows, "DisplayName0 string, Version0 string, ResourceID long")
    S.save_bucketed(df, d, "inv", keys, 4)
    light, heavy = S.load_bucketed(spark, d, "inv")
    assert sorted(map(tuple, light.union(heavy).collect()), key=str) == sorted(rows, key=str)
    assert {r.DisplayName0 for r in heavy.where("Version0 IS NOT NULL").collect()} == {"hot"}
    vp = spark.createDataFrame([(f"p{k}", "1", k) for k in range(0, 90, 2)], "DisplayName0 string, Version0 string, m int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = light.join(vp, keys)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(n.startswith("p") and v == "1" and int(n[1:]) % 2 == 0 for n, v, _ in rows)
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.sql(f"DROP TABLE {S._bucket_table(os.path.join(d, 'inv', 'light'))}")
    assert sum(x.count() for x in S.load_bucketed(spark, d, "inv")) == len(rows)
    S.save_bucketed(df.limit(10), d, "inv", keys, 4)
    assert sum(x.count() for x in S.load_bucketed(spark, d, "inv")) == 10


def test_profiles_and_reports_from_one_pass(spark):
    from cpelink.operators import enrich as E
    from cpelink.operators import reports as R
    empty = spark.createDataFrame([], "a int, b string")
    assert sorted(map(tuple, R.profile_distinct(empty).collect())) == [("a", 0, 0, 0), ("b", 0, 0, 0)]
    df = spark.createDataFrame([(k % 7, f"x{k % 1000}" if k % 3 else None) for k in range(6000)], "a int, b string")
    exact = {r.column_name: tuple(r)[1:] for r in R.profile_distinct(df).collect()}
    assert exact == {"a": (6000, 7, 6000), "b": (4000, 1000, 6000)}
    halves = [R.distinct_sketches(df.where(w)) for w in ("a < 3", "a >= 3")]
    near = {r.column_name: tuple(r)[1:] for r in R.sketch_counts(R.merge_sketches(halves[0].union(halves[1]))).collect()}
    assert near["a"] == exact["a"] and near["b"][0] == 4000 and abs(near["b"][1] - 1000) < 30
    v = spark.createDataFrame(
        [(f"s{k % 4}" if k % 5 else None, ["server", "desktop", None][k % 3], "vip" if k % 7 == 0 else None,
          ["High", "Low", "Medium"][k % 11 % 3], f"c{k % 13}", f"Region_{'AB'[k % 2]}") for k in range(700)],
        "Site_X string, HostFn_X string, VIP_X string, crit_X_cat string, t_cve_name string, Region_X string")
    plain = {"top25_sft_high": R.top_high(v), "site_by_criticality": R.top_sites(v)} | E.custom_reports(v)
    cube = R.count_cube(v, "Region_A")
    assert cube.count() < 200
    made = R.run_reports(cube)
    assert list(made) == list(plain)
    for name, want in plain.items():
        assert made[name].columns == want.columns
        assert sorted(map(tuple, made[name].collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def _files_of(d, ending):
    return [os.path.join(r, f) for r, _, names in os.walk(d) for f in names if f.endswith(ending)]


def test_raw_export_is_small_and_its_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPORT_FILE_ROWS", 400)
    df = spark.range(0, 1000, 1, 1).selectExpr("id DIV 20 AS host", "concat('CN=host', id DIV 20, ',OU=HQ Desktop') AS dn", "id % 20 AS vendor")
    d, plain = _tmp(), _tmp()
    S.export_raw_csv(df, d)
    S.export_raw_csv(df, plain, compression="none")
    files = _files_of(d, ".csv.gz")
    assert len(files) == 3 and sum(map(os.path.getsize, files)) * 5 < sum(map(os.path.getsize, _files_of(plain, ".csv")))
    back = [spark.read.schema(df.schema).option("header", True).option("sep", S.SEP).csv(x) for x in (d, plain)]
    assert all(sorted(map(tuple, b.collect())) == sorted(map(tuple, df.collect())) for b in back)


def _small_tables(spark):
    """Driver tables with nine installed items (of a null title or version, on inactive or unknown hosts beside them)
    and two titles of several vendors."""
    d = _tmp()
    parts = [(k, ["red nut", "red nut", "red nut", "blue, 'cup'", "blue, 'cup'", None][k % 6], f"Brand#{2 + k // 6 % 3}", "SMALL", 1, 1.0) for k in range(24)]
    tables = {
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, "FRANCE", 0), (1, "SPAIN", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C|1", 0, 9500.0, "BUILDING"), (2, 'C"2', 1, 5.0, "MACHINERY"), (3, "C3", 1, -5.0, "BUILDING"), (4, None, 0, 7.0, None)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(10, 1), (20, 2), (30, 3), (40, 4), (50, 9)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p, n, "F") for o in (10, 20, 30, 40, 50) for n, p in ((1, 0), (1, 0), (2, 3), (6, 1), (7, 2), (3, 5))],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_linestatus string"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(d, f"{name}.parquet"))
    return d


def test_reloaded_stage_holds_an_item_and_a_product_once(spark):
    from collections import Counter
    from cpelink.operators import rollup as RU
    from cpelink.plans import inputs as I
    from cpelink.plans.catalog import QUERIES
    d = _small_tables(spark)
    want, got = I.vulns(spark, d), QUERIES["load_stage"](spark, d)
    assert got.columns == [c for c in want.columns if c != "Site_X"] + ["Site_X"]       # the folders' column last, as before
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect()))
    base = got.inputFiles()[0].split("/Site_X=")[0]
    assert base.endswith("/sft_vuln") and {f.split("/Site_X=")[1].split("/")[0] for f in got.inputFiles()} == {"FRANCE", "SPAIN"}
    stored = spark.read.parquet(base)
    assert sum(len(r[RU.NESTED]) * len(r[RU.INSTALLED]) for r in stored.collect()) == want.count()
    assert sum(len(r[RU.INSTALLED]) for r in stored.collect()) == 9 < want.count()


_ODD = ["a", " b ", "", 'q"x', "p|q", "back\\", '\\"', "#c", "é", None, "tab\t", "'"]


def _folded_odd(spark):
    items = spark.createDataFrame([(i, _ODD[i % 12], _ODD[(i * 5 + 1) % 12], f"t{i % 3}" if i % 7 else _ODD[i % 12], "1.0", i % 2 == 0, 3) for i in range(60)],
                                  "ResourceID long, Site_X string, Region_X string, DisplayName0 string, Version0 string, arch_X boolean, __times long")
    products = spark.createDataFrame([(_ODD[i % 12], f"t{i % 3}" if i % 4 else _ODD[i % 12], "1.0", [1.5, None, 0.0, float("nan")][i % 4], _ODD[(i * 7 + 3) % 12])
                                      for i in range(144)], "vendor_X string, DisplayName0 string, Version0 string, cvss_score double, crit_X_cat string")
    return items, products


def _lines_of(d):
    import gzip
    texts = [gzip.open(f, "rt", encoding="utf-8", newline="\n").read() for f in _files_of(d, ".gz")]
    return [t.split("\n")[:-1] for t in texts if t]


@pytest.mark.parametrize("listed, rows, record", [(100_000, 100, 20), (0, 100, 3), (100_000, 2_000_000, 1)])
def test_folded_export_has_the_text_of_the_whole(spark, monkeypatch, listed, rows, record):
    from collections import Counter
    from cpelink.operators import rollup as RU
    monkeypatch.setattr(RU, "LISTED_PRODUCTS", listed)
    monkeypatch.setattr(S, "EXPORT_FILE_ROWS", rows)
    monkeypatch.setattr(S, "EXPORT_RECORD_ROWS", record)
    items, products = _folded_odd(spark)
    whole = RU.unfold(items, products).select(*[c for c in items.columns if c != RU.TIMES], *RU.product_columns(products))
    plain, d, none = _tmp(), _tmp(), _tmp()
    S.export_raw_csv(whole, plain)
    S.export_raw_csv(items, d, products=products)
    want, got = _lines_of(plain), _lines_of(d)
    assert {f[0] for f in got} == {"|".join(whole.columns)} and all(len(f) <= rows + 1 for f in got)
    assert Counter(x for f in got for x in f[1:]) == Counter(x for f in want for x in f[1:]) and whole.count() > 1_000
    assert sum(len(f) - 1 for f in got) == whole.count()
    S.export_raw_csv(items.limit(0), none, products=products)
    assert _lines_of(none) == [["|".join(whole.columns)]]       # no row: the header alone


def test_raw_export_formats_an_item_once(spark, monkeypatch):
    from collections import Counter
    from cpelink.plans import inputs as I
    from cpelink.plans.catalog import QUERIES
    d, seen, export = _small_tables(spark), [], S.export_raw_csv
    monkeypatch.setattr(S, "export_raw_csv", lambda df, *a, **k: (seen.append(df.count()), export(df, *a, **k))[1])
    want, got = I.vulns(spark, d), QUERIES["export_raw_csv"](spark, d)
    assert got.schema.names == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert seen[0] < want.count()


def test_large_feeds_are_written_as_several_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "DOCUMENT_ROWS", 10)
    d = _tmp()
    shape = spark.createDataFrame([(f"CVE-{k}", f"CVE-{k}", "2017", (["p"],), None) for k in range(35)], S.CVE_XML_SCHEMA).coalesce(1)
    S.write_cve_xml(shape, os.path.join(d, "nvdcve-2.0-2017.xml"))
    assert len(_files_of(d, ".txt")) == 4
    assert sorted(r._id for r in S.scan_cve_xml(spark, d).collect()) == sorted(f"CVE-{k}" for k in range(35))


def test_partitioned_stage_is_written_without_sorting_its_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "OPEN_FILES", 3)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(key), []
    df = spark.range(0, 600, 1, 2).selectExpr("id", "nullif(concat('s', id % 6), 's5') AS site")     # more values than open files
    write, d = S._open_files, _tmp()

    def watched(session):
        seen.append(session)
        return write(session)

    monkeypatch.setattr(S, "_open_files", watched)
    S.save_stage(df, d, "t", ["site"])
    back = S.load_stage(spark, d, "t", df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert seen and spark.conf.get(key) == before


def test_sketches_meet_a_row_once(spark):
    from cpelink.operators import reports as R
    df = spark.createDataFrame([(k % 7, f"x{k % 50}" if k % 3 else None) for k in range(600)], "a int, b string")
    made = R.distinct_sketches(df)
    assert "Generate explode" not in made._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    near = {tuple(r) for r in R.sketch_counts(made).collect()}
    assert near == {("a", 600, 7, 600), ("b", 400, 50, 600)}
    assert R.distinct_sketches(df.where("a > 7")).count() == 0


@pytest.mark.parametrize("rows, n", [(3000, 20), (3000, 3000), (15, 20), (0, 5)])
def test_sample_is_ordered_by_a_column_under_a_bound(spark, rows, n):
    import hashlib
    from cpelink.operators import reports as R
    data = [(k // 3 if k % 11 else None, f"n{k % 5}") for k in range(rows)]
    made = R.sample_rows(spark.createDataFrame(data, "k long, name string"), n, ["k", "name"])
    if rows == 3000 and n == 20:
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort [__h" in plan and "<= " in plan
    key = lambda r: (hashlib.md5("|".join(["42", *[str(x) for x in r if x is not None]]).encode()).hexdigest(), r[0] or -1, r[1])
    assert list(map(tuple, made.collect())) == sorted(data, key=key)[:n]
