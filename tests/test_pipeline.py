import tempfile

from pyspark.sql import functions as F

from cpelink.operators import clean as C
from cpelink.operators import enrich as E
from cpelink.plans import inputs as I
from cpelink.plans.fixtures import fixture
from cpelink.plans.pipeline import Inputs, run


def test_pipeline_end_to_end(spark, sf_dir):
    inp = Inputs(
        hosts=fixture(spark, sf_dir, "f_hosts"),
        software=fixture(spark, sf_dir, "f_inventory"),
        cpe=fixture(spark, sf_dir, "f_cpe"),
        cve=fixture(spark, sf_dir, "f_cve"),
        vendor_labels=I.vendor_labels(spark, sf_dir),
        software_labels=I.software_labels(spark, sf_dir),
    )
    regions = fixture(spark, sf_dir, "f_site_regions")
    group = fixture(spark, sf_dir, "f_ad_group")
    out = run(spark, inp, tempfile.mkdtemp(prefix="cpelink-stages-"),
              enrich=lambda h: E.enrich_hosts(h, regions, group),
              reports=lambda v: E.custom_reports(v))
    vm = {(r.publisher0, r.vendor_X) for r in out["vendor_match"].collect()}
    # labelled positives keep their label
    pos = {(r.publisher0, r.vendor_X) for r in I.vendor_labels(spark, sf_dir).where("match = 1").collect()}
    pubs = {r.publisher0 for r in C.clean_inventory(inp.software).select(
        F.lower(F.translate("Publisher0", " ", "_")).alias("publisher0")).distinct().collect()}
    vens = {r.vendor_X for r in C.clean_cpe(inp.cpe).select("vendor_X").distinct().collect()}
    # only candidates can be matched: one name is part of the other
    kept = {p for p in pos if p[0] in pubs and p[1] in vens and p[1] in p[0]}
    assert kept and kept <= vm
    # labelled negatives never come back
    neg = {(r.publisher0, r.vendor_X) for r in I.vendor_labels(spark, sf_dir).where("match = 0").collect()}
    assert not (neg & vm)
    sm = out["software_match"]
    assert sm.where(F.col("vendor_X") == "microsoft").count() == 0
    assert sm.count() > 0
    v = out["sft_vuln"]
    assert {"Region_X", "HostFn_X", "VIP_X", "crit_X_cat", "t_cve_name"} <= set(v.columns)
    assert v.count() > 0
    assert out["top25_sft_high"].count() <= 25
    assert "host_vuln_by_fn" in out


def test_pipeline_resume_skips_committed_stages(spark, sf_dir):
    inp = Inputs(
        hosts=fixture(spark, sf_dir, "f_hosts"),
        software=fixture(spark, sf_dir, "f_inventory"),
        cpe=fixture(spark, sf_dir, "f_cpe"),
        cve=fixture(spark, sf_dir, "f_cve"),
        vendor_labels=I.vendor_labels(spark, sf_dir),
        software_labels=I.software_labels(spark, sf_dir),
    )
    d = tempfile.mkdtemp(prefix="cpelink-resume-")
    first = run(spark, inp, d, resume=True)
    a = sorted(tuple(r) for r in first["top25_sft_high"].collect())
    # a second run finds every stage committed and trains nothing
    second = run(spark, inp, d, resume=True)
    assert sorted(tuple(r) for r in second["top25_sft_high"].collect()) == a
    # other inputs: the stages are computed again
    inp.cve = inp.cve.withColumn("score", F.lit("0.1"))
    third = run(spark, inp, d, resume=True)
    assert third["top25_sft_high"].count() == 0 and a


def test_pipeline_writes_an_item_once_with_all_its_products(spark):
    from collections import Counter

    from cpelink.operators import rollup as RU
    from cpelink.sources import files as S
    hosts = spark.createDataFrame([(1, 1, "s1", "CN=a", "d"), (2, 1, "s2", "CN=b", "d"), (3, 0, "s3", "CN=c", "d")],
                                  "ResourceID long, Active0 int, AD_Site_Name0 string, Distinguished_Name0 string, Resource_Domain_OR_Workgr0 string")
    # two vendors have a product of the same title and version
    names = [("acme", "tool kit"), ("acme works", "tool kit"), ("borg", "draw pad")]
    software = spark.createDataFrame([(h, d, p, "1.0", True) for h in (1, 2, 3) for p, d in names],
                                     "ResourceID long, DisplayName0 string, Publisher0 string, Version0 string, arch_X boolean")
    vendors = [p.replace(" ", "_") for p, _ in names]
    cpe = spark.createDataFrame([(f"cpe:/a:{v}:{d.replace(' ', '_')}:1.0", f"cpe:2.3:a:{v}:{d.replace(' ', '_')}:1.0:*:*:*:*:*:*:*", d, None)
                                 for v, (_, d) in zip(vendors, names)], "name string, cpe23 string, title string, deprecated string")
    cve = cpe.select(F.lit("CVE-1").alias("cve_id"), F.col("name").alias("product"), F.lit("9.0").alias("score"),
                     F.lit("LOW").alias("complexity"), F.lit("NETWORK").alias("vector"))
    vlabels = spark.createDataFrame([(v, w, int(v == w)) for v in vendors for w in vendors], "publisher0 string, vendor_X string, match int")
    slabels = spark.createDataFrame([(v, d.replace(" ", "_"), d, d, "1.0", "1.0", 1, f"cpe:/a:{v}:{d.replace(' ', '_')}:1.0")
                                     for v, (_, d) in zip(vendors, names)],
                                    "vendor_X string, software_X string, title_X string, DisplayName0 string, release_X string, Version0 string, match int, t_cve_name string")
    d = tempfile.mkdtemp(prefix="cpelink-nested-")
    out = run(spark, Inputs(hosts, software, cpe, cve, vlabels, slabels), d)
    stored, table = S.load_stage(spark, d, "sft_vuln"), out["sft_vuln"]
    whole = RU.hosts_with_vulns(C.clean_hosts(hosts), C.clean_inventory(software), out["software_match"], RU.worst_case(cve))
    assert table.columns == whole.columns
    assert Counter(map(tuple, table.collect())) == Counter(map(tuple, whole.collect()))
    assert table.count() == 2 * (2 + 2 + 1)                     # active hosts; an item of the shared title has two rows
    assert stored.count() == 2 * 3 and stored.agg(F.sum(F.size(RU.NESTED))).first()[0] == table.count()
    assert {r.t_cve_name: r.n for r in out["top25_sft_high"].collect()} == {
        "cpe:/a:acme:tool_kit:1.0": 4, "cpe:/a:acme_works:tool_kit:1.0": 4, "cpe:/a:borg:draw_pad:1.0": 2}
