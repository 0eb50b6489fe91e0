import os
import tempfile

from pyspark.sql import functions as F

from cpelink import constants as K
from cpelink.operators import clean as C
from cpelink.operators import rollup as RU
from cpelink.plans import inputs as I
from cpelink.sources import files as S
from cpelink.streaming import incremental as INC


def _rows(df):
    return sorted(tuple(r) for r in df.select("cpe_prod", "cvss_score", "cvss_acc_cmpl_cat", "cvss_acc_vect_cat",
                                               "crit_X_cat").collect())


def test_refresh_equals_batch(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="cpelink-inc-")
    landing, state, ckpt = (os.path.join(base, x) for x in ("landing", "state", "ckpt"))
    shape = I.cve_xml_shape(spark, sf_dir).drop("_feed")
    first = shape.where(F.col("`vuln:cvss`.`cvss:base_metrics`.`cvss:access-vector`") != "NETWORK")
    S.write_cve_xml(first, os.path.join(landing, f"{K.CVE_FILE_PREFIX}2016.xml"))
    w1 = INC.refresh(spark, landing, state, ckpt)
    assert _rows(w1) == _rows(RU.worst_case(C.cve_from_xml(first)))

    # second landing: the remaining entries plus newer versions of some old ones
    rest = shape.where(F.col("`vuln:cvss`.`cvss:base_metrics`.`cvss:access-vector`") == "NETWORK")
    newer = (first.where(F.col("`vuln:cvss`.`cvss:base_metrics`.`cvss:access-vector`") == "LOCAL")
             .withColumn("vuln:last-modified-datetime", F.lit("2018-01-01T00:00:00.000-04:00"))
             .withColumn("vuln:cvss", F.struct(F.struct(
                 F.lit("9.9").alias("cvss:score"), F.lit("NETWORK").alias("cvss:access-vector"),
                 F.lit("LOW").alias("cvss:access-complexity"), F.lit(None).cast("string").alias("cvss:authentication"),
                 F.lit(None).cast("string").alias("cvss:confidentiality-impact"),
                 F.lit(None).cast("string").alias("cvss:integrity-impact"),
                 F.lit(None).cast("string").alias("cvss:availability-impact"),
                 F.lit("nvd").alias("cvss:source")).alias("cvss:base_metrics"))))
    S.write_cve_xml(rest.unionByName(newer), os.path.join(landing, f"{K.CVE_FILE_PREFIX}2017.xml"))
    w2 = INC.refresh(spark, landing, state, ckpt)
    batch = RU.worst_case(C.cve_from_xml(S.scan_cve_xml(spark, landing)))
    assert _rows(w2) == _rows(batch)
    assert any(r[1] == 9.9 for r in _rows(w2))

    # nothing new: a third run is a no-op
    w3 = INC.refresh(spark, landing, state, ckpt)
    assert _rows(w3) == _rows(w2)


def _entry(cve, score, products, when="2017-05-01T10:00:00.000-04:00"):
    cvss = "" if score is None else (f"<vuln:cvss><cvss:base_metrics><cvss:score>{score}</cvss:score>"
                                     "<cvss:access-vector>NETWORK</cvss:access-vector><cvss:access-complexity>LOW"
                                     "</cvss:access-complexity></cvss:base_metrics></vuln:cvss>")
    listed = "".join(f"<vuln:product>{p}</vuln:product>" for p in products)
    return (f'<entry id="{cve}"><vuln:vulnerable-software-list>{listed}</vuln:vulnerable-software-list>'
            f"<vuln:cve-id>{cve}</vuln:cve-id><vuln:last-modified-datetime>{when}</vuln:last-modified-datetime>"
            f"{cvss}</entry>")


def _feed(landing, year, *entries):
    os.makedirs(landing, exist_ok=True)
    with open(os.path.join(landing, f"{K.CVE_FILE_PREFIX}{year}.xml"), "w") as f:
        f.write(S.NVD_ROOT[0] + "\n" + "\n".join(entries) + "\n" + S.NVD_ROOT[1] + "\n")


def test_refresh_of_a_feed_published_again(spark):
    base = tempfile.mkdtemp(prefix="cpelink-inc-")
    landing, state, ckpt = (os.path.join(base, x) for x in ("landing", "state", "ckpt"))
    a, b, c, e = ("cpe:/a:v:a:1", "cpe:/a:v:b:1", "cpe:/a:v:c:1", "cpe:/a:v:e:1")
    later = "2018-01-01T00:00:00.000-04:00"

    def check():
        now = _rows(INC.refresh(spark, landing, state, ckpt))
        assert now == _rows(RU.worst_case(C.cve_from_xml(S.scan_cve_xml(spark, landing))))
        return {r[0]: r[1] for r in now}

    _feed(landing, 2016, _entry("CVE-1", 5.0, [a]), _entry("CVE-3", 9.9, [c]), _entry("CVE-5", 4.0, [e]))
    _feed(landing, 2017, _entry("CVE-4", 6.0, [b, c]))
    assert check() == {a: 5.0, b: 6.0, c: 9.9, e: 4.0}
    # same name, other content: a changed score, a new entry, products removed, an entry gone
    _feed(landing, 2016, _entry("CVE-1", 9.9, [a]), _entry("CVE-2", 7.0, [b]), _entry("CVE-3", 9.9, [], later))
    assert check() == {a: 9.9, b: 7.0, c: 6.0}
    # the newest version of an entry lost its CVSS; another feed holds an older one
    _feed(landing, 2017, _entry("CVE-4", 6.0, [b, c]), _entry("CVE-1", None, [a], later))
    assert check() == {b: 7.0, c: 6.0}
    # back to an earlier content
    _feed(landing, 2017, _entry("CVE-4", 6.0, [b, c]))
    assert check() == {a: 9.9, b: 7.0, c: 6.0}


def test_feed_meta(spark):
    d = tempfile.mkdtemp(prefix="cpelink-meta-")
    with open(os.path.join(d, f"{K.CVE_FILE_PREFIX}2016.meta"), "w", newline="") as f:
        f.write("lastModifiedDate:2017-05-01T03:00:00-04:00\r\nsize:12\r\nzipSize:3\r\nsha256:AB12\r\n")
    row = INC.scan_feed_meta(spark, d).first()
    assert row.lastModifiedDate == "2017-05-01T03:00:00-04:00" and row["size"] == 12 and row.sha256 == "ab12"


def test_feeds_changed(spark):
    new = spark.createDataFrame([(2015, "a"), (2016, "b"), (2017, "c")], "year int, sha256 string")
    old = spark.createDataFrame([(2015, "a"), (2016, "x")], "year int, sha256 string")
    assert sorted(r.year for r in INC.feeds_changed(new, old).collect()) == [2016, 2017]


def test_catalogue_stale(spark):
    df = spark.createDataFrame([("2017-05-20", "2017-05-10"), ("2017-05-20", "2017-05-15"), ("2017-05-20", None)],
                               "now string, fetched string")
    df = df.select(F.to_date("now").alias("now"), F.to_date("fetched").alias("fetched"))
    assert INC.catalogue_stale(df).count() == 2
