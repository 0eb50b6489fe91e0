import re

from pyspark.sql import functions as F

from cpelink import constants as K
from cpelink.functions import normalize as N


def test_criticality_truth_table(spark):
    rows = [
        (None, None, None, "Low"),
        (7.0, "LOW", "NETWORK", "Medium"),
        (7.1, "LOW", "NETWORK", "High"),
        (8.0, "MEDIUM", "ADJACENT_NETWORK", "High"),
        (8.0, "HIGH", "NETWORK", "Medium"),
        (3.9, "LOW", "NETWORK", "Low"),
        (4.0, "LOW", "NETWORK", "Medium"),
        (4.0, "HIGH", "LOCAL", "Low"),
        (9.0, None, "NETWORK", "Medium"),
        (None, "LOW", "NETWORK", "Medium"),
        (None, "HIGH", None, "Low"),
    ]
    df = spark.createDataFrame(rows, "s double, c string, v string, e string")
    got = df.select("e", N.criticality("s", "c", "v").alias("g")).collect()
    assert all(r.e == r.g for r in got), got


def test_ordinal_roundtrip(spark):
    df = spark.createDataFrame([("LOW",), ("HIGH",), (None,), ("BOGUS",)], "c string")
    out = df.select("c", N.ordinal("c", K.COMPLEXITY_LEVELS).alias("o")).select(
        "c", "o", N.level("o", K.COMPLEXITY_LEVELS).alias("l")).collect()
    d = {r.c: (r.o, r.l) for r in out}
    assert d["LOW"] == (3, "LOW") and d["HIGH"] == (1, "HIGH")
    assert d[None] == (None, None) and d["BOGUS"] == (None, None)


def java_fix_py(name):
    """Plain-Python statement of the JDK/JRE release rules (test oracle)."""
    if "update" in name:
        m = re.search(r"cpe:2.3:a:(oracle|sun):(?P<sft>(jdk|jre)):1.(?P<rel>[\d.]*):update[_]*(?P<upd>[\d]*)", name, re.I)
        if not m:
            return "-"
        sft, rel, tmp = m.group("sft"), m.group("rel"), m.group("rel") + "." + m.group("upd") + "0"
    else:
        m = re.search(r"cpe:2.3:a:(oracle|sun):(?P<sft>(jdk|jre)):1.(?P<rel>[\d._]*):", name, re.I)
        if not m:
            return "-"
        sft, rel = m.group("sft"), m.group("rel")
        tmp = rel
    if "_" in rel:
        return "1." + rel
    if sft == "jre":
        return tmp
    return tmp if rel.startswith("8.") else "1." + tmp


def test_java_release(spark):
    names = [
        "cpe:2.3:a:oracle:jdk:1.7.0:update_60:*:*:*:*:*:*",
        "cpe:2.3:a:oracle:jre:1.7.0:update_60:*:*:*:*:*:*",
        "cpe:2.3:a:oracle:jdk:1.8.0:update_60:*:*:*:*:*:*",
        "cpe:2.3:a:sun:jre:1.4.2_05:*:*:*:*:*:*:*",
        "cpe:2.3:a:sun:jdk:1.6.0:*:*:*:*:*:*:*",
        "cpe:2.3:a:oracle:jre:1.8.0:*:*:*:*:*:*:*",
        "cpe:2.3:a:oracle:jdk:1.8.0:update:*:*:*:*:*:*",
        "cpe:2.3:a:oracle:jdk:-:*:*:*:*:*:*:*",
    ]
    df = spark.createDataFrame([(n,) for n in names], "cpe23 string")
    df = df.select("cpe23", N.cpe_part("cpe23", 1).alias("v"), N.cpe_part("cpe23", 2).alias("s"),
                   N.cpe_part("cpe23", 3).alias("r"))
    got = df.select("cpe23", N.java_release("v", "s", "cpe23", "r").alias("j")).collect()
    for r in got:
        assert r.j == java_fix_py(r.cpe23), r
    assert {r.cpe23: r.j for r in got}[names[0]] == "1.7.0.600"
    assert {r.cpe23: r.j for r in got}[names[1]] == "7.0.600"
    assert {r.cpe23: r.j for r in got}[names[2]] == "8.0.600"


def test_java_release_leaves_other_vendors(spark):
    df = spark.createDataFrame([("acme", "jdk", "cpe:2.3:a:acme:jdk:1.2:*", "1.2")], "v string, s string, c string, r string")
    assert df.select(N.java_release("v", "s", "c", "r").alias("j")).first().j == "1.2"


def test_clean_tokens_layout(spark):
    df = spark.createDataFrame([("adobe_systems_inc",), ("the_co",), ("x_y.z",)], "p string")
    out = df.select("p", N.clean_tokens(N.tokenize("p", K.PUBLISHER_SPLIT_CHARS)).alias("c")).collect()
    d = {r.p: r.c for r in out}
    assert d["adobe_systems_inc"] == "  adobe"
    assert d["the_co"] == " "
    assert d["x_y.z"] == " "


def test_host_function(spark):
    dns = ["CN=a,OU=HQ Desktop,DC=x", "  cn=b,ou=field laptop,dc=y ", "CN=c,OU=Other,DC=z", None,
           "CN=d,OU=DC Server desktop,DC=w"]
    df = spark.createDataFrame([(d,) for d in dns], "dn string")
    got = [r.f for r in df.select(N.host_function("dn").alias("f")).collect()]
    assert got == ["desktop", "laptop", None, None, "desktop"]


def test_title_en(spark):
    t = "array<struct<_VALUE:string,`_xml:lang`:string>>"
    rows = [
        ([("Un", "fr-FR"), ("One", "en-US")],),
        ([("Eins", "de-DE")],),
        ([("Un", "fr-FR"), ("Uno", "it-IT")],),
    ]
    df = spark.createDataFrame(rows, f"title {t}")
    got = [r.t for r in df.select(N.title_en("title").alias("t")).collect()]
    assert got == ["One", "Eins", None]


def test_cpe_part_null_for_non_apps(spark):
    df = spark.createDataFrame([("cpe:2.3:o:linux:kernel:4.1:*",), ("cpe:2.3:a:v:s:1.0:*",)], "c string")
    got = df.select(N.cpe_part("c", 1).alias("v"), N.cpe_part("c", 3).alias("r")).collect()
    assert got[0].v is None and got[1].v == "v" and got[1].r == "1.0"
    assert F is not None
