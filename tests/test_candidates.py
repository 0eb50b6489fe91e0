import random

import pair_scores as S
from pyspark.sql import functions as F

from cpelink import constants as K
from cpelink.operators import candidates as CA
from cpelink.plans import inputs as I


def test_vendor_gate_brute_force(spark):
    pubs = ["adobe_systems_inc", "brand1_inc", "brand11_inc", "brand2_inc", "mozilla_foundation",
            "the_document_foundation", "o'reilly_media", "acme_corp", "foundation_x", "x_y"]
    vens = ["adobe", "brand1", "brand11", "brand2", "mozilla", "document_foundation", "oreilly", "acme",
            "x", "foundation"]
    sw = spark.createDataFrame([(p.replace("_", " "),) for p in pubs], "Publisher0 string")
    cpe = spark.createDataFrame([(v,) for v in vens], "vendor_X string")
    p = CA.prepare_publishers(sw)
    v = CA.prepare_vendors(cpe)
    got = {(r.publisher0, r.vendor_X) for r in CA.vendor_gate_pairs(p, v).collect()}
    pc = {r.publisher0: r.pub0_cln for r in p.collect()}
    vc = {r.vendor_X: r.ven_cln for r in v.collect()}
    exp = {(a, b) for a in pc for b in vc if S.partial_token_set(vc[b], pc[a]) == 100}
    assert got == exp


def test_vendor_gate_unicode_and_long_names(spark):
    random.seed(5)
    long = "".join(random.choice("abcdefghij") for _ in range(450))
    cut = lambda s, k: s[:k] + s[k + 1:]
    swap = lambda s, k: s[:k] + "z" + s[k + 1:]
    vens = ["cafe_moon", "stra\u00dfe", "\u0645\u062f_\u064e\u0646\u0629", "na\u0308ive", long[:210], long[:405], "x\u0301y", "\u0e01\u0e34\u0e19"]
    pubs = ["x cafe\u0301 zed", "STRASSE gmbh", "Stra\u00dfe AG", "\u0645\u062f\u064e\u0646\u0629 co", "na ive", "x y", swap(long[:211], 100),
            swap(swap(long[:211], 100), 30), "q" + swap(long[:405], 17), swap(swap(long[:405], 17), 390), cut(long[:405], 200),
            swap(long[:199], 50), "\u0e01\u0e19 \u0e01\u0e34"]
    p = CA.prepare_publishers(spark.createDataFrame([(x,) for x in pubs], "Publisher0 string"))
    v = CA.prepare_vendors(spark.createDataFrame([(x,) for x in vens], "vendor_X string"))
    got = {(r.publisher0, r.vendor_X) for r in CA.vendor_gate_pairs(p, v).collect()}
    pc, vc = {r.publisher0: r.pub0_cln for r in p.collect()}, {r.vendor_X: r.ven_cln for r in v.collect()}
    exp = {(a, b) for a in pc for b in vc if S.partial_token_set(vc[b], pc[a]) == 100}
    assert got == exp
    assert any(len(a) > 200 and len(b) > 200 for a, b in exp)


def _brute_software(products, cpe):
    """All same-vendor pairs, gated like the original nested loop."""
    out = set()
    by_vendor = {}
    for c in cpe:
        by_vendor.setdefault(c.vendor_X, []).append(c)
    for p in products:
        if p.vendor_X == K.SKIP_VENDOR:
            continue
        if p.vendor_X == K.WEBEX_VENDOR and p.Version0 == "-" and "webex" in p.DisplayName0.lower():
            continue
        for c in by_vendor.get(p.vendor_X, []):
            rel = c.rel_tmp  # JDK / JRE releases rebuilt, as the gate sees them
            if rel != "-" and p.Version0 != "-":
                if S.ratio(rel, p.Version0) < 90 or S.partial_ratio(rel, p.Version0) < 100:
                    continue
            if c.title_X is None:
                continue
            t = c.title_X.lower().replace(c.vendor_X, " ")
            d = p.DisplayName0.lower().replace(c.vendor_X, " ")
            if S.partial_token_set(t, d) < K.TITLE_GATE:
                continue
            out.add((p.vendor_X, p.DisplayName0, p.Version0, c.cpe_name, S.weighted(t, d)))
    return out


def test_software_candidates_brute_force(spark, sf_dir):
    products = I.products(spark, sf_dir)
    cpe = I.catalogue(spark, sf_dir)
    got = {(r.vendor_X, r.DisplayName0, r.Version0, r.t_cve_name, r.fz_uwratio)
           for r in CA.software_candidates(products, cpe).collect()}
    exp = _brute_software(products.collect(), CA._with_release(cpe).collect())
    assert got == exp
    assert len(got) > 100


def test_software_pairs_has_no_nested_loop(spark, sf_dir):
    pairs = CA.versioned_pairs(I.products(spark, sf_dir), I.catalogue(spark, sf_dir))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_vendor_candidates_has_no_nested_loop(spark, sf_dir):
    c = CA.vendor_candidates(I.inventory(spark, sf_dir), I.catalogue(spark, sf_dir))
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert c.where(F.col("fz_tok_set_ratio").isNull()).count() == 0


def test_containment_both_brute_force(spark):
    random.seed(12)
    a = ["".join(random.choice("abc ") for _ in range(random.randint(1, 7))).strip() or "b" for _ in range(50)]
    b = ["".join(random.choice("abc ") for _ in range(random.randint(1, 9))).strip() or "c" for _ in range(50)]
    da = spark.createDataFrame(list(enumerate(a)), "id int, t string")
    db = spark.createDataFrame(list(enumerate(b)), "id int, t string")
    got = {(r.a_id, r.b_id) for r in CA.containment_both(da, db).collect()}
    exp = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x in y or y in x}
    assert got == exp


def _version_gate(r, v):
    return S.ratio(r, v) >= 90 and S.partial_ratio(r, v) == 100


def test_version_pairs_of_any_length(spark):
    """Versions of one to 600 characters with none, one or a few edits: no pair that the gate lets through is lost."""
    rnd = random.Random(8)
    draw = lambda n: "".join(rnd.choice("0123456789.") for _ in range(n))
    releases, versions = [], []
    for n in [1, 2, 3, 5, 9, 20, 28, 31, 32, 33, 40, 60, 150, 199, 200, 201, 260, 399, 400, 401, 600] * 2:
        base = draw(n)
        releases.append(base)
        k, j = rnd.randrange(n), rnd.randrange(n)
        versions += [base, base[:k] + "x" + base[k + 1:], base[:k] + base[k + 1:], base[:k] + "y" + base[k:], base + draw(n // 9),
                     draw(n // 12) + base, base[:-(n // 10) or None], (base[:k] + "z" + base[k + 1:])[:j] + "q" + base[j + 1:],
                     base[:k] + "x" + base[k + 1:] + draw(n // 15)]
    versions = [v for v in dict.fromkeys(versions) if v]
    products = spark.createDataFrame([("v", "d", x) for x in versions] + [("v", "d", "-")], "vendor_X string, DisplayName0 string, Version0 string")
    cat = spark.createDataFrame([("v", x) for x in releases] + [("v", "-"), ("w", versions[0])], "vendor_X string, rel_tmp string")
    got = [tuple(r) for r in CA.version_pairs(products, cat).collect()]
    exp = {("v", v, r, S.ratio(r, v), S.partial_ratio(r, v)) for v in versions for r in releases if _version_gate(r, v)}
    assert len(got) == len(set(got)) and set(got) == exp
    long = [e for e in exp if len(e[1]) >= 200 and e[1] not in e[2] and e[2] not in e[1]]
    assert len(long) > 10 and any(len(e[1]) > 400 for e in long)


def test_title_gate_brute_force(spark, monkeypatch):
    """Inverted indexes against every pair, with hot keys split; open flags respected."""
    monkeypatch.setattr(CA.G, "SPLIT_PAIRS", 40)
    rnd = random.Random(6)
    words = ["ring", "rings", "plate", "plates", "hot", "hott", "cold", "gold", "x", "straße", "中文", "bolt", "colt"]
    titles = sorted({" ".join(sorted(set(rnd.choices(words, k=rnd.randint(0, 3))))) for _ in range(70)})
    shows = sorted({" ".join(sorted(set(rnd.choices(words, k=rnd.randint(0, 4))))) for _ in range(70)})
    t = [(v, x, rnd.random() < 0.4) for v in ("a", "b") for x in titles if rnd.random() < 0.8]
    d = [(v, x, rnd.random() < 0.4) for v in ("a", "b") for x in shows if rnd.random() < 0.8]
    given = {(v, x, y) for v, x, _ in t for w, y, _ in d if v == w and rnd.random() < 0.05}
    got = [tuple(r) for r in CA.G.passing_titles(
        spark.createDataFrame(t, "vendor_X string, ca string, open boolean"),
        spark.createDataFrame(d, "vendor_X string, cb string, open boolean"),
        spark.createDataFrame(sorted(given), "vendor_X string, ca string, cb string")).collect()]
    exp = {(v, x, y) for v, x, xo in t for w, y, yo in d
           if v == w and (xo or yo or (v, x, y) in given) and S.partial_token_set(x, y) >= K.TITLE_GATE}
    assert len(got) == len(set(got))
    assert exp <= set(got)
    # pairs judged in one vendor are known to pass in another
    assert all(S.partial_token_set(x, y) >= K.TITLE_GATE for _, x, y in set(got) - exp)
    assert any(not set(x.split()) & set(y.split()) for _, x, y in exp)


def test_elements_are_a_bag(spark):
    for text in ("", "aab", "  ring ring", "中文中文", "x" * 30):
        e = spark.createDataFrame([(text,)], "c string").select(CA.G.elements("c").alias("e")).first().e
        assert len(set(e)) == len(e) == len(text) and sorted(x[10:] for x in e) == sorted(text)
    ns = spark.range(1, 300).select("id", CA.G.least_common(F.col("id").cast("int")).alias("m")).collect()
    least = {n: min(m for m in range(n + 1) if S.intr(100 * (2.0 * m / (2 * n))) >= K.TITLE_GATE) for n in range(1, 300)}
    assert all(least[r.id] - 1 <= r.m <= least[r.id] for r in ns) and sum(r.m < least[r.id] for r in ns) <= 2
