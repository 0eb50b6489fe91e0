"""Candidate pair generation for the two entity-resolution stages.

Neither stage forms a Cartesian product. Both use equi-joins on keys that
are *implied* by the gates, so no qualifying pair is lost:

* vendor stage -- the gate ``partial_token_set(ven, pub) == 100`` holds
  when the processed token sets share a token, or when one sorted
  distinct-token string is a substring of the other, or, since scores are
  rounded, when both have 200 characters and more and differ by one character
  in 200. Pairs come from (a) an equi-join on shared tokens, (b) a containment
  join blocked on the globally rarest q-gram of the contained string and (c) an
  equi-join of long strings on pieces that the differences cannot all touch.
* software stage -- pairs must share the vendor. Versions are compared as
  distinct strings: short ones meet on the version itself or one of its
  near-full-length substrings, long ones on pieces that the few edits the gate
  allows cannot all touch. The title gate (a fuzzy 70-point threshold on token
  sets) is judged on distinct token-set strings of a vendor through inverted
  indexes (``title_gate``); only passing combinations are expanded to
  product x catalogue pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from ..functions import scoring as S
from ..session import materialize
from . import title_gate as G
from .title_gate import score_partitions

Q = 3


# --- shared helpers ---------------------------------------------------------

def _grams(s: Column, q: Column) -> Column:
    """Distinct substrings of length ``q`` of ``s``."""
    n = F.char_length(s)
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), n - q + 1), lambda p: F.substr(s, p, q)))


def containment_both(a: DataFrame, b: DataFrame, key: str = "t") -> DataFrame:
    """Pairs (a_id, b_id) where one side's string is a substring of the other's.

    One pass serves both directions: the q-grams of both sides are exploded
    once, counted per side, and every string probes the *other* side with its
    rarest gram there. Any string containing ``t`` contains that gram, so the
    blocking is exact; the final ``contains`` check removes false hits.
    """
    strs = (a.select(F.lit(0).alias("side"), "id", key)
            .unionByName(b.select(F.lit(1).alias("side"), "id", key))
            .where(F.char_length(key) > 0))
    n = F.char_length(key)
    grams = strs.select(
        "side", "id", key, n.alias("n"),
        F.explode(F.flatten(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(Q), n)),
            lambda q: F.transform(_grams(F.col(key), q), lambda g: F.struct(q.alias("q"), g.alias("g")))
        ))).alias("qg"),
    ).select("side", "id", key, "n", F.col("qg.q").alias("q"), F.col("qg.g").alias("g"))
    freq = grams.groupBy("side", "q", "g").agg(F.count("*").alias("df"))
    # a string's probe grams have q = min(3, length); rarity is counted on the other side
    probes = grams.where(F.col("q") == F.least(F.lit(Q), F.col("n"))).withColumn("other", 1 - F.col("side"))
    rarest = (
        probes.join(freq.withColumnRenamed("side", "other"), ["other", "q", "g"], "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .groupBy("side", "other", "id", key)
        .agg(F.min_by(F.struct("q", "g"), F.struct("df", "g")).alias("pick"))
        .select("side", "other", "id", key, F.col("pick.q").alias("q"), F.col("pick.g").alias("g"))
    )
    hits = rarest.alias("s").join(
        grams.alias("l"),
        (F.col("s.other") == F.col("l.side")) & (F.col("s.q") == F.col("l.q")) & (F.col("s.g") == F.col("l.g")))
    hits = hits.where(F.col(f"l.{key}").contains(F.col(f"s.{key}")))
    s_is_a = F.col("s.side") == 0
    return hits.select(F.when(s_is_a, F.col("s.id")).otherwise(F.col("l.id")).alias("a_id"),
                       F.when(s_is_a, F.col("l.id")).otherwise(F.col("s.id")).alias("b_id"))


# --- vendor stage -------------------------------------------------------------

def prepare_publishers(software: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Distinct normalised publishers with tokens and cleaned name."""
    pubs = software.select(N.norm_name("Publisher0").alias("publisher0")).dropna().distinct()
    toks = N.tokenize("publisher0", K.PUBLISHER_SPLIT_CHARS)
    return pubs.select("publisher0", toks.alias("pub0_toks")).select(
        "publisher0", "pub0_toks", N.clean_tokens("pub0_toks", stop).alias("pub0_cln"))


def prepare_vendors(cpe: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Distinct normalised CPE vendors with tokens and cleaned name."""
    vens = cpe.select(N.norm_name("vendor_X").alias("vendor_X")).dropna().distinct()
    toks = N.tokenize("vendor_X", K.VENDOR_SPLIT_CHARS)
    return vens.select("vendor_X", toks.alias("vend_toks")).select(
        "vendor_X", "vend_toks", N.clean_tokens("vend_toks", stop).alias("ven_cln"))


#: From this length on a score of 99.5 and more, one edit in 200 characters, rounds to 100.
LONG = 200
LONG_GRAM = 32


def near_contained_long(vens: DataFrame, pubs: DataFrame) -> DataFrame:
    """(publisher0, vendor_X) pairs of token strings of ``LONG`` characters and more that score 100 without containment.

    The shorter string, of n characters, then matches a window of the other one
    but for d = n // 200 characters on each side. Of 2 d + 1 equal pieces of it
    at least one is untouched, so its first ``LONG_GRAM`` characters stand in the
    longer string: pairs come from that equi-join and the score decides.
    """
    def long_side(df: DataFrame, id_col: str, cln: str) -> DataFrame:
        t = N.sorted_token_string(cln)
        return df.select(F.col(id_col).alias("id"), F.col(cln).alias("cln"), t.alias("t")).where(F.char_length(t) >= LONG)

    n = F.char_length("t")
    pieces = 2 * F.floor(n / LONG).cast("int") + 1
    probes = F.array_distinct(F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.substr(
        F.col("t"), F.floor(k * n / pieces).cast("int") + 1, F.lit(LONG_GRAM))))
    v, p = long_side(vens, "vendor_X", "ven_cln"), long_side(pubs, "publisher0", "pub0_cln")

    def met(short: DataFrame, long: DataFrame) -> DataFrame:
        s = short.select(F.col("id").alias("s_id"), F.col("cln").alias("s_cln"), n.alias("s_n"), F.explode(probes).alias("g"))
        g = long.select(F.col("id").alias("l_id"), F.col("cln").alias("l_cln"), n.alias("l_n"),
                        F.explode(_grams(F.col("t"), F.lit(LONG_GRAM))).alias("g"))
        return s.join(g, "g").where(F.col("s_n") <= F.col("l_n")).drop("g").distinct()

    pairs = (met(v, p).select(F.col("l_id").alias("publisher0"), F.col("s_id").alias("vendor_X"),
                              F.col("l_cln").alias("pc"), F.col("s_cln").alias("vc"))
             .unionByName(met(p, v).select(F.col("s_id").alias("publisher0"), F.col("l_id").alias("vendor_X"),
                                           F.col("s_cln").alias("pc"), F.col("l_cln").alias("vc"))).distinct())
    return pairs.where(S.pair_scores(F.col("vc"), F.col("pc"), ["ptl_token_set"])["ptl_token_set"] == 100).select("publisher0", "vendor_X")


def _token_rows(df: DataFrame, id_col: str, cln: str) -> DataFrame:
    toks = F.array_distinct(F.filter(F.split(N.proc(cln), r"\s+"), lambda t: t != ""))
    return df.select(F.col(id_col).alias("id"), F.explode(toks).alias("tok"))


def vendor_gate_pairs(pubs: DataFrame, vens: DataFrame) -> DataFrame:
    """(publisher0, vendor_X) pairs whose partial token-set score is 100."""
    shared = (
        _token_rows(vens, "vendor_X", "ven_cln").alias("v")
        .join(_token_rows(pubs, "publisher0", "pub0_cln").alias("p"), "tok")
        .select(F.col("p.id").alias("publisher0"), F.col("v.id").alias("vendor_X"))
    )
    v_t = vens.select(F.col("vendor_X").alias("id"), N.sorted_token_string("ven_cln").alias("t"))
    p_t = pubs.select(F.col("publisher0").alias("id"), N.sorted_token_string("pub0_cln").alias("t"))
    contained = containment_both(v_t, p_t).select(
        F.col("b_id").alias("publisher0"), F.col("a_id").alias("vendor_X"))
    return shared.unionByName(contained).unionByName(near_contained_long(vens, pubs)).distinct()


def vendor_candidates(software: DataFrame, cpe: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Scored publisher x vendor candidates (length and token gates applied)."""
    # distinct names are small but feed five joins: compute each once
    pubs = materialize(prepare_publishers(software, stop))
    vens = materialize(prepare_vendors(cpe, stop).where(F.char_length("ven_cln") >= K.VENDOR_MIN_CLEAN_LEN))
    pairs = vendor_gate_pairs(pubs, vens)
    cand = (
        pairs.join(pubs, "publisher0").join(vens, "vendor_X")
        .where(F.char_length("ven_cln") <= F.char_length("pub0_cln"))
    )
    cand = cand.repartition(score_partitions(cand), "publisher0", "vendor_X")
    scored = cand.select(
        "publisher0", "pub0_cln", "vendor_X", "ven_cln",
        S.pair_scores(F.col("ven_cln"), F.col("pub0_cln"),
                      ["ratio", "partial", "token_set", "ptl_token_sort", "weighted"]).alias("s"),
    )
    return scored.select(
        "publisher0", "pub0_cln", "vendor_X", "ven_cln",
        F.col("s.ratio").alias("fz_ratio"),
        F.col("s.partial").alias("fz_ptl_ratio"),
        F.col("s.token_set").alias("fz_tok_set_ratio"),
        F.col("s.ptl_token_sort").alias("fz_ptl_tok_sort_ratio"),
        F.col("s.weighted").alias("fz_uwratio"),
    )


def name_lengths_vendor(df: DataFrame) -> DataFrame:
    return df.withColumn("ven_len", F.char_length("vendor_X")).withColumn(
        "pu0_len", F.char_length("publisher0"))


# --- software stage -----------------------------------------------------------

def inv_with_vendor(software: DataFrame, vendor_match: DataFrame,
                    publisher_key: str = "normalized") -> DataFrame:
    """Inventory rows that carry a matched vendor (inner: unmatched publishers drop out).

    ``publisher_key``: "normalized" joins the normalised publisher, "faithful" the
    merely lower-cased one, with which only one-word publishers meet their match.
    """
    if publisher_key not in ("normalized", "faithful"):
        raise ValueError(f"publisher_key must be 'normalized' or 'faithful', not {publisher_key!r}")
    key = N.norm_name("Publisher0") if publisher_key == "normalized" else F.lower("Publisher0")
    inv = software.select(key.alias("publisher0"), "DisplayName0", "Version0")
    return inv.join(vendor_match.select("publisher0", "vendor_X"), "publisher0", "inner")


def products_of(software: DataFrame, vendor_match: DataFrame, publisher_key: str = "normalized") -> DataFrame:
    """Distinct installed products of matched vendors.

    The inventory is reduced to its distinct (publisher, name, version) before
    the join, so the large side is shuffled once and already combined map-side.
    """
    installed = software.select("Publisher0", "DisplayName0", "Version0").distinct()
    return distinct_products(inv_with_vendor(installed, vendor_match, publisher_key))


def distinct_products(inv_vendor: DataFrame) -> DataFrame:
    """Distinct (vendor_X, DisplayName0, Version0); missing version -> '-'."""
    return (
        inv_vendor.select("vendor_X", "DisplayName0", N.fill_version("Version0").alias("Version0"))
        .dropna(subset=["vendor_X", "DisplayName0"]).distinct()
    )


def pair_skip_microsoft(products: DataFrame) -> DataFrame:
    return products.where(F.col("vendor_X") != K.SKIP_VENDOR)


def pair_skip_rules(products: DataFrame) -> DataFrame:
    """Never match Microsoft; drop unversioned Cisco WebEx entries."""
    webex = ((F.col("vendor_X") == K.WEBEX_VENDOR) & (F.col("Version0") == K.NO_VERSION)
             & F.lower("DisplayName0").contains(K.WEBEX_TOKEN))
    return pair_skip_microsoft(products).where(~webex)


def _close_lengths(n: Column) -> Column:
    """Shorter lengths L < n for which intr(200 L / (L + n)) >= 90."""
    return F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                    lambda L: (L < n) & (F.floor(F.lit(100.0) * (F.lit(2.0) * L / (L + n)) + 0.5) >= K.VERSION_RATIO_GATE))


#: Versions from this length on meet by grams; shorter ones by themselves and their substrings.
LONG_VERSION = 32


def _version_keys(v: Column) -> Column:
    """Of a version below ``LONG_VERSION`` itself (role 0); of any its substrings of close length below it (role 1)."""
    n = F.char_length(v)
    subs = F.flatten(F.transform(
        F.filter(_close_lengths(n), lambda L: L < LONG_VERSION),
        lambda L: F.transform(F.sequence(F.lit(1), n - L + 1), lambda p: F.substr(v, p, L))))
    whole = F.when(n < LONG_VERSION, F.array(F.struct(v.alias("k"), F.lit(0).alias("role")))) \
        .otherwise(F.array().cast("array<struct<k:string,role:int>>"))
    return F.concat(whole, F.transform(F.array_distinct(subs), lambda s: F.struct(s.alias("k"), F.lit(1).alias("role"))))


def _rel_scores(release: Column, version: Column) -> list[Column]:
    """Release scores of a pair that the gate lets through without an edit: equal, contained, or one side has no version."""
    n, m = (F.char_length(x) for x in (release, version))
    none = F.lit(K.NO_VERSION)
    dash = F.when(release == none, version.contains(K.NO_VERSION)).otherwise(release.contains(K.NO_VERSION)).cast("int")
    common = F.when((release == none) | (version == none), dash).otherwise(F.least(n, m))
    ratio = F.floor(F.lit(100.0) * (F.lit(2.0) * common / (n + m)) + 0.5).cast("int")
    partial = F.floor(F.lit(100.0) * (F.lit(2.0) * common / (2 * F.least(n, m))) + 0.5).cast("int")
    empty = F.least(n, m) == 0
    return [F.when(empty, 0).when(release == version, 100).otherwise(x).alias(k)
            for k, x in (("rel_ratio", ratio), ("rel_partial", partial))]


def _met_by_grams(short: DataFrame, long: DataFrame) -> DataFrame:
    """(vendor_X, s, l): versions of ``LONG_VERSION`` characters and more, of close length, that could pass the gate.

    The shorter one, of n characters, stands in the longer one but for n // 200
    characters on each side (the partial score is rounded). Of 2 (n // 200) + 1
    equal pieces of it one is untouched, so that piece's first ``LONG_GRAM``
    characters, or the piece if shorter, stand in the longer version.
    """
    n = F.char_length("v")
    pieces = 2 * F.floor(n / LONG).cast("int") + 1
    probes = F.array_distinct(F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.substr(
        F.col("v"), F.floor(k * n / pieces).cast("int") + 1, F.lit(LONG_GRAM))))
    s = short.select("vendor_X", F.col("v").alias("s"), F.explode(probes).alias("g"))
    g = long.select("vendor_X", F.col("v").alias("l"), F.explode(_grams(F.col("v"), F.lit(LONG_GRAM))).alias("g"))
    a, b = F.char_length("s"), F.char_length("l")
    close = F.floor(F.lit(100.0) * (F.lit(2.0) * a / (a + b)) + 0.5) >= K.VERSION_RATIO_GATE
    return s.join(g, ["vendor_X", "g"]).where((a <= b) & close).select("vendor_X", "s", "l").distinct()


def version_pairs(products: DataFrame, c: DataFrame) -> DataFrame:
    """(vendor_X, Version0, rel_tmp, rel_ratio, rel_partial): the distinct versions of a vendor that pass the gate together.

    Both sides have a version. Versions below ``LONG_VERSION`` characters pass only
    if one contains the other; from 200 characters on an edit may remain, and such
    pairs are scored.
    """
    nv = F.lit(K.NO_VERSION)
    pv = products.where(F.col("Version0") != nv).select("vendor_X", F.col("Version0").alias("v")).distinct()
    cv = c.where(F.col("rel_tmp") != nv).select("vendor_X", F.col("rel_tmp").alias("v")).distinct()
    keyed_p = pv.select("vendor_X", F.col("v").alias("Version0"), F.explode(_version_keys(F.col("v"))).alias("p"))
    keyed_c = cv.select("vendor_X", F.col("v").alias("rel_tmp"), F.explode(_version_keys(F.col("v"))).alias("c"))
    short = keyed_p.withColumn("k", F.col("p.k")).join(keyed_c.withColumn("k", F.col("c.k")), ["vendor_X", "k"]) \
        .where((F.col("p.role") + F.col("c.role")) < 2).select("vendor_X", "Version0", "rel_tmp")
    contained = S.version_gate("rel_tmp", "Version0")
    native = short.where(contained).select("vendor_X", "Version0", "rel_tmp", *_rel_scores(F.col("rel_tmp"), F.col("Version0")))

    lp, lc = (x.where(F.char_length("v") >= LONG_VERSION) for x in (pv, cv))
    met = (_met_by_grams(lp, lc).select("vendor_X", F.col("s").alias("Version0"), F.col("l").alias("rel_tmp"))
           .union(_met_by_grams(lc, lp).select("vendor_X", F.col("l").alias("Version0"), F.col("s").alias("rel_tmp"))).distinct())
    scored = met.select("*", S.pair_ratio("rel_tmp", "Version0").alias("r")) \
        .where((F.col("r.ratio") >= K.VERSION_RATIO_GATE) & (F.col("r.partial") == 100)) \
        .select("vendor_X", "Version0", "rel_tmp", F.col("r.ratio").alias("rel_ratio"), F.col("r.partial").alias("rel_partial"))
    return native.unionByName(scored)


def _with_release(cpe: DataFrame) -> DataFrame:
    return cpe.withColumn("rel_tmp", N.java_release("vendor_X", "software_X", "cpe23", "release_X"))


def versioned_pairs(products: DataFrame, cpe: DataFrame) -> DataFrame:
    """(product, CPE row) pairs of one vendor, both with a version, that pass the version gate."""
    products, c = materialize(products, "versioned_products"), materialize(_with_release(cpe), "versioned_catalogue")
    return products.join(version_pairs(products, c), ["vendor_X", "Version0"]).join(c, ["vendor_X", "rel_tmp"]) \
        .select("vendor_X", "DisplayName0", "Version0", "software_X", "release_X", "rel_tmp", "title_X", "cpe23", "cpe_name")


def ungated_counts(products: DataFrame, cpe: DataFrame) -> DataFrame:
    """(vendor_X, n): how many pairs of a vendor the version gate lets through because one side has no version.

    Counted, not formed: such pairs are all products times all catalogue rows of the vendor.
    """
    nv = F.lit(K.NO_VERSION)
    p = products.groupBy("vendor_X").agg(F.count_if(F.col("Version0") == nv).alias("pu"), F.count_if(F.col("Version0") != nv).alias("pv"))
    c = _with_release(cpe).groupBy("vendor_X").agg(F.count("*").alias("c"), F.count_if(F.col("rel_tmp") == nv).alias("cu"))
    return p.join(c, "vendor_X").select("vendor_X", (F.col("pu") * F.col("c") + F.col("pv") * F.col("cu")).alias("n"))


def software_candidates(products: DataFrame, cpe: DataFrame) -> DataFrame:
    """Scored product x CPE candidates passing the version and title gates.

    The title gate and the title scores depend only on (vendor, catalogue
    title, display name), the release scores only on (release, version). So:

    1. versioned pairs come from the distinct versions of a vendor that pass together;
    2. the title gate depends only on the two sets of tokens: the distinct token
       strings that it is judged on are those of versioned pairs and, where a side
       has no version, those that meet in the inverted indexes of ``title_gate``;
    3. the scores are computed once for each distinct (title, display name) pair that passes;
    4. only passing combinations are expanded back to product x catalogue
       pairs, so the product x catalogue explosion is output-sized; release
       scores come with the version pairs or from a built-in expression.
    """
    nv = F.lit(K.NO_VERSION)
    stripped = N.strip_vendor("DisplayName0", "vendor_X")
    prod = materialize(pair_skip_rules(products).select(
        "vendor_X", "DisplayName0", "Version0", stripped.alias("tb"), N.sorted_token_string(stripped).alias("cb")), "products")
    stripped = N.strip_vendor("title_X", "vendor_X")
    cat = materialize(_with_release(cpe).where(F.col("title_X").isNotNull()).select(
        "vendor_X", "software_X", "release_X", "rel_tmp", "title_X", "cpe_name", stripped.alias("ta"),
        N.sorted_token_string(stripped).alias("ca")), "catalogue")
    versions = materialize(version_pairs(prod, cat), "version_pairs")

    displays = prod.groupBy("vendor_X", "cb").agg(F.bool_or(F.col("Version0") == nv).alias("open"))
    titles = cat.groupBy("vendor_X", "ca").agg(F.bool_or(F.col("rel_tmp") == nv).alias("open"))
    parts = score_partitions(prod)
    given = (prod.select("vendor_X", "Version0", "cb").distinct().join(versions, ["vendor_X", "Version0"])
             .repartition(parts, "vendor_X", "cb", "rel_tmp")
             .join(cat.select("vendor_X", "rel_tmp", "ca").distinct(), ["vendor_X", "rel_tmp"])
             .select("vendor_X", "ca", "cb").distinct())
    through = materialize(G.passing_titles(titles, displays, given), "passing_tokens")

    strings = (through.join(cat.select("vendor_X", "ca", "ta").distinct(), ["vendor_X", "ca"])
               .join(prod.select("vendor_X", "cb", "tb").distinct(), ["vendor_X", "cb"]).select("vendor_X", "ta", "tb"))
    distinct = strings.select("ta", "tb").distinct()
    distinct = distinct.repartition(parts, "ta", "tb")
    scored = distinct.select("ta", "tb", S.pair_scores(
        F.col("ta"), F.col("tb"), ["ratio", "partial", "ptl_token_set", "token_sort", "weighted"]).alias("s"))
    passing = materialize(strings.join(scored, ["ta", "tb"]), "passing_titles")

    met = prod.drop("cb").join(passing, ["vendor_X", "tb"])
    rows = cat.drop("ca")
    versioned = met.where(F.col("Version0") != nv)
    e1 = versioned.join(versions, ["vendor_X", "Version0"]).join(rows, ["vendor_X", "rel_tmp", "ta"])
    scores = _rel_scores(F.col("rel_tmp"), F.col("Version0"))
    e2a = met.where(F.col("Version0") == nv).join(rows, ["vendor_X", "ta"]).select("*", *scores)
    e2b = versioned.join(rows.where(F.col("rel_tmp") == nv), ["vendor_X", "ta"]).select("*", *scores)
    return e1.unionByName(e2a).unionByName(e2b).select(
        "vendor_X", "software_X", "title_X", "DisplayName0", "release_X", "Version0",
        F.col("s.ratio").alias("fz_ratio"),
        F.col("s.partial").alias("fz_ptl_ratio"),
        F.col("s.ptl_token_set").alias("fz_tok_set_ratio"),
        F.col("s.token_sort").alias("fz_ptl_tok_sort_ratio"),
        F.col("s.weighted").alias("fz_uwratio"),
        F.col("rel_ratio").alias("fz_rel_ratio"),
        F.col("rel_partial").alias("fz_rel_ptl_ratio"),
        F.col("cpe_name").alias("t_cve_name"),
        F.char_length("title_X").alias("titlX_len"),
        F.char_length("DisplayName0").alias("DsplyNm0_len"),
    )
