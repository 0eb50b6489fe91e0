"""Column -> Column functions (all native Spark expressions, no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm_name(c) -> Column:
    """Blank -> underscore, lower-case."""
    return F.lower(F.translate(_col(c), " ", "_"))


def tokenize(c, chars: str) -> Column:
    """Replace each of ``chars`` by a blank and split on whitespace runs."""
    spaced = F.translate(_col(c), chars, " " * len(chars))
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda t: t != "")


def clean_tokens(tokens, stop: list[str] | None = None) -> Column:
    """Drop stop words and one-character tokens and re-join.

    The result keeps the original layout: one blank, then ``' ' + token`` for
    each kept token (so a non-empty result starts with two blanks; an empty
    one is a single blank).
    """
    stop = K.STOP_WORDS if stop is None else stop
    kept = F.filter(_col(tokens), lambda t: (~F.array_contains(_lit_array(stop), t)) & (F.char_length(t) > 1))
    return F.concat(F.lit(" "), F.aggregate(kept, F.lit(""), lambda acc, t: F.concat(acc, F.lit(" "), t)))


def proc(c) -> Column:
    """Non-word characters -> blank, lower-case, trim (scorer preprocessing).

    Word characters are letters, numbers and the underscore, by Unicode
    category, as Python's ``\\w`` has them; combining marks are not.
    """
    return F.trim(F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}_]", " ")))


def sorted_token_string(c) -> Column:
    """Sorted distinct tokens of ``proc(c)`` joined by one blank."""
    toks = F.filter(F.split(proc(c), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(toks)), " ")


def cpe_part(c, i: int) -> Column:
    """Vendor (1), software (2) or release (3) of a CPE 2.3 name; null if not an application name."""
    col = _col(c)
    return F.when(col.rlike(K.CPE23_PATTERN), F.regexp_extract(col, K.CPE23_PATTERN, i))


def java_release(vendor, software, cpe23, release) -> Column:
    """Release used for version gating; JDK/JRE entries get their release rebuilt from the CPE name."""
    name = _col(cpe23)
    has_update = name.contains("update")
    upd_ok = name.rlike(K.JAVA_UPDATE_PATTERN)
    rel_ok = name.rlike(K.JAVA_RELEASE_PATTERN)
    u_sft = F.regexp_extract(name, K.JAVA_UPDATE_PATTERN, 2)
    u_rel = F.regexp_extract(name, K.JAVA_UPDATE_PATTERN, 3)
    u_upd = F.regexp_extract(name, K.JAVA_UPDATE_PATTERN, 4)
    r_sft = F.regexp_extract(name, K.JAVA_RELEASE_PATTERN, 2)
    r_rel = F.regexp_extract(name, K.JAVA_RELEASE_PATTERN, 3)
    sft = F.when(has_update, u_sft).otherwise(r_sft)
    rel = F.when(has_update, u_rel).otherwise(r_rel)
    tmp = F.when(has_update, F.concat(u_rel, F.lit("."), u_upd, F.lit("0"))).otherwise(r_rel)
    fixed = (
        F.when(~F.when(has_update, upd_ok).otherwise(rel_ok), F.lit(K.NO_VERSION))
        .when(rel.contains("_"), F.concat(F.lit("1."), rel))
        .when(sft == "jre", tmp)
        .when(rel.startswith("8."), tmp)
        .otherwise(F.concat(F.lit("1."), tmp))
    )
    is_java = _col(vendor).isin(*K.JAVA_VENDORS) & _col(software).isin(*K.JAVA_PRODUCTS)
    return F.when(is_java, fixed).otherwise(_col(release))


def strip_vendor(c, vendor) -> Column:
    """Lower-case and replace every literal occurrence of the vendor by a blank."""
    return F.replace(F.lower(_col(c)), _col(vendor), F.lit(" "))


def fill_version(c) -> Column:
    return F.coalesce(_col(c), F.lit(K.NO_VERSION))


def ordinal(c, levels: list[str]) -> Column:
    """Ordered category -> 1-based level; unknown or null -> null."""
    pos = F.array_position(_lit_array(levels), _col(c)).cast("int")
    return F.when(pos > 0, pos)


def level(c, levels: list[str]) -> Column:
    """Inverse of :func:`ordinal`.

    The null guard is explicit: element_at over a literal array with a null
    index column does not yield null in generated code (seen on Spark 4.1).
    """
    idx = _col(c)
    return F.when(idx.isNotNull(), F.element_at(_lit_array(levels), idx))


def score_num(c) -> Column:
    """String -> double, unparsable -> null."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def criticality(score, complexity, vector) -> Column:
    """High / Medium / Low from worst-case CVSS values (nulls are 'not easy / not remote')."""
    s, cx, v = _col(score), _col(complexity), _col(vector)
    easy = F.coalesce(cx.isin(*K.EASY_COMPLEXITY), F.lit(False))
    remote = F.coalesce(v.isin(*K.REMOTE_VECTOR), F.lit(False))
    high = F.coalesce(s > K.HIGH_SCORE_ABOVE, F.lit(False)) & easy & remote
    low = F.coalesce(s < K.LOW_SCORE_BELOW, F.lit(False)) | (~easy & ~remote)
    return F.when(high, "High").when(low, "Low").otherwise("Medium")


def host_function(dn) -> Column:
    """desktop / laptop / server from the DN's OU, else null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(_col(dn))), K.HOST_FN_PATTERN, 1), F.lit(""))


def title_en(title) -> Column:
    """CPE title: a single title whatever its language, else the first en-US one."""
    t = _col(title)
    en = F.filter(t, lambda e: e["_xml:lang"] == "en-US")
    return F.when(F.size(t) == 1, t[0]["_VALUE"]).otherwise(F.get(en, 0)["_VALUE"])
