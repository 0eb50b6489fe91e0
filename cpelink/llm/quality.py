"""Quality rules: base counts and divergence from language references.

Every document is reduced in one native pass to base counts, a histogram of
character classes and a histogram of its language's common words. References are
made of the distinct texts that pass the base rules, each counted once:

1. per language and class the median share, from counts of shares in thousandths,
   which combine map-side; less than half of junk cannot move it far;
2. the texts whose classes lie within the limit of the medians are the language's
   normal texts; the reference is their mean histogram (every text weighs the same, so
   a few long ones cannot set it).

Languages without a word list have a reference of character classes only.
A document is kept unless a base rule fails or the Jensen-Shannon distance of
either histogram to its reference, or their sum, is over its limit. A distance counts
by n / (n + ``prior``), n being the normal texts behind the reference, so little
known languages are judged mildly and there is no step. Short texts
have noisy histograms, so a limit widens with 1 / sqrt(words), and texts under
``min_words`` words are left to the base rule.

Only one small row per document is written between the two steps; the reference
table has one row per language.

Defined cases: a null text has no words and fails the base rule; an unlisted
language is judged by the character classes of its own documents; null and '' count as
one such language; where a language has no normal text there is nothing to compare with,
the distances are null and the base rule alone decides; a very long text is counted whole,
in one row of counts; repeated rows are judged alike; an empty table gives an empty result.
Other columns, whatever their names, pass through ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release_scratch, scratch_count
from .textcols import SPACES, let, row_key, space_words, text_of, upto

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on",
           "not", "he", "this", "are", "or", "from", "at", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
           "nicht", "ein", "eine", "als", "auch", "es", "an", "er"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a",
           "par", "plus", "pas", "au", "sur", "ne", "se", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una",
           "su", "para", "es", "al", "lo", "como", "más", "o"],
}


@dataclass(frozen=True)
class Limits:
    """Limits of the rules; distances are Jensen-Shannon distances in 0..1."""
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Normal texts from which on a reference counts by half and more.
    prior: int = 30
    #: A limit is (level, noise): the distance must not be over level + noise / sqrt(words).
    class_distance: tuple[float, float] = (0.22, 0.5)
    word_distance: tuple[float, float] = (0.13, 2.2)
    both: tuple[float, float] = (0.42, 0.8)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""
    def starts(s: Column) -> Column:
        n = F.size(s)
        return F.sort_array(F.transform(F.filter(s, lambda x, j: (
            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])))),
            lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k < F.size(at) - 1, F.least(F.lit(3), F.get(at, k + 1) - p))
                            .otherwise(3).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(let(let(ordered, starts), covered)))

    grams = F.transform(upto(F.size(words) - 2),
                        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return let(grams, of)


def _count_of(text: Column, others: str) -> Column:
    """Code points of ``text`` outside the pattern ``others``."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            rows: bool = False) -> DataFrame:
    """One row per document: base counts and the two histograms; with ``rows`` also the document's own row, as ``__row``."""
    text = text_of(text_col)
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if rows else []
    base = docs.select(*row_key(id_col, text), F.col(id_col).alias("id"), lang.alias("lang"), text.alias("t"), *own)
    own = ["__row"] if rows else []

    def common_counts(w: Column, listed: list[str]) -> Column:
        return let(F.filter(w, lambda x: x.isin(listed)), lambda c: F.array(
            *[(F.size(c) - F.size(F.array_remove(c, x))).cast("long") for x in listed],
            (F.size(w) - F.size(c)).cast("long")))

    def on_words(w: Column) -> Column:
        common = F.lit(None).cast("array<long>")
        for name, listed in COMMON_WORDS.items():
            common = F.when(F.col("lang") == name, common_counts(w, listed)).otherwise(common)
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        _repeat_words(w).alias("n_repeat_words"), common.alias("common"))

    with_word = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dup_lines = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    found = base.select(
        "__id", "__th", "id", "lang", F.char_length("t").cast("long").alias("n_chars"),
        let(space_words(F.col("t")), on_words).alias("w"), dup_lines.alias("n_dup_lines"),
        _count_of(F.col("t"), "[^#*$%&|<>]+").alias("n_symbols"),
        _count_of(F.col("t"), "[^a-z]+").alias("c_lower"), _count_of(F.col("t"), "[^A-Z]+").alias("c_upper"),
        _count_of(F.col("t"), "[^0-9]+").alias("c_digit"), _count_of(F.col("t"), r"[\x00-\x7F]+").alias("c_other"), *own)
    space = F.col("n_chars") - F.col("w.word_chars")
    punct = F.col("w.word_chars") - F.col("c_lower") - F.col("c_upper") - F.col("c_digit") - F.col("c_other") \
        - F.col("n_symbols")
    return found.select("__id", "__th", "id", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines",
                        "w.n_repeat_words", "w.common",
                        F.array("c_lower", "c_upper", "c_digit", "c_other", "n_symbols", space, punct).alias("classes"), *own)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares of the same length."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _too_far(found: Column, limit: tuple[float, float]) -> Column:
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    return found > limit[0] + limit[1] / root


def references(measured: DataFrame, limits: Limits) -> DataFrame:
    """(lang, ref_n, ref_classes, ref_common): mean shares of a language's normal texts; no words for unlisted ones."""
    n_class, longest = 7, max(map(len, COMMON_WORDS.values())) + 1
    used = materialize(
        measured.where((F.col("n_words") >= limits.min_words) & ~F.col("base_failed")).groupBy("lang", "__th")
        .agg(*[F.first(c).alias(c) for c in ("n_words", "classes", "common")])
        .select("lang", "n_words", _shares(F.col("classes")).alias("p"), _shares(F.col("common")).alias("c")), "quality_distinct")
    bins = used.select("lang", F.posexplode(F.transform("p", lambda x: F.floor(x * 1000))).alias("i", "bin")) \
        .groupBy("lang", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang", "i")           # 1,001 rows at most
    half = bins.withColumn("below", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own)) \
        .where(2 * F.col("below") >= F.col("all")).groupBy("lang", "i").agg(F.min("bin").alias("bin"))
    medians = half.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "bin"))).alias("m"))
    # written, so that its size is known and the texts of a frequent language are not dealt to one task
    medians = materialize(medians.select("lang", _shares(F.transform("m", lambda x: 2 * x["bin"] + 1)).alias("m")), "quality_medians")
    normal = used.join(medians, "lang").where(~_too_far(distance(F.col("p"), F.col("m")), limits.class_distance))
    per = normal.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n_class)]).alias("p"),
        F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(longest)]).alias("c"))
    mean = lambda c: F.transform(c, lambda x: x / F.col("n"))
    return per.select("lang", F.col("n").alias("ref_n"), mean(F.col("p")).alias("ref_classes"),
                      F.when(F.col("lang").isin(list(COMMON_WORDS)), mean(F.col("c"))).alias("ref_common"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          limits: Limits = Limits(), rows: bool = False) -> DataFrame:
    """(__id, __th, id, counts, class_distance, word_distance, base_failed, kept): one row per document (and ``__row``)."""
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    measured = materialize(measure(docs, id_col, text_col, lang_col, rows).withColumn("base_failed", failed), "quality_counts",
                           "zstd" if rows else "snappy")
    mark = scratch_count(docs.sparkSession)
    refs = materialize(references(measured, limits), "quality_references")
    release_scratch(docs.sparkSession, since=mark, keep=1)
    ref_common = F.slice("ref_common", F.lit(1), F.size("common"))
    scored = measured.join(refs, "lang", "left").withColumns({
        "class_distance": F.when(F.col("ref_n").isNotNull(), distance(_shares(F.col("classes")), F.col("ref_classes"))),
        "word_distance": F.when(F.col("ref_common").isNotNull(), distance(_shares(F.col("common")), ref_common))})
    weight = F.coalesce(F.col("ref_n") / (F.col("ref_n") + limits.prior), F.lit(0.0))
    by_chars, by_words = (weight * F.coalesce(c, F.lit(0.0)) for c in ("class_distance", "word_distance"))
    far = _too_far(by_chars, limits.class_distance) | _too_far(by_words, limits.word_distance) | _too_far(by_chars + by_words, limits.both)
    return scored.withColumn("kept", ~F.col("base_failed") & ~far).drop("ref_n", "ref_classes", "ref_common")


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their columns unchanged.

    Rows are written with their counts, so that they need not be shuffled to meet their verdicts.
    Rows equal in id and text but not in language share the worst verdict; keys with two verdicts are few.
    """
    judged = judge(docs, id_col, text_col, lang_col, limits, rows=True)
    mixed = materialize(judged.groupBy("__id", "__th").agg(F.min("kept").alias("all"), F.max("kept").alias("any"))
                        .where(F.col("any") & ~F.col("all")).select("__id", "__th"), "mixed_verdicts")
    return judged.where("kept").join(mixed, ["__id", "__th"], "left_anti").select("__row.*")


def _oracle(limits: Limits = Limits()) -> str:
    listed = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in COMMON_WORDS.items()}
    common = " ".join(
        f"WHEN '{k}' THEN list_append(list_transform({v}, lambda x: len(list_filter(w, lambda y: y = x))), "
        f"len(list_filter(w, lambda y: NOT list_contains({v}, y))))" for k, v in listed.items())
    over = " OR ".join(f"{d} > {level} + {noise} / sqrt(greatest(n_words, 1))" for d, (level, noise) in (
        ("wt * cd", limits.class_distance), ("wt * wd", limits.word_distance), ("wt * cd + wt * wd", limits.both)))
    near = "{} <= {} + {} / sqrt(greatest(n_words, 1))".format("md", *limits.class_distance)
    spread = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
         coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT rn, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
often AS (SELECT rn, g FROM grams GROUP BY rn, g HAVING count(*) > 1),
rep AS (SELECT rn, count(DISTINCT i + k) AS n FROM grams JOIN often USING (rn, g), range(3) r(k) GROUP BY rn),
m0 AS (
  SELECT rn, t, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS lo,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS dg,
         length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS ot, CASE lang {common} END AS common
  FROM w LEFT JOIN rep USING (rn)),
m AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM m0),
once AS (SELECT min(rn) AS rn, lang FROM m WHERE NOT base_failed GROUP BY lang, t),
c AS (SELECT rn, lang, n_words, generate_subscripts(v, 1) AS i, unnest(v) / nullif(n_chars, 0) AS p FROM (
  SELECT *, [lo, up, dg, ot, n_symbols, n_chars - word_chars, word_chars - lo - up - dg - ot - n_symbols] AS v FROM m)),
k AS (SELECT rn, lang, n_words, generate_subscripts(common, 1) AS i, unnest(common) / nullif(n_words, 0) AS p FROM m
      WHERE common IS NOT NULL),
bins AS (SELECT lang, i, floor(coalesce(p, 0) * 1000) AS bin, count(*) AS n FROM c SEMI JOIN once USING (rn) GROUP BY ALL),
half AS (SELECT lang, i, min(bin) AS bin FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, i ORDER BY bin) AS below, sum(n) OVER (PARTITION BY lang, i) AS total FROM bins)
  WHERE 2 * below >= total GROUP BY lang, i),
med AS (SELECT lang, i, (2 * bin + 1) / sum(2 * bin + 1) OVER (PARTITION BY lang) AS q FROM half),
normal AS (SELECT rn, lang FROM (
  SELECT rn, lang, any_value(n_words) AS n_words, {spread} AS md
  FROM (SELECT rn, lang, n_words, coalesce(p, 0) AS p, q FROM c SEMI JOIN once USING (rn) JOIN med USING (lang, i)) GROUP BY rn, lang)
  WHERE {near}),
weight AS (SELECT lang, count(*) / (count(*) + {limits.prior}) AS wt FROM normal GROUP BY lang),
cr AS (SELECT lang, i, avg(coalesce(p, 0)) AS q FROM c SEMI JOIN normal USING (rn) GROUP BY lang, i),
kr AS (SELECT lang, i, avg(coalesce(p, 0)) AS q FROM k SEMI JOIN normal USING (rn) GROUP BY lang, i),
cd AS (SELECT rn, {spread} AS cd FROM (SELECT rn, coalesce(p, 0) AS p, q FROM c JOIN cr USING (lang, i)) GROUP BY rn),
wd AS (SELECT rn, {spread} AS wd FROM (SELECT rn, coalesce(p, 0) AS p, q FROM k JOIN kr USING (lang, i)) GROUP BY rn),
j AS (SELECT m.*, coalesce(cd, 0) AS cd, coalesce(wd, 0) AS wd, cd AS shown_c, wd AS shown_w, coalesce(wt, 0) AS wt
      FROM m LEFT JOIN cd USING (rn) LEFT JOIN wd USING (rn) LEFT JOIN weight USING (lang))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR {over}) AS kept, round(shown_c, 6) AS class_distance, round(shown_w, 6) AS word_distance
FROM j
"""


ORACLE = _oracle()
