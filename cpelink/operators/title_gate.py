"""The title gate through inverted indexes.

The gate is ``partial_token_set >= 70``. It depends only on the two sets of tokens, so
it is judged on their sorted token strings. Within a vendor

* strings that share a token score 100. They meet in an inverted index on (vendor,
  token);
* strings that share none score the best common subsequence of the shorter one, of n
  characters, with a window of the longer one, which has to hold 0.695 n of them. A
  string is a bag of characters; the k-th occurrence of a character is an element of
  its own. So the longer string must have all but n - t of the shorter one's elements,
  t = ceil(0.695 n), and at least one of any n - t + 1 of them: each string posts all its
  elements, the shorter one looks up the first n - t + 1 in an order that puts the rare
  ones first. What two bit signatures of the bags leave open, and no other pair,
  reaches the scorer.

Index keys with much work are split: a key whose postings would make more than
``SPLIT_PAIRS`` pairs deals its larger side over as many salts as it needs and repeats
the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from ..functions import scoring as S
from ..session import materialize

#: Pairs of postings that one key leaves to one task.
SPLIT_PAIRS = 1 << 20
#: Characters from the most to the least used in names; any other is rarer. Only the order of look-ups depends on it.
COMMON = " eaotirnslcdmupghbfyvwk0123456789xjqz"


def split_join(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Inner join on ``keys`` in which no task makes many more than ``most`` (``SPLIT_PAIRS``) pairs of one key."""
    most = most or SPLIT_PAIRS
    counts = left.groupBy(*keys).agg(F.count("*").alias("__l")).join(right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    salts = F.ceil(F.col("__l") * F.col("__r") / F.lit(most))
    heavy = materialize(counts.where(F.col("__l") * F.col("__r") > most).select(
        *keys, F.least(salts, F.greatest("__l", "__r")).cast("int").alias("__salts"),
        (F.col("__l") >= F.col("__r")).alias("__left")), "heavy_keys")

    def salted(side: DataFrame, dealt: Column) -> DataFrame:
        one = F.pmod(F.xxhash64(*side.columns), F.col("__salts")).cast("int")
        salt = F.when(F.col("__salts").isNull(), F.array(F.lit(0))).when(dealt, F.array(one)) \
            .otherwise(F.sequence(F.lit(0), F.col("__salts") - 1))
        return side.join(heavy, keys, "left").select(*side.columns, F.explode(salt).alias("__salt"))

    if heavy.limit(1).count():
        left, right, keys = salted(left, F.col("__left")), salted(right, ~F.col("__left")), [*keys, "__salt"]
    # few bytes of postings make many pairs: an explicit count keeps them from being packed into one task
    n = score_partitions(left)
    return left.repartition(n, *keys).join(right.repartition(n, *keys), keys).drop("__salt")


def tokens(c: str) -> Column:
    """Tokens of a sorted token string."""
    return F.filter(F.split(F.col(c), " "), lambda t: t != "")


def least_common(n: Column) -> Column:
    """A lower bound, by at most one, of the characters of n that must be common for the gate's points."""
    # intr(100 m / n) >= gate; a hair below its half point, so that no rounding of the score gets past it
    share = int(1000 * K.TITLE_GATE) - 501
    return F.ceil(n * F.lit(share) / F.lit(100_000.0)).cast("int")


def elements(c: str) -> Column:
    """The bag of characters of a string, the k-th occurrence of a character as one element, the rarest first.

    An element is its place in the order and the character: later occurrences
    come before earlier ones, rare characters before common ones.
    """
    def of(chars: Column) -> Column:
        def element(x: Column, i: Column) -> Column:
            nth = i + 2 - F.array_position(chars, x).cast("int")
            rank = 99 - F.position(x, F.lit(COMMON))
            return F.concat(F.lpad((99999999 - nth).cast("string"), 8, "0"),
                            F.lpad((rank % 99).cast("string"), 2, "0"), x)
        return F.array_sort(F.transform(chars, element))

    return N.let(F.array_sort(F.filter(F.split(F.col(c), ""), lambda x: x != "")), of)


def _signature(e: Column, salt: int) -> Column:
    return F.aggregate(e, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x, F.lit(salt)), F.lit(64)))))


def _alike(n: Column, short: list[Column], long: list[Column]) -> Column:
    """Whether signatures leave it open that the longer string has enough of the shorter one's n characters."""
    spare = n - least_common(n)
    both = F.lit(True)
    for x, y in zip(short, long):  # a bit of the shorter one that the longer lacks is a character that it lacks
        both = both & (F.bit_count(x.bitwiseAND(F.bitwise_not(y))) <= spare)
    return both


#: Kinds of postings: tokens; characters with the title as the shorter string; with the display name as the shorter.
_TOKEN, _TITLE_SHORT, _DISPLAY_SHORT = 0, 1, 2


def _bags(df: DataFrame, c: str) -> DataFrame:
    bag = N.let(elements(c), lambda e: F.struct(
        e.alias("e"), F.size(e).alias("n"), _signature(e, 1).alias("s1"), _signature(e, 2).alias("s2")))
    return df.select("vendor_X", c, "open", tokens(c).alias("toks"), bag.alias("b"))


def _sized(bags: DataFrame, c: str, to: str) -> DataFrame:
    return bags.select("vendor_X", c, F.col("b.n").alias(to + "n"), F.col("b.s1").alias(to + "1"), F.col("b.s2").alias(to + "2"))


def _postings(bags: DataFrame, c: str, short: int, long: int, to: str) -> DataFrame:
    """One row for each token, for the first elements as the shorter string and for all elements as the longer."""
    def keyed(kind: int, keys: Column) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))

    first = F.slice("b.e", F.lit(1), F.col("b.n") - least_common(F.col("b.n")) + 1)
    keys = F.concat(keyed(_TOKEN, F.col("toks")), keyed(short, first), keyed(long, F.col("b.e")))
    return bags.select("vendor_X", F.explode(keys).alias("k"), c, F.col("open").alias(to + "o"), F.col("b.n").alias(to + "n"),
                       F.col("b.s1").alias(to + "1"), F.col("b.s2").alias(to + "2")) \
        .select("vendor_X", "k.kind", "k.x", c, to + "o", to + "n", to + "1", to + "2")


def _sides() -> tuple[list[Column], list[Column]]:
    return [F.col("a1"), F.col("a2")], [F.col("b1"), F.col("b2")]


def meeting(titles: DataFrame, displays: DataFrame) -> DataFrame:
    """(vendor_X, ca, cb, shared): open pairs of bags that share a token, or share none and could pass by their signatures."""
    met = split_join(_postings(titles, "ca", _TITLE_SHORT, _DISPLAY_SHORT, "a"),
                     _postings(displays, "cb", _DISPLAY_SHORT, _TITLE_SHORT, "b"), ["vendor_X", "kind", "x"])
    kind, an, bn = F.col("kind"), F.col("an"), F.col("bn")
    a, b = _sides()
    alike = F.when(kind == _TITLE_SHORT, (an <= bn) & _alike(an, a, b)) \
        .when(kind == _DISPLAY_SHORT, (bn < an) & _alike(bn, b, a)).otherwise(True)
    # a pair that shares a token meets at it, wherever else it meets
    return met.where((F.col("ao") | F.col("bo")) & alike).groupBy("vendor_X", "ca", "cb") \
        .agg(F.bool_or(kind == _TOKEN).alias("shared"))


def passing_titles(titles: DataFrame, displays: DataFrame, given: DataFrame) -> DataFrame:
    """(vendor_X, ca, cb): the token strings that pass the gate together.

    ``titles`` (vendor_X, ca, open) and ``displays`` (vendor_X, cb, open) are judged
    wherever one of the two is open, that is, stands for an entry without a version;
    ``given`` pairs are judged as they are.
    """
    t, d = materialize(_bags(titles, "ca"), "title_bags"), materialize(_bags(displays, "cb"), "display_bags")
    asked = given.withColumn("shared", F.arrays_overlap(tokens("ca"), tokens("cb")))
    met = materialize(meeting(t, d).unionByName(asked).distinct(), "met_titles")
    a, b = _sides()
    judged = met.where(~F.col("shared")).join(_sized(t, "ca", "a"), ["vendor_X", "ca"]).join(_sized(d, "cb", "b"), ["vendor_X", "cb"])
    judged = judged.where((F.least("an", "bn") > 0) & F.when(F.col("an") <= F.col("bn"), _alike(F.col("an"), a, b))
                          .otherwise(_alike(F.col("bn"), b, a))).select("ca", "cb").distinct()
    judged = judged.repartition(score_partitions(judged), "ca", "cb")
    # without a shared token the gate's score is the partial ratio of the token strings
    passed = judged.select("ca", "cb", S.pair_scores("ca", "cb", ["partial"])["partial"].alias("gate")) \
        .where(F.col("gate") >= K.TITLE_GATE).select("ca", "cb")
    unlike = met.where(~F.col("shared")).join(passed, ["ca", "cb"]).select("vendor_X", "ca", "cb")
    return met.where("shared").select("vendor_X", "ca", "cb").union(unlike)


def score_partitions(df: DataFrame) -> int:
    """Partition count for a Python-scored stage.

    Scoring is CPU-bound while the rows are small, so runtime coalescing
    would squeeze the work into a few tasks; an explicit count keeps every
    core busy (at least the shuffle partition count).
    """
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
