import random

import numpy as np
import pair_scores as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cpelink.functions import scoring as S


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde _.", max_size=30), st.text(alphabet="abcde _.", max_size=30))
def test_lcs_matches_dp(a, b):
    assert P.lcs_len(a, b) == lcs_dp(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c1", max_size=15), st.text(alphabet="ab c1", max_size=15))
def test_scores_bounded_and_symmetric(a, b):
    s1, s2 = P.all_scores(a, b), P.all_scores(b, a)
    assert all(0 <= x <= 100 for x in s1)
    # ratio, token_set and weighted are symmetric
    assert s1[0] == s2[0] and s1[2] == s2[2] and s1[6] == s2[6]


def test_known_values():
    assert P.ratio("abc", "abc") == 100
    assert P.ratio("", "") == 0 and P.partial_ratio("", "") == 0  # nothing to compare, as the scores are specified
    assert P.ratio("a", "") == 0
    assert P.ratio("abcd", "abce") == 75
    assert P.partial_ratio("brand1", "brand11") == 100
    assert P.partial_token_set("  brand1", "  brand11") == 100
    assert P.partial_token_set("  adobe", "  adobe systems") == 100
    assert P.token_set("new york mets", "mets new york") == 100
    assert P.token_sort("b a", "a b") == 100
    assert P.weighted("", "x") == 0


def test_partial_ratio_is_best_window():
    # shorter string against every full window of the longer one
    for _ in range(200):
        a = "".join(random.choice("abc") for _ in range(random.randint(1, 6)))
        b = "".join(random.choice("abc") for _ in range(random.randint(len(a), 10)))
        best = max(lcs_dp(a, b[i:i + len(a)]) for i in range(len(b) - len(a) + 1))
        expect = 100 if a == b else P.intr(100 * (2.0 * best / (2 * len(a))))
        assert P.partial_ratio(a, b) == expect


def test_udf_matches_python(spark):
    random.seed(3)
    words = ["blue", "anvil", "inc", "x", "o'neil", "brand1", "brand11", ""]
    pairs = [(" ".join(random.sample(words, 3)), " ".join(random.sample(words, 2))) for _ in range(200)]
    df = spark.createDataFrame(pairs + [(None, "a")], "a string, b string")
    got = df.select("a", "b", S.pair_scores("a", "b").alias("s")).collect()
    for r in got:
        exp = P.all_scores(r.a, r.b)
        assert tuple(r.s) == exp


def test_version_gate_native_equals_scores(spark):
    random.seed(5)
    alphabet = "0123.-"
    vals = ["-"] + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 9))) for _ in range(80)]
    pairs = [(a, b) for a in vals[:40] for b in vals[40:]] + [(v, v) for v in vals]
    df = spark.createDataFrame(pairs, "r string, v string")
    got = {(r.r, r.v): r.ok for r in df.select("r", "v", S.version_gate("r", "v").alias("ok")).collect()}
    for (r, v), ok in got.items():
        expect = r == "-" or v == "-" or (P.ratio(r, v) >= 90 and P.partial_ratio(r, v) == 100)
        assert ok == expect, (r, v)


def test_batch_lcs_over_many_lengths():
    """Lanes of unlike lengths, several words a lane, characters beyond the basic plane, NUL inside and at the end."""
    rnd = random.Random(1)
    sizes = [1, 2, 3, 8, 20, 63, 64, 65, 130, 200]

    def text():
        return "".join(rnd.choice("abcde _.é😀") for _ in range(rnd.choice(sizes)))

    pairs = [(text(), text()) for _ in range(400)] + [("a\x00b\x00", "a\x00"), ("ab", "ba"), ("x", "y"), ("\x00", "a")]
    a, b = (np.array(x, object) for x in zip(*pairs))
    assert S.lcs_lengths(a, b, False).tolist() == [P.lcs_len(x, y) for x, y in pairs]
    best = []
    for x, y in pairs:
        s, long = (x, y) if len(x) <= len(y) else (y, x)
        best.append(max(P.lcs_len(s, long[i:i + len(s)]) for i in range(len(long) - len(s) + 1)))
    assert S.lcs_lengths(a, b, True).tolist() == best


def test_all_scores_of_unlike_pairs(spark):
    rnd = random.Random(9)
    words = "Blue anvil INC x o'neil brand1 brand11 ring ring, plate. straße Ünal 中文 a_b ét ٣٤".split() + ["w" * 70, "-", "  "]
    pairs = [(" ".join(rnd.choices(words, k=rnd.randint(0, 6))), " ".join(rnd.choices(words, k=rnd.randint(0, 3)))) for _ in range(400)]
    pairs += [("", ""), ("a", ""), (None, "a"), (None, None), ("same text", "same text"), ("long " * 60, "long lang")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for fields in (S.SCORE_FIELDS, ["weighted"], ["ptl_token_set"], ["token_sort", "partial"]):
        got = df.select("a", "b", S.pair_scores("a", "b", fields).alias("s")).collect()
        for r in got:
            want = dict(zip(P.SCORE_FIELDS, P.all_scores(r.a, r.b)))
            assert r.s.asDict() == {f: want[f] for f in fields}, (r.a, r.b)
