import math
import random
import re

import pytest

from cpelink.llm import quality as Q

WS = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    hit = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in t.split("\n") if WS.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def prose(rnd, lang, n):
    common = Q.COMMON_WORDS[lang]
    return " ".join(rnd.choice(common) if rnd.random() < 0.45 else
                    "".join(rnd.choice("aeioulnrstdm") for _ in range(rnd.randint(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus(hard_texts):
    rnd = random.Random(11)
    rows = [(1000 + k, prose(rnd, ("en", "de", "fr", "es")[k % 4], rnd.randint(60, 400)), ("en", "de", "fr", "es")[k % 4])
            for k in range(600)]
    junk = [" ".join(w + "***" for w in prose(rnd, "en", 200).split()), prose(rnd, "en", 200).upper() + "!!",
            " ".join("".join(rnd.choice("aeioulnrstdm") for _ in range(7)) + " |" for _ in range(200)),
            " ".join(str(rnd.randrange(10 ** 6)) for _ in range(200)), ("buy now today " * 90)]
    rows += [(2000 + k, t, "en") for k, t in enumerate(junk)]
    rows += [(3000, prose(rnd, "en", 200), None), (3001, prose(rnd, "en", 200), "xx"), (3000, prose(rnd, "en", 60), "en"),
             (3002, "word " * 49, "en"), (3003, " ".join(f"w{i}" for i in range(50)), "en")]
    return hard_texts + rows


def test_base_columns(make_docs, corpus):
    rep = Q.quality_report(make_docs(corpus))
    got = [tuple(r) for r in rep.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed").collect()]
    assert order(got) == order([(i, *base(t)) for i, t, _ in corpus])


def test_verdicts(make_docs, corpus):
    docs = make_docs(corpus)
    rows = Q.quality_report(docs).collect()
    kept = {(r.doc_id, r.n_words): r.kept for r in rows}
    assert not any(r.kept for r in rows if r.base_failed)
    assert all(v for (i, _), v in kept.items() if i is not None and 1000 <= i < 2000)
    assert not any(v for (i, _), v in kept.items() if i is not None and 2000 <= i < 2100)
    assert kept[(3000, 200)] and kept[(3001, 200)]  # no or unknown language: judged by characters alone
    left = Q.keep_good(docs)
    assert left.columns == docs.columns
    assert order([(r.doc_id, len(WS.findall(r.text or ""))) for r in left.collect()]) == order(
        [(r.doc_id, r.n_words) for r in rows if r.kept])


def test_distance(spark):
    from pyspark.sql import functions as F
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.4, 0.0, 0.5]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
        Q.distance(F.col("p"), F.col("q")).alias("d"), Q.distance(F.col("p"), F.col("p")).alias("same")).first()
    assert abs(row.d - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12 and row.same == 0


def test_empty_table(make_docs):
    assert Q.quality_report(make_docs([])).collect() == []


def test_unlisted_language_has_its_own_reference(make_docs):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("аеиоулнрстдм") for _ in range(rnd.randint(3, 9)))
    rows = [(k, prose(rnd, "en", 150), "en") for k in range(300)]
    rows += [(1000 + k, " ".join(word() for _ in range(150)), "ru") for k in range(50)]
    rows += [(2000 + k, " ".join(word() for _ in range(150)), lang) for k, lang in enumerate(["uk", None, ""])]
    rows += [(3000, " ".join(str(rnd.randrange(10 ** 6)) for _ in range(150)), "ru")]
    kept = {r.doc_id: r.kept for r in Q.quality_report(make_docs(rows)).collect()}
    assert all(kept[k] for k in kept if k < 3000) and len(kept) == len(rows)
    assert not kept[3000]


@pytest.mark.parametrize("junk", ["copies", "digits", "capitals"])
def test_a_third_of_junk_moves_no_verdict(make_docs, junk):
    rnd = random.Random(21)
    clean = [(k, prose(rnd, "en", rnd.randint(60, 300)), "en") for k in range(400)]
    made = {"copies": lambda: "### $$$ %% " * 100, "digits": lambda: " ".join(str(rnd.randrange(10 ** 6)) for _ in range(150)),
            "capitals": lambda: prose(rnd, "en", 150).upper() + "!!"}[junk]
    before = {r.doc_id for r in Q.quality_report(make_docs(clean)).collect() if r.kept}
    after = {r.doc_id for r in Q.quality_report(make_docs(clean + [(1000 + k, made(), "en") for k in range(200)])).collect() if r.kept}
    assert len(before) >= 0.97 * len(clean)
    assert len(before & after) >= 0.97 * len(before)
    assert not any(i >= 1000 for i in after)


def test_no_step_in_the_number_of_documents(make_docs):
    """A page of digits among n Cyrillic ones: its weighted distance grows with n without a jump."""
    rnd, seen = random.Random(5), []
    word = lambda: "".join(rnd.choice("аеиоулнрстдм") for _ in range(rnd.randint(3, 9)))
    digits = " ".join(str(rnd.randrange(10 ** 6)) for _ in range(150))
    texts = [" ".join(word() for _ in range(150)) for _ in range(31)]
    for n in (1, 4, 29, 30, 31):
        rows = [(k, t, "ru") for k, t in enumerate(texts[:n])] + [(99, digits, "ru")]
        got = {r.doc_id: r for r in Q.quality_report(make_docs(rows)).collect()}
        assert all(got[k].kept for k in range(n))
        seen.append(got[99].kept)
    assert seen == sorted(seen, reverse=True) and len(set(seen[2:])) == 1


def test_nothing_to_compare_with_is_null(make_docs):
    rows = [(1, "few words", "xx"), (2, "buy now today " * 90, "yy"), (3, None, None)]
    got = {r.doc_id: r for r in Q.quality_report(make_docs(rows)).collect()}
    assert all(got[k].class_distance is None and got[k].word_distance is None and not got[k].kept for k in (1, 2, 3))


def test_twin_on_listed_unlisted_and_missing_languages(make_docs, corpus):
    import duckdb
    rnd = random.Random(3)
    rows = corpus + [(4000 + k, prose(rnd, "en", 80), ["xx", None, "", "uk"][k % 4]) for k in range(60)]
    rows = [r for r in rows if r[0] is not None]
    docs = make_docs(rows)
    got = docs.sparkSession.createDataFrame(Q.quality_report(docs).collect()).toPandas()
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(Q.ORACLE).df()
    key = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert [tuple(map(str, r)) for r in key(got)] == [tuple(map(str, r)) for r in key(want)]


def test_kept_rows_are_not_shuffled(spark):
    from cpelink.llm import quality
    long = " ".join(f"w{i}x" for i in range(60))
    rows = [(k, f"{long} word{k}", "en", k % 4) for k in range(30)] + [(k, f"short {k}", "en", 0) for k in range(30, 4030)]
    docs = spark.createDataFrame([*rows, (None, None, None, 1)], "doc_id long, text string, lang string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)      # less than 4,000 rejected keys
    try:
        kept = quality.keep_good(docs)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        told = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
        assert kept.columns == docs.columns and len(told) == 30
        assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in told)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_row_of_two_languages_shares_the_worst_verdict(spark):
    from cpelink.llm import quality
    digits = [(200 + k, " ".join(str(1000 * k + i) for i in range(60)), "xx") for k in range(60)]
    words = [(k, " ".join("abcdefghij"[(k * i) % 10] * 4 + chr(97 + (i + k) % 26) + chr(97 + i % 26) for i in range(60)), "yy") for k in range(1, 61)]
    docs = spark.createDataFrame([*digits, *words, (205, digits[5][1], "yy")], "doc_id long, text string, lang string")
    told = {(r.doc_id, r.kept) for r in quality.quality_report(docs).where("doc_id = 205").collect()}
    assert told == {(205, True), (205, False)}
    assert quality.keep_good(docs).where("doc_id = 205").count() == 0
