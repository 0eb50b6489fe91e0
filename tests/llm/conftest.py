import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, n long, words string, drop int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """``documents`` with more columns, whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, "w", 3) for i, t, lang in rows],
                                     DOCS)
    return make


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty, blank, very long, repeated, non-ASCII texts and copies with small edits; ids null and repeated."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."

    base = [prose(120) for _ in range(12)]
    shared = prose(9)
    rows = [(k, t, "en") for k, t in enumerate(base)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "  \n\t ", None), (23, "word", "xx"), (24, "WORD\x0bTwo", "en"),
             (25, "É" * 30 + " ñandú 😀 Straße", "es"), (26, "a" * 50_000, "en"), (27, "\n" * 2000, "fr"),
             (28, prose(30_000), "en"), (29, "x y " * 500, "en")]
    rows += [(30 + k, base[0] + " " + prose(3), "en") for k in range(8)]          # near copies
    rows += [(40 + k, base[1], "en") for k in range(5)]                           # exact copies
    rows += [(50 + k, prose(60) + f"\n  {shared.upper()}\t\n" + prose(5) + "\n" + shared, "en") for k in range(5)]
    rows += [(5, base[5], "en"), (5, base[6] + " other", "en"), (None, base[7], "en"), (None, None, None)]
    return rows
