import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cpelink.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


HARD = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello <|im_end|>\n there"),
    (2, 0, "assistant", "first"), (2, 1, "user", "second"),
    (3, 0, "user", None), (3, 1, "assistant", ""), (3, 2, "user", "x" * 100_000), (3, 3, "assistant", "é😀\n\n"),
    (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"),
    (5, None, "tool<|im_start|>\n\\n", "odd role"), (5, 0, None, "no role"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "<<s>[\\INST]<\\\\|im_end|>\\"),
]


def test_report(spark):
    got = {r.conv_id: r for r in C.chat_report(table(spark, ROWS)).collect()}
    rows = ROWS + [(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)]
    assert set(got) == {r[0] for r in rows}
    for conv, g in got.items():
        turns = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(turns), digest("".join(f"{x[2]}\n{x[3]}\n" for x in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(learnt), digest(learnt))
    assert got[1].valid and got[3].valid and got[-1].valid and got[None].valid
    assert (got[2].valid, got[2].bad_turn) == (False, 0) and (got[4].valid, got[4].bad_turn) == (False, 1)


def test_controls_stand_only_in_marks(spark):
    made = {r.conv_id: r for r in C.format_conversations(table(spark, ROWS).select("conv_id", "turn", "role", "text")).collect()}
    for conv, r in made.items():
        turns = sum(x[0] == conv for x in ROWS)
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == turns
        assert not any(c in r.formatted for c in C.CHATML.controls[2:])


@pytest.fixture(scope="module")
def parts():
    pieces = list("<[\\/|>]sIN \n") + ["<s>", "[INST]", "<|im_end|>", "[\\/INST]", "<\\", "SYS>>", "im_start|>"]
    return st.lists(st.sampled_from(pieces), max_size=20).map("".join)


def test_escape_round_trip(spark, parts):
    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(parts, min_size=40, max_size=80))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"),
                           C._unescape_role(C._escape_role(F.col("t"), C.CHATML), C.CHATML).alias("r"),
                           C._escape_role(F.col("t"), C.CHATML).alias("er")).collect():
            assert r.u == r.t and r.r == r.t and "\n" not in r.er
            assert not any(c in r.e for c in C.CHATML.controls)
    check()


def test_empty_table_and_bad_template(spark):
    assert [r.conv_id for r in C.chat_report(table(spark, [])).collect()] == [-1]
    with pytest.raises(ValueError):
        C.Template(controls=("<a<", "<b>"))
