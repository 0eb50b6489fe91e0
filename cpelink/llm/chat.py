"""Chat formatting by a declarative template.

A template names the marks of a turn, the roles under loss, the control strings
that texts must not contain, and a finite-state machine over roles. Conversations
are gathered turn by turn in order; the machine runs over the roles and reports
the first turn that it does not accept; the output is a list of text segments,
each with its loss flag, whose concatenation is the formatted conversation.

Control strings inside texts and roles get a backslash after their first
character, and so does the form that already has backslashes there, so that the
escape is reversible and the formatted string holds no control string but the
template's own marks.

Defined cases: null texts and roles are empty strings; turns are ordered by
(turn, role, text) with null first, so ties are settled; repeated turns stay;
a null conversation id is a conversation; conversations that the machine rejects
are formatted too, with ``valid`` false; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcols import let


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that must not appear in a text as they are.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
                                 "<<SYS>>", "<</SYS>>")
    #: (state, role) -> state; any other pair is rejected.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for c in self.controls:
            for tail in (c[k:] for k in range(1, len(c))):
                if any(tail.startswith(d) or d.startswith(tail) for d in self.controls):
                    raise ValueError(f"control string {c!r} overlaps another one")

    def heads(self) -> dict[str, str]:
        """First character -> pattern of what follows it in the control strings that it begins."""
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        return {re.escape(k): "|".join(sorted(v)) for k, v in rests.items()}


CHATML = Template()


def escape(text: Column, t: Template = CHATML) -> Column:
    pattern = "|".join(rf"(?<={k})(?=\\*(?:{v}))" for k, v in t.heads().items())
    return F.regexp_replace(text, pattern, r"\\")


def unescape(text: Column, t: Template = CHATML) -> Column:
    pattern = "|".join(rf"(?<={k})\\(?=\\*(?:{v}))" for k, v in t.heads().items())
    return F.regexp_replace(text, pattern, "")


def _escape_role(role: Column, t: Template) -> Column:
    """Also keeps the line feed that ends a role out of it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), t)


def _unescape_role(role: Column, t: Template) -> Column:
    lines = F.regexp_replace(unescape(role, t), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def _machine(turns: Column, t: Template) -> Column:
    """struct(state, at, bad): the state after the last accepted turn and the first rejected turn, from 0."""
    moves = F.create_map(*[x for (s, r), to in sorted(t.moves.items()) for x in (F.lit(f"{s}\t{r}"), F.lit(to))])

    def step(a: Column, x: Column) -> Column:
        to = F.element_at(moves, F.concat(a["state"], F.lit("\t"), x["role"]))
        return F.struct(F.coalesce(F.when(a["bad"] < 0, to), a["state"]).alias("state"), (a["at"] + 1).alias("at"),
                        F.when(a["bad"] >= 0, a["bad"]).when(to.isNull(), a["at"]).otherwise(-1).alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, begin, step)


def format_conversations(turns: DataFrame, t: Template = CHATML) -> DataFrame:
    """(conv_id, segments, formatted, valid, bad_turn): one row per conversation.

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``.
    """
    rows = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.begin), _escape_role(x["role"], t), F.lit(t.after_role))
        return F.array(segment(head, F.lit(False)),
                       segment(escape(x["text"], t), x["role"].isin(list(t.loss_roles))),
                       segment(F.lit(t.end), F.lit(False)))

    made = gathered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"),
                           _machine(F.col("turns"), t).alias("m"))
    return made.select(
        "conv_id", "segments", F.array_join("segments.text", "").alias("formatted"),
        ((F.col("m.bad") < 0) & F.col("m.state").isin(list(t.accepting))).alias("valid"),
        F.when(F.col("m.bad") >= 0, F.col("m.bad")).alias("bad_turn"))


def parse_conversations(formatted: Column, t: Template = CHATML) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, re.escape(t.end), -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(t.begin) + 1))
        cut = F.instr(body, t.after_role)
        return F.struct(_unescape_role(F.substr(body, F.lit(1), cut - 1), t).alias("role"),
                        unescape(F.substr(body, cut + len(t.after_role)), t).alias("text"))

    return F.transform(pieces, lambda p: let(p, turn))


def chat_report(conversations: DataFrame, t: Template = CHATML) -> DataFrame:
    """Digests of all conversations and of one (-1) whose texts are made of control strings, read back."""
    spark = conversations.sparkSession
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(hard), t)
    back = made.select("conv_id", "formatted", "valid", "bad_turn", parse_conversations(F.col("formatted"), t).alias("turns"),
                       F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                                lambda s: unescape(s["text"], t)), "").alias("learnt"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


ORACLE = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM raw
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
                 WHEN before = 'system' THEN role = 'user'
                 WHEN before = 'user' THEN role = 'assistant'
                 WHEN before = 'assistant' THEN role = 'user' ELSE false END AS ok,
    regexp_replace(regexp_replace(text,
      '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>))', '\1\\\2', 'g'),
      '(\[)(\\*(?:INST\]|/INST\]))', '\1\\\2', 'g') AS safe FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(safe) + 11)::BIGINT AS formatted_chars,
  (bool_and(ok) AND arg_max(role, k) = 'assistant') AS valid,
  (min(k) FILTER (NOT ok) - 1)::INTEGER AS bad_turn
FROM marked GROUP BY conv_id
"""
