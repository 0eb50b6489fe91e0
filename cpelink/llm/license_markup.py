"""License scans by template markup.

A template is plain wording with two kinds of marked regions, in the manner of
public license templates: ``<<beginOptional>> ... <<endOptional>>`` may be absent,
and ``<<var;max=N>>`` stands for up to N arbitrary words. Wording is compared as
words (digits, a-z, non-ASCII after lower-casing A-Z), so punctuation and white
space do not matter, but every mandatory word must be there in its place.

Each template compiles to a token automaton: a state per mandatory word, empty
moves over optional regions, and a bounded self-loop for replaceable ones. All
templates share one start table keyed by the first word, so a text is scanned
once and an automaton runs only where its first word stands.

Labels that end in ``-license`` stand for the whole wording of a license, from the
optional title and copyright line to the last word of the disclaimer; a text that
changes, adds or drops a mandatory word does not get them. All other labels stand
for a notice or for the opening words of a license (``mit-text``, ``gpl-text``) and
say nothing about what follows. Wording in quotation marks may have straight or
curly ones throughout.

Defined cases: a null or empty text has no words and no labels; repeated rows are
scanned each; overlapping places all count; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_ASCII).split()


# The phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_COPYRIGHT = ("<<beginOptional>>copyright <<var;max=30>> <<beginOptional>>all rights reserved<<endOptional>><<endOptional>> ")

# Whole wording of public licenses, marked up.
WHOLE = (
    ("mit-license", """<<beginOptional>>mit license <<beginOptional>>mit<<endOptional>><<endOptional>> """ + _COPYRIGHT + """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=8>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-license", """<<beginOptional>>bsd <<var;max=3>> license<<endOptional>> """ + _COPYRIGHT + """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
<<var;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
<<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>><<var;max=1>> All advertising materials mentioning features or use of this software must display the
following acknowledgement: This product includes software developed by <<var;max=16>><<endOptional>>
<<beginOptional>><<var;max=1>> Neither the name of <<var;max=12>> nor the names of <<beginOptional>>its<<endOptional>>
contributors may be used to endorse or promote products derived from this software without specific prior written
permission.<<endOptional>>
THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("isc-license", """<<beginOptional>>isc license<<endOptional>> """ + _COPYRIGHT + """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
)

# Notices and opening words, marked up, and the whole licenses with straight and with curly quotation marks.
TEMPLATES = (
    ("mit-notice", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> "
                   "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this "
                 "<<var;max=12>> to deal in the <<var;max=6>> without restriction"),
    ("apache-2-notice", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 "
                        "<<beginOptional>>0<<endOptional>>"),
    ("gpl-notice", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu "
                   "<<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license "
                   "<<beginOptional>>version <<var;max=1>><<endOptional>>"),
    ("gpl-text", "this <<var;max=4>> is free software you can redistribute it and or modify it under the terms of the "
                 "gnu <<beginOptional>>lesser<<endOptional>> general public license"),
    ("cc-by-notice", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
                     "<<beginOptional>>creative commons<<endOptional>> cc by <<beginOptional>>nc<<endOptional>> "
                     "<<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> "
                     "<<beginOptional>><<var;max=1>> 0<<endOptional>>"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided "
                   "that the following conditions are met"),
    ("isc-notice", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this <<var;max=6>> for "
                   "any purpose with or without fee is hereby granted"),
    ("mpl-notice", "subject to the terms of the mozilla public license v <<beginOptional>>2 0<<endOptional>>"),
    ("all-rights-reserved", "<<beginOptional>>copyright <<var;max=8>><<endOptional>> all rights reserved"),
    *WHOLE,
    *((label, re.sub('"([^"]*)"', r"“\1”", markup)) for label, markup in WHOLE),
)


@dataclass(frozen=True)
class Automaton:
    label: str
    #: Per state: the word that leads to the next state, and the states reachable without a word.
    literal: tuple[bytes | None, ...]
    empty: tuple[tuple[int, ...], ...]
    #: Per state: how many arbitrary words may be taken there to reach the next state.
    wild: tuple[int, ...]

    @property
    def final(self) -> int:
        return len(self.literal) - 1

    def closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """States with the arbitrary words already taken there, and all that empty moves reach."""
        todo, seen = list(states), set(states)
        while todo:
            s, used = todo.pop()
            for to in self.empty[s]:
                if (to, 0) not in seen:
                    seen.add((to, 0))
                    todo.append((to, 0))
        return seen

    def first_words(self) -> set[bytes]:
        return {self.literal[s] for s, _ in self.closure({(0, 0)}) if self.literal[s]}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run that begins at ``at``, or -1."""
        live, end = self.closure({(0, 0)}), -1
        for i in range(at, len(words) + 1):
            if (self.final, 0) in live:
                end = i
            if i == len(words):
                break
            step = set()
            for s, used in live:
                if self.literal[s] is not None and self.literal[s] == words[i]:
                    step.add((s + 1, 0))
                if used < self.wild[s]:
                    step.add((s, used + 1))
            if not step:
                break
            live = self.closure(step)
        return end


def compile_template(label: str, markup: str) -> Automaton:
    literal: list[bytes | None] = []
    empty: list[set[int]] = []
    wild: list[int] = []
    open_at: list[int] = []

    def state(word: bytes | None = None, most: int = 0) -> int:
        literal.append(word)
        empty.append(set())
        wild.append(most)
        return len(literal) - 1

    for part in re.split(r"(<<[^<>]*>>)", markup):
        if part == "<<beginOptional>>":
            open_at.append(state())
            empty[-1].add(len(literal))
        elif part == "<<endOptional>>":
            empty[open_at.pop()].add(len(literal))
        elif part.startswith("<<var"):
            at = state(None, int(re.search(r"max=(\d+)", part)[1]))
            empty[at].add(at + 1)
        else:
            for w in words_of(part):
                state(w)
    if open_at:
        raise ValueError(f"template {label!r} leaves an optional region open")
    state()
    return Automaton(label, tuple(literal), tuple(tuple(sorted(x)) for x in empty), tuple(wild))


@lru_cache(maxsize=4)
def compiled(base: tuple, templates: tuple) -> tuple[dict[bytes, list[Automaton]], dict[bytes, list[Automaton]]]:
    """Automata by first word: of the base phrases, and of the templates."""
    tables: tuple[dict, dict] = ({}, {})
    for table, listed in zip(tables, ([(label, phrase) for phrase, label in base], templates)):
        for label, markup in listed:
            a = compile_template(label, markup)
            for w in a.first_words():
                table.setdefault(w, []).append(a)
    return tables


def scan_words(words: list[bytes], base: tuple = BASE, templates: tuple = TEMPLATES) -> tuple:
    """(places of base phrases, base labels, all labels, words inside matched wording)."""
    first_base, first_more = compiled(base, templates)
    places, base_labels, labels, spans = [], set(), set(), []
    for i, w in enumerate(words):
        for a in first_base.get(w, ()):
            if (end := a.longest(words, i)) >= 0:
                places.append(i)
                base_labels.add(a.label)
                spans.append((i, end))
        for a in first_more.get(w, ()):
            if (end := a.longest(words, i)) >= 0:
                labels.add(a.label)
                spans.append((i, end))
    covered, reach = 0, 0
    for lo, hi in sorted(spans):
        covered += max(0, hi - max(lo, reach))
        reach = max(reach, hi)
    return places, base_labels, base_labels | labels, covered


SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE,
         templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: the base places, the labels found, and the share of words inside license wording."""
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                places, base_labels, labels, covered = scan_words(words, base, templates)
                rows.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                             ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                             covered / len(words) if words else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else
                                             [pa.array([], t) for t in kinds], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def license_report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id")
