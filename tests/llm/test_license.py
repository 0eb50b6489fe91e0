import re

import pytest

from cpelink.llm import license_markup as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(t):
    w = WORD.findall((t or "").translate(LOW))
    at = [(i, label) for phrase, label in M.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "under the mit license under the MIT license; Apache license version 2 cc-by-nc CC BY NC", "under the MIT",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
    "Copyright (c) 2020 Some Body. All Rights Reserved!", "under the under the mit license", None, "", "É ß 😀 123",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this " + "very " * 13
    + "to deal in the Software without restriction",
    "x " * 100_000 + "cc by nc",
]


def test_base_columns(make_docs, hard_texts):
    rows = hard_texts + [(500 + k, t, "en") for k, t in enumerate(TEXTS)] + [(500, TEXTS[0], "en")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in
           M.license_report(make_docs(rows)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([(i, *brute(t)) for i, t, _ in rows], key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and set(r.base_labels.split(",")) - {""}
               <= set(r.labels.split(",")) for r in M.license_report(make_docs(rows)).collect())
    assert M.license_report(make_docs([])).collect() == []


def labels(text, templates=M.TEMPLATES):
    return M.scan_words(M.words_of(text), (), templates)[2]


def test_templates():
    found = [labels(t) for t in TEXTS]
    assert found[0] == {"mit-notice"} and found[1] == {"apache-2-notice"} and found[2] == {"cc-by-notice"}
    assert found[5] == {"gpl-notice"} and found[6] == found[7] == {"all-rights-reserved"}
    assert found[12] == {"mit-text"} and found[13] == set()  # 13 words do not fit a region of 12


MIT = """The MIT License (MIT)

Copyright (c) 2020-2024 Some Body <some@body.example>
Copyright (c) 2025 Other Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """ISC License

Copyright (c) 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


@pytest.mark.parametrize("label, text", [("mit-license", MIT), ("bsd-license", BSD), ("isc-license", ISC)])
def test_whole_wording_of_licenses(label, text):
    whole = lambda t: {x for x in labels(t) if x.endswith("-license")}
    curly = re.sub('"([^"]*)"', r"“\1”", text)
    two_clauses = re.sub(r"3\. Neither.*?permission\.", "", text, flags=re.S)
    bare = text[text.index("Permission is" if label[0] == "m" else "Redistribution and" if label[0] == "b" else "Permission to"):]
    for t in (text, curly, two_clauses, bare, "Before. " + text + " After.", text.replace("Some Body", "Ann, Bob and Eve")):
        assert whole(t) == {label}
    n = len(M.words_of(text))
    assert M.scan_words(M.words_of(text))[3] >= n - 1  # "The" of a title is not part of the wording
    last, words = text.rstrip().rindex("\n\n"), ("EVENT", "LIABLE", "SOFTWARE")
    for w in words:
        at = text.index(w, last)
        assert whole(text[:at] + "OTHER" + text[at + len(w):]) == set()
    assert whole(text[:last]) == set()
    for w in ("hereby granted", "are permitted"):
        assert whole(text.replace(w, w + " on weekdays")) == (set() if w in text else {label})


def expand(markup):
    """Every wording of a small template, replaceable regions filled with 0 to max words ``z``."""
    parts = re.split(r"(<<[^<>]*>>)", markup)

    def read(k, depth):
        outs = [[]]
        while k < len(parts):
            p = parts[k]
            if p == "<<beginOptional>>":
                inner, k = read(k + 1, depth + 1)
                outs = [a + b for a in outs for b in [[], *inner]]
            elif p == "<<endOptional>>":
                return outs, k
            elif p.startswith("<<var"):
                most = int(re.search(r"max=(\d+)", p)[1])
                outs = [a + ["z"] * n for a in outs for n in range(most + 1)]
            else:
                outs = [a + p.split() for a in outs]
            k += 1
        return outs, k
    return {tuple(x) for x in read(0, 0)[0]}


@pytest.mark.parametrize("markup", ["a <<beginOptional>>b<<endOptional>> c", "<<beginOptional>>a<<endOptional>> b",
                                    "a <<var;max=2>> b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>>",
                                    "a <<beginOptional>>b <<var;max=1>><<endOptional>> c"])
def test_automaton_accepts_the_expansions(markup):
    import itertools
    a, wanted = M.compile_template("x", markup), expand(markup)
    for n in range(1, 6):
        for w in itertools.product("abcdz", repeat=n):
            runs = [k for k in range(1, n + 1) if tuple(
                "z" if False else x for x in w[:k]) in wanted or any(
                len(o) == k and all(p == q or p == "z" for p, q in zip(o, w[:k])) for o in wanted)]
            assert a.longest([x.encode() for x in w], 0) == max(runs, default=-1)


def test_bad_template():
    with pytest.raises(ValueError):
        M.compile_template("x", "a <<beginOptional>>b")
