import hashlib
import re

import pytest

from cpelink.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(item)
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def case(spark, make_docs, hard_texts):
    passage = "The quick-brown Fox, jumps over 13 lazy dogs and naps twice a day near Köln"
    items = [(1, passage), (2, passage + " again"), (10, "tiny item"), (3, None), (4, "  .,;"), (5, hard_texts[2][1]),
             (None, "an item whose id is missing but whose words are here all the same"), (10, "tiny item")]
    rows = hard_texts + [(100, "Before. " + passage.upper().replace("Ö", "ö") + " After", "en"),
                         (101, passage.replace(" ", "\n... "), "en"), (102, "a TINY, item! and a tiny itemised list", "en"),
                         (103, " ".join(passage.split()[:9]), "en"), (104, (passage + " ") * 40, "en"),
                         (105, "an item whose id is missing but whose words are here all the same", "en"),
                         (104, (passage + " ") * 40, "en")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    return make_docs(rows), bench, rows, items


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("max_set", [D.MAX_SET, 3])
def test_against_brute_force(case, monkeypatch, max_set):
    docs, bench, rows, items = case
    inner = D.find_hits
    monkeypatch.setattr(D, "find_hits", lambda *a, **k: inner(*a, **{"max_set": max_set, **k}))
    got = [tuple(r) for r in D.contamination_report(docs, bench).collect()]
    want = brute(rows, items)
    assert order(got) == order(want)
    assert sum(w[-1] for w in want) >= 6
    clean = D.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert order([(r.doc_id, r.text) for r in clean.collect()]) == order(
        [(r[0], r[1]) for r, w in zip(rows, want) if not w[-1]])


def test_empty_tables(spark, make_docs, hard_texts):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination_report(make_docs(hard_texts[:15]), none).collect()
    assert len(got) == 15 and not any(r.contaminated for r in got)
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert D.contamination_report(make_docs([]), some).collect() == []
