import hashlib
from collections import defaultdict

from cpelink.llm import linededup as L

WS = " \t\n\x0b\x0c\r"
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    ident = lambda i: -2 ** 63 if i is None else i
    key = lambda x: x.strip(WS).translate(LOW)
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(ident(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != ident(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_report_and_texts(make_docs, hard_texts):
    docs = make_docs(hard_texts)
    want = brute(hard_texts)
    got = [tuple(r) for r in L.line_dedup_report(docs).collect()]
    assert order(got) == order([(*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want])
    full = L.drop_lines(docs)
    assert full.select("row.*").columns == docs.columns
    assert order([(r.row.doc_id, r.row.text) for r in full.collect()]) == order([(w[0], w[3]) for w in want])
    assert sum(w[2] for w in want) > 0


def test_threshold_edges(make_docs):
    line = "exactly twenty chars"
    assert len(line) == 20
    rows = [(1, line, "en"), (2, line + "\n" + line, "en"), (3, "a\n" + line.upper() + " ", "en"), (4, line[:-1], "en"),
            (5, line[:-1], "en"), (6, line[:-1], "en"), (7, "two documents only here", "en"),
            (8, "two documents only here", "en"), (8, "two documents only here", "en")]
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in L.line_dedup_report(make_docs(rows)).collect()}
    assert got == {(1, 1, 1), (2, 2, 2), (3, 2, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0), (8, 1, 0)}


def test_empty_table(make_docs):
    assert L.line_dedup_report(make_docs([])).collect() == []
