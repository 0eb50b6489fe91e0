import zlib

import numpy as np
import pytest

from cpelink.llm import language_id as L


def small_net(languages=3, p=L.LanguageId(hidden=3, span=7)):
    return {k: v.astype(float) for k, v in L.new_network(languages, p).items()}, p


def soft(x):
    return x / (1 + abs(x))


def direct(net, text, p):
    """Mean probabilities of one text, byte by byte from the equations."""
    total = np.zeros(len(net["b"]))
    for k in range(0, len(text), p.span):
        part = text[k:k + p.span]
        logits = [net["b"].copy() for _ in part]
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            h = np.zeros(p.hidden)
            for i in order:
                a, u = net["A"][:, d, part[i]], net["U"][:, d]
                z, r = ((1 + soft(a[g] + h @ u[g])) / 2 for g in (0, 1))
                c = soft(a[2] + r * (h @ u[2]))
                h = c + z * (h - c)
                logits[i] = logits[i] + h @ net["W"][d]
        for x in logits:
            total += np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return total / max(len(text), 1)


def test_batched_network_equals_the_equations():
    net, p = small_net()
    texts = [b"", b"a", b"seven b", b"a longer one of many spans", "Straße 中文".encode()]
    sizes = np.array(list(map(len, texts)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = L.document_probabilities(net, data, np.cumsum(sizes) - sizes, sizes, p)
    assert np.allclose(got, [direct(net, t, p) for t in texts], atol=1e-12)


def test_gradients_equal_differences():
    net, p = small_net()
    rng = np.random.default_rng(1)
    data = rng.integers(0, 5, 60).astype(np.uint8)
    starts, sizes, label = np.array([0, 7, 14, 30]), np.array([7, 7, 4, 1]), np.array([0, 2, 1, 1])
    laid = L.lay_out(data, starts, sizes, p.span)
    _, g = L.gradients(net, laid, sizes, label)
    for k in net:
        flat, mine = net[k].reshape(-1), g[k].reshape(-1)
        for i in [*rng.choice(len(flat), min(len(flat), 60), replace=False), int(np.abs(mine).argmax())]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = L.gradients(net, laid, sizes, label)[0]
            flat[i] = old - 1e-6
            down = L.gradients(net, laid, sizes, label)[0]
            flat[i] = old
            assert abs((up - down) / 2e-6 - mine[i]) < 1e-8


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.collect(), L.language_report(docs).collect()


def test_held_out_accuracy(predicted):
    docs, rows = predicted
    truth = {r.doc_id: r.lang for r in docs}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in held if truth[r.doc_id] == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.94 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_do_not_teach(spark, make_docs):
    """Labels of held-out rows, ids and sources change nothing."""
    docs = [(k, ("aba " if k % 2 else "xyx ") * 30, "a" if k % 2 else "x") for k in range(60)]
    out = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in docs}
    p = L.LanguageId(epochs=4)
    plain = L.language_report(make_docs(docs), p).collect()
    wrong = L.language_report(make_docs([(k, t, "z" if out[k] else lang) for k, t, lang in docs]), p).collect()
    assert sorted(plain) == sorted(wrong) and {r.lang_pred for r in plain} == {"a", "x"}
    assert all(r.lang_pred == ("a" if r.doc_id % 2 else "x") for r in plain)


def test_hard_rows(make_docs, hard_texts):
    rows = hard_texts + [(900, "1234 $$ 5", "en"), (901, "Δ", None)]
    got = L.language_report(make_docs(rows), L.LanguageId(epochs=1)).collect()
    assert len(got) == len(rows)
    none = [r.doc_id for r in got if r.lang_pred == "und"]
    want = [i for i, t, _ in rows if not (t and any(c.isalpha() for c in t))]
    assert sorted(none, key=str) == sorted(want, key=str) and 900 in none and 901 not in none
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    learned = {lang for i, t, lang in rows if lang and t and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)}
    assert {r.lang_pred for r in got} - {"und"} <= learned


def test_nothing_to_learn_from(make_docs):
    got = L.language_report(make_docs([(1, "some text", None), (2, None, "en")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert L.language_report(make_docs([])).collect() == []
