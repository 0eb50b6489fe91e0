import random
import re

import numpy as np
import pytest

from cpelink.llm import superminhash as S
from cpelink.llm.components import connected_components

LOW = {c: c + 32 for c in range(65, 91)}


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    sets = [shingles(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    key = lambda i: -2 ** 63 if i is None else i
    for x, (i, *_) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), 2 ** 63), key(i))
    return [(i, len(sets[x]), None if (c := least[root(x)]) == -2 ** 63 else c, key(i) == c)
            for x, (i, *_) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def chains(hard_texts):
    """Besides the hard texts: chains whose ends are far apart, and a group around one centre with outliers."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwz") for _ in range(6))
    rows, at = list(hard_texts), 200
    for _ in range(4):
        w = [word() for _ in range(80)]
        for _ in range(9):
            rows.append((at, " ".join(w), "en"))
            at += 1
            for p in rnd.sample(range(80), 4):
                w[p] = word()
    core = [word() for _ in range(60)]
    for edits in [0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12] * 3:
        w = list(core)
        for p in rnd.sample(range(60), edits):
            w[p] = word()
        rows.append((at, " ".join(w), "en"))
        at += 1
    rows += [(at + k, t, "en") for k, t in enumerate(["a b c d e", "a b c d", "A B  C D E", "a b", "a", "a", "b a"])]
    return rows


@pytest.mark.parametrize("k, rare", [(2, 16), (5, 16), (2, 1)])
def test_against_brute_force(make_docs, chains, k, rare):
    docs, p = make_docs(chains), S.NearDup(words=k, rare=rare)
    want = brute(chains, k)
    got = [tuple(r) for r in S.near_dup_report(docs, p).collect()]
    assert order(got) == order(want)
    assert sum(not w[3] for w in want) > 20
    kept = S.drop_near_duplicates(docs, p=p)
    assert kept.columns == docs.columns
    assert order([(r.doc_id, r.text) for r in kept.collect()]) == order(
        [(r[0], r[1]) for r, w in zip(chains, want) if w[3]])


@pytest.mark.parametrize("edits", [(8, 14), (2, 14)])
def test_one_large_group_of_near_copies(make_docs, monkeypatch, edits):
    """Copies of one text with many edits each: few pairs are left to compare, no link is lost."""
    rnd, sent = random.Random(11), {}
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for k in range(500):
        w = list(base)
        for at in rnd.sample(range(200), rnd.randint(*edits)):
            w[at] = word()
        rows.append((k, " ".join(w), "en"))
    real = S.materialize

    def counted(df, name="stage", *more):
        out = real(df, name, *more)
        if name == "cross_pairs":
            sent[name] = out.count()
        return out

    monkeypatch.setattr(S, "materialize", counted)
    got = [tuple(r) for r in S.near_dup_report(make_docs(rows), S.NearDup(words=2)).collect()]
    assert order(got) == order(brute(rows, 2))
    assert sent["cross_pairs"] <= 4 * len(rows)


def test_empty_table(make_docs):
    assert S.near_dup_report(make_docs([])).collect() == []
    blank = S.near_dup_report(make_docs([(1, None, "en"), (2, "", "en"), (2, " ", "en")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in blank) == [
        (1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(5)
    m, errors = 200, []
    for n, shared in ((300, 240), (40, 30), (1000, 200), (3, 2), (1, 1)):
        for _ in range(20):
            a = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
            b = np.concatenate([a[:shared], rnd.integers(0, 2 ** 63, n - shared).astype(np.uint64)])
            sig = S.signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2, m)
            errors.append((sig[0] == sig[1]).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signature_equals_the_definition():
    """Level by level with early stopping gives the plain minimum over all ranks."""
    rnd = np.random.default_rng(9)
    m = 16
    for n in (1, 2, 7, 60):
        values = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
        alone = np.stack([S.signatures(values[i:i + 1], np.zeros(1, np.int64), 1, m)[0] for i in range(n)])
        assert (S.signatures(values, np.zeros(n, np.int64), 1, m)[0] == alone.min(axis=0)).all()
        ranks = np.sort(alone >> np.uint64(48), axis=1)
        assert (ranks == np.arange(m)).all()  # each shingle ranks the components by a permutation


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] \
        + [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(150)] + [(5, 5), (1000, 1001)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    import sys
    sys.setrecursionlimit(10_000)
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for a, b in pairs for x in (a, b) if a != b}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bits_tell_links_from_shared_passages():
    """Two bits a component: pairs at the limit stay under it, pairs at half similarity mostly do not."""
    p, rnd = S.NearDup(), np.random.default_rng(4)
    m = p.bands * p.rows
    near, far = [], []
    for n in (4, 40, 400, 1500):
        for out, similarity in ((near, 0.8), (far, 0.4)):
            for _ in range(30):
                both = int(round(2 * n * similarity / (1 + similarity)))
                a = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
                b = np.concatenate([a[:both], rnd.integers(0, 2 ** 63, n - both).astype(np.uint64)])
                sig = S.signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2, m) & np.uint64(3)
                out.append(int((sig[0] != sig[1]).sum()))
    assert max(near) <= p.most_unlike and np.mean(np.array(far) > p.most_unlike) > 0.9
