import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cpelink.llm import lengths as L
from cpelink.llm import packing as K
from cpelink.llm import tokens as T


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizers(reference, hard_texts):
    enc = T.encoder()
    texts = [t or "" for _, t, _ in hard_texts]
    texts += ["".join(map(chr, range(a, a + 200))) for a in range(0x21, 0xD000, 797)]
    texts += ["a" * 9000 + " b", " " * 9000 + "x", "\n" * 4000 + "é" * 4000, "don't we'll I'm 12345 3.14 ...?!", "😀🏽‍👩‍👧"]
    for t in texts:
        assert enc.ids(t).tolist() == reference(t)


def test_quick_rule_equals_the_vocabularys(reference):
    """White space of all kinds and lengths before letters, digits, marks and the end; contractions."""
    assert P.PATTERN == T._RULE
    rnd, enc = random.Random(2), T.encoder()
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "a", "Ü", "中", "1", "٣", ".", "'", "'s", "'ll", "'re", "'d", "'S", "_", "\u0301", "😀"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert enc.ids(t).tolist() == reference(t), repr(t)


def test_cuts_of_documents_laid_end_to_end():
    """As when each document is looked at alone."""
    enc, rnd, p = T.encoder(), random.Random(3), K.Packing(max_sentence=5)
    words = ["one", " two", ". ", ".", "\n", "!\n\n", " Three", '"', " x"]
    docs = [enc.ids("".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for _ in range(80)]
    whole = [np.append(d, np.uint32(K.END_ID)) for d in docs]
    pos, cost = K.cut_candidates(np.concatenate(whole), np.cumsum([len(d) for d in whole]), enc, p)
    got, at = dict(zip(pos.tolist(), cost.tolist())), 0
    assert len(got) == len(pos) and (np.diff(pos) > 0).all()
    want = {}
    for d in whole:
        body, stops = d[:-1], {}
        for k in range(len(body)):
            if enc.ends_line[body[k]] or (k + 1 < len(body) and enc.ends_sentence[body[k]] and enc.starts_space[body[k + 1]]):
                stops[k + 1] = p.sentence_cost
        bounds = [0, *sorted(stops), len(d)]
        for a, b in zip(bounds, bounds[1:]):
            stops |= {x: p.hard_cost for x in range(a + p.max_sentence, b, p.max_sentence)}
        stops[len(d)] = 0.0
        want |= {at + k: c for k, c in stops.items()}
        at += len(d)
    assert got == want


def test_added_tokens_inside_texts(reference, make_docs):
    eot, enc = "<|endoftext|>", T.encoder()
    texts = [f"end of one.{eot}Next", eot, eot * 3, f" {eot} ", f"a  {eot}  b\n\n{eot}\n", f"<|endoftext{eot}|>", f"{eot[:-1]} >",
             f"don't{eot}'s", "a" * 9000 + eot + "é" * 4000, f"{eot}" + " " * 4000 + f"x{eot}", eot.upper()]
    for t in texts:
        assert enc.ids(t).tolist() == reference(t)
    assert enc.ids(texts[0]).tolist() == [437, 286, 530, 13, 50256, 10019]
    docs = [(k, t, "en") for k, t in enumerate(texts)]
    check(K.pack(make_docs(docs).coalesce(1)).collect(), docs, reference)
    assert {r.length for r in L.token_histogram_report(make_docs(docs)).collect()} == {len(reference(t)) for t in texts}


def check(rows, docs, reference, p=K.Packing()):
    want = defaultdict(int)
    for i, t, _ in docs:
        want[(i, tuple(reference(t or "")) + (1,))] += 1
    pieces = sorted((r.sequence_id, r.offset) for r in rows)
    assert len(set(pieces)) == len(pieces)
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length > 0 and r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values(), default=0) <= p.size
    # ids of every document lie in exactly one piece: repeated ids are told apart by their checksums
    of = defaultdict(list)
    for r in rows:
        of[(r.doc_id, r.doc_tokens)].append(r)
    for (i, ids), n in want.items():
        mine = of[(i, len(ids))]
        at = 0
        while at < len(ids):
            x = next(r for r in mine if r.start == at
                     and r.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + r.length], "<u4").tobytes()))
            at += x.length
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    return used


def test_pack(make_docs, hard_texts, reference):
    rows = K.pack(make_docs(hard_texts).coalesce(2)).collect()
    used = check(rows, hard_texts, reference)
    pad = sum(2048 - n for n in used.values())
    assert pad < 0.05 * sum(used.values()) + 2 * 2048


def test_order_is_kept(make_docs, hard_texts):
    rows = K.pack(make_docs(hard_texts).coalesce(1)).collect()
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    seen = [x for k, x in enumerate(ids) if k == 0 or ids[k - 1] != x]
    assert seen == [x for k, x in enumerate(d[0] for d in hard_texts) if k == 0 or hard_texts[k - 1][0] != x]


def test_small_blocks_carry_on(make_docs, hard_texts, reference):
    p = K.Packing(size=64, block_windows=2, max_sentence=16)
    rows = K.pack(make_docs(hard_texts).coalesce(1), packing=p).collect()
    check(rows, hard_texts, reference, p)


def test_cuts_equal_quadratic_search():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        pos = np.unique(rnd.integers(1, 400, 60)).tolist()
        pos = [x for k, x in enumerate(pos) if k == 0 or x - pos[k - 1] <= 50]
        pos = [p for p in pos if p <= pos[0] + 10 ** 6]
        if pos[0] > 50 or any(b - a > 50 for a, b in zip(pos, pos[1:])):
            continue
        cost = rnd.choice([0.0, 4.0, 24.0], len(pos)).tolist()
        at, best = [0, *pos], [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + 50 - (at[j] - at[i]) + cost[j - 1] for i in range(j) if at[j] - at[i] <= 50))
        cuts = K.best_cuts(pos, cost, 50, True)
        total = sum(50 - (b - a) + cost[pos.index(b)] for a, b in zip([0, *cuts], cuts))
        assert abs(total - best[-1]) < 1e-9 and cuts[-1] == pos[-1]


def test_empty(make_docs):
    assert K.pack(make_docs([])).collect() == []
    rows = K.pack(make_docs([(None, None, "en"), (1, "", "en")]).coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in rows) == [(0, 1, 1), (1, 1, 1)]


def test_histogram(make_docs, hard_texts, reference):
    n = [len(reference(t or "")) for _, t, _ in hard_texts]
    sums = L.token_histogram_report(make_docs(hard_texts)).cache()
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(n) and any(x > L.BLOCK for x in n)
    for x, r in rows.items():
        assert r.n_docs == n.count(x) and r.docs_from == sum(y >= x for y in n)
        assert r.tokens_from == sum(y for y in n if y >= x) and r.truncated_total == sum(min(x, y) for y in n)
        assert abs(r.fit_share - sum(y <= x for y in n) / len(n)) < 1e-12
    for r in L.at_limits(sums, [0, 1, 10, 4096, 10 ** 6]).collect():
        assert r.truncated_total == sum(min(r["limit"], y) for y in n) and r.cut_docs == sum(y > r["limit"] for y in n)
    got = {r.share: r.length for r in L.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {q: next(x for x in sorted(n) if sum(y <= x for y in n) >= q * len(n)) for q in got}
    assert L.token_histogram_report(make_docs([])).collect() == []
