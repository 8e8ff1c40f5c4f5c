"""Ranked search against a plain definition, and what its index skips."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tidewatch.llm import lexical_search as ls


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_ranks(docs, queries, best=50):
    words = [(d, terms_of(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    items = {}
    for item, text in queries:
        items.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in items.items():
        found = []
        for d, w in words:
            if w:
                m = 50 + 50 * len(w) * n_docs // n_terms
                score = 0
                for x in terms & set(w):
                    tf = w.count(x)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def corpus(n=400):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ñu", "x1"]
    docs = [(k * 7 % 1009, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60)))) for k in range(n)]
    docs += [(5, docs[3][1]), (5, docs[3][1]), (None, docs[4][1]), (None, None), (2000, None), (2001, " \n,.;"), (2002, "W1 w1-W1_w59 É É" + " w59" * 20_000)]
    queries = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(25)] + [(3, "w59 É"), (None, "x1"), (None, "w7"), (90, None), (91, ""), (92, "absent"), (93, "w0"), (94, docs[4][1])]
    return docs, queries


@pytest.mark.parametrize("small", [False, True])
def test_ranks_by_definition(spark, monkeypatch, small):
    docs, queries = corpus()
    pass_terms = ls.PASS_TERMS
    if small:  # many lots and passes, short blocks
        pass_terms = 60
        ls_small = {"LOT_BYTES": 3000, "BLOCK_POSTINGS": 4, "WAVE_SPANS": 3, "TASK_LOTS": 3}
        for name, value in ls_small.items():
            monkeypatch.setattr(ls, name, value)
    d = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], "doc_id long, text string, term string, lot int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, "a") for i, t in queries], "item_id long, text string, doc_id string")
    got = ls.rank_documents(d, q, 7, pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranks(docs, queries, 7)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert ls.rank_documents(d.limit(0), q).count() == 0
    assert ls.rank_documents(d, q.limit(0)).count() == 0
    assert ls.rank_documents(d, q).count() == 1


def lot_of(docs):
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    rows = ls.lot_rows(0, [i for i, _ in docs], [w for _, w in docs], n_docs, n_terms)
    head, terms = rows[0], {r[1]: r[2:] for r in rows[1:]}
    return ls.Lot(np.frombuffer(head[3], "<i8"), np.frombuffer(head[4], np.uint8), np.frombuffer(head[6], "<i8"), terms)


def test_blocks_hold_their_postings():
    rng = random.Random(2)
    docs = [(k, [b"a"] * (k % 300 == 0) * (300 if k else 70_000) + [b"b"] + [b"c"] * rng.randint(0, 2)) for k in range(1000)]
    lot = lot_of(docs)
    for term in (b"a", b"b", b"c"):
        p = lot.of(term)
        got = [tuple(map(int, x)) for k in range(len(p.last)) for x in zip(*p.block(k), strict=True)]
        want = [(k, int(ls.impact(np.int64(w.count(term)), lot.m[k]))) for k, (_, w) in enumerate(docs) if term in w]
        assert got == want
        assert all(int(p.block(k)[1].max()) == p.high[k] and int(p.block(k)[0][-1]) == p.last[k] for k in range(len(p.last)))


def test_blocks_below_the_threshold_stay_packed():
    """A query whose best documents lie together unpacks few blocks, with the same result."""
    docs = [(k, [b"rare", b"common"] if 9000 <= k < 9060 else [b"common"] + [b"other"] * 9) for k in range(20_000)]
    lot = lot_of(docs)
    best = ls.Best(50)
    best.add(np.full(50, 10**9), np.zeros(50, bool), np.arange(50) - 50)
    lot.search([(b"rare", 5000), (b"common", 3)], best)
    assert best.doc.tolist() == list(range(9000, 9050))
    assert lot.unpacked <= 4 and lot.scored < 400
    every = ls.Best(50)
    lot_of(docs).search([(b"rare", 5000), (b"common", 3)], every)
    assert every.doc.tolist() == best.doc.tolist() and every.score.tolist() == best.score.tolist()
