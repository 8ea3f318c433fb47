"""Ranked search: equal to a plain scoring of every document, in any number of rounds, blocks and passes."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sentiforge.llm import lexical_rank as R

LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, top):
    bags = [Counter(terms(t)) for _, t in docs]
    n_all = sum(bool(b) for b in bags)
    l_all = sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), b in zip(docs, bags):
            n, score = sum(b.values()), 0
            for t in terms(text):
                if t in b:
                    m = 75 + (25 * n * n_all) // l_all
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def corpus(seed, n, words=60):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(words)]
    p = 1 / np.arange(1, words + 1)
    p /= p.sum()
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(1, 40), p=p))) for i in range(n)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 12)))) for i in range(9)]
    return docs, items


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("shares,top", [((0.05, 0.1, 0.2), 3), ((1.0,), 5), ((1 / 16, 1 / 4, 1.0), 20)])
def test_equals_plain_scoring(spark, shares, top, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 2000)
    docs, items = corpus(3, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q, found = R.search_pass(df, items, top=top, shares=shares)
    got = sorted(((q.ids[r["item"]], r["rank"], r["doc"], r["low"]) for r in found.collect()), key=str)
    assert got == brute(docs, items, top)


def test_rounds_drop_what_cannot_win(spark):
    """Where some documents hold the whole item, most postings go unread."""
    docs, _ = corpus(5, 2000, words=400)
    items = [d for d in docs if len(d[1].split()) > 35][:9]
    docs += [(2000 + 3 * i + k, t + " extra" * k) for i, t in items for k in range(3)]
    q = R.Items.of([i for i, _ in items], [t for _, t in items])
    index = R.index_blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), q)
    rows = index.toArrow()
    counts, weight = R._weights(spark.createDataFrame(rows), q)
    q.weighted(weight)
    block = R._Block.first(q, rows.to_batches()[0], 0, *counts)
    total, read, tau = len(block.term), 0, np.zeros(len(items), np.int64)
    while block.prune(tau):
        before = len(block.term)
        block.read(1 / 16)
        read += before - len(block.term)
        for i in range(len(items)):
            low = np.sort(block.low[block.item == i])[::-1]
            tau[i] = low[2] if len(low) > 2 else 0
    assert read < total / 2, (read, total)


def test_odd_rows(spark):
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "!!! ..."),
            (5, "ÄÖ日本 gamma"), (6, "äö日本"), (7, "alpha " * 30000 + "beta"), (8, "x_y alpha@beta 12.5"), (9, "delta")]
    items = [(10, "alpha ALPHA beta"), (10, "äö日本 ÄÖ日本"), (11, None), (12, ""), (None, "x y 5"), (13, "unknownword")]
    df = spark.createDataFrame([(a, b, "q", 0) for a, b in docs], "doc_id long, text string, item_id string, rank int")
    it = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    for per_pass in (256, 2):
        assert collected(R.search(df, it, per_pass=per_pass)) == brute(docs, items, 20)


def test_ties_take_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(i, "other text") for i in range(100, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    it = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = R.search(df, it).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 21)) and len({r["score"] for r in got}) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert R.search(none, items).count() == 0
    assert R.search(docs, no_items).count() == 0
