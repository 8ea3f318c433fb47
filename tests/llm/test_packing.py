"""Packing: the plan is a valid packing, close to the bound, and equal for any counts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentiforge.llm.packing import best_fit_plan, cut_pieces, place_pieces, sequences

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def expand(counts, capacity):
    """Every piece's (bin, offset, length), from the plan."""
    plan, bins = best_fit_plan(counts, capacity)
    out = []
    for s, c in counts.items():
        rows = plan[plan[:, 0] == s]
        for r in range(c):
            _, r0, b0, per, off = rows[np.searchsorted(rows[:, 1], r, side="right") - 1]
            k = r - r0
            out.append((b0 + k // per, off + k % per * s, s))
    return out, bins


def plain_best_fit(counts, capacity):
    """Number of bins of best-fit decreasing, one piece at a time."""
    gaps = []
    for s in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_is_a_packing(counts):
    placed, bins = expand(counts, 40)
    by = {}
    for b, off, s in placed:
        by.setdefault(b, []).append((off, s))
    assert sorted(by) == list(range(bins))
    for items in by.values():
        at = 0
        for off, s in sorted(items):
            assert off == at
            at += s
        assert at <= 40
    total = sum(s * c for s, c in counts.items())
    assert bins >= -(-total // 40)
    assert bins <= plain_best_fit(counts, 40) * 1.1 + 1


def test_third_of_all_pieces_alike():
    placed, bins = expand({7: 100000, 4096: 3, 1500: 10}, 4096)
    assert bins == 3 + 5 + -(-(100000 - 5 * 156) // 585)


def test_pieces_of_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world " * 3000, "y"), (3, "a b", "y"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    placed = place_pieces(cut_pieces(docs, VOCAB))
    got = placed.select("key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    tok = Tokenizer.from_file(VOCAB)
    expect = []
    for k, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            x = np.array(ids[p:p + 4096], dtype="<u4")
            expect.append((k, p // 4096, p, len(x), zlib.crc32(x.tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, expect))
    packed = sequences(placed).collect()
    assert sum(r["length"] for r in packed) == sum(e[3] for e in expect)
    assert all(len(r["ids"]) == 2 * r["length"] <= 2 * 4096 for r in packed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert place_pieces(cut_pieces(docs, VOCAB)).count() == 0
