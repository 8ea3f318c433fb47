"""Components and link counts against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from sentiforge.llm import ngram_join as nj
from sentiforge.llm.words import find_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(ws[i:i + 3]) for i in range(len(ws) - 2)) if len(ws) >= 3 else frozenset([tuple(ws)] if ws else [])


def brute(rows, percent=90):
    """{key: (component, {n_shingles})} and the number of links per set."""
    sets = [plain_set(t) for _, t in rows]
    keys = [k for k, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(i, j):
        parent[find(i)] = find(j)

    links = {s: set() for s in sets}
    for i in range(len(rows)):
        for j in range(i):
            if keys[i] is None or keys[j] is None or not sets[i] or not sets[j]:
                continue
            inter = len(sets[i] & sets[j])
            if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                join(i, j)
                if sets[i] != sets[j]:
                    links[sets[i]].add(sets[j])
                    links[sets[j]].add(sets[i])
            elif keys[i] == keys[j]:
                join(i, j)
    comp = {}
    for i, k in enumerate(keys):
        if k is not None and sets[i]:
            comp.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        c = min(comp[find(i)]) if k is not None and sets[i] else k
        out.append((k, len(sets[i]), c))
    return sorted(out, key=repr), links


def check(spark, rows, tie=True, percent=90):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n string")
    got = nj.similar_texts(docs, tie=tie, percent=percent).collect()
    want, links = brute(rows, percent)
    assert sorted(((r["key"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    if len({k for k, _ in rows}) == len(rows):
        by = {k: len(links[plain_set(t)]) for k, t in rows if k is not None}
        assert {r["key"]: r["n_links"] for r in got if r["key"] is not None} == by


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i:i + 1] = rng.choice([[], ["new%d" % rng.randrange(50)], [w[i], "x%d" % rng.randrange(50)]])
    return " ".join(w)


@pytest.mark.parametrize("seed, tie, percent", [(1, True, 90), (2, False, 90), (3, False, 80)])
def test_near_copies(spark, seed, tie, percent, monkeypatch):
    rng = random.Random(seed)
    rows = []
    for size in (3, 9, 10, 11, 14, 30, 60, 61, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            rows.append((rng.randrange(10**9), edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, size // 30]))))
    rng.shuffle(rows)
    monkeypatch.setattr(nj, "BLOCK", 9000)  # many blocks to a cluster
    check(spark, rows, tie, percent)


def test_odd_rows(spark):
    rows = [(7, None), (8, ""), (9, " \n"), (1, "one"), (2, "ONE"), (3, "one two"), (4, "One  Two"), (5, "two one"),
            (None, "one"), (6, "a b c " * 4000), (10, "a b c " * 4001), (11, "É b c"), (12, "é b c"), (6, "a b c " * 4000),
            (20, "p q r s t"), (20, "u v w x y"), (21, "u v w x y"), (19, "p q r s t")]
    check(spark, rows)
    check(spark, rows, tie=False)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.similar_texts(empty).count() == 0


def test_guarantee_of_signatures():
    """Any two sets at the threshold share a signature, at every size."""
    rng = random.Random(5)
    for size in [*range(9, 60), 100, 333, 1000]:
        base = [f"w{i}" for i in range(size)]
        far = (2 * size * 10 + 9) // 190 + 2
        for _ in range(6):
            other = [x for x in base if rng.random() > rng.random() * 0.1] + [f"y{i}" for i in range(rng.randrange(far))]
            a, b = set(base), set(other)
            if 100 * len(a & b) < 90 * len(a | b):
                continue
            w = find_words(pa.array([" ".join(base), " ".join(other)]))
            doc, sig = nj.signatures(w.doc, w.hash, 2)  # each word is an element
            if a != b:
                assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), size


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = nj.op3_ngram_join(spark, SF_SMALL).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_rows_of_one_id_are_judged_by_their_text(spark):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c = text(), text(), text()
    near = "changed " + b.split(" ", 1)[1]
    hot = [text() for _ in range(30)]
    rows = [(19, a), (20, a), (20, b), (20, c), (20, c), (21, b), (22, near), (23, c), (24, text()),
            (None, a), (None, a), (30, ""), (30, ""), (30, None), (31, "")]
    rows += [(7, t) for t in hot] + [(40, hot[3]), (6, hot[5])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    got = stage(spark, docs, "")
    want = [(19, a), (20, b), (20, c), rows[8], (None, a), (None, a), (30, ""), (30, None), (31, ""), (6, hot[5])]
    want += [(7, t) for t in hot if t != hot[5]]
    assert got.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("tie", [True, False])
def test_a_copy_without_a_key_comes_first(spark, tie):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (5, base), (None, base), (6, base + " more"), (None, "one two"), (None, "x " + base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = nj.similar_texts(docs, tie=tie).collect()
    assert {r["key"]: r["component_id"] for r in got} == {5: 5, 6: 5, None: None}
    nobody = docs.where("doc_id IS NULL")
    assert nj.similar_texts(nobody, tie=tie).where("component_id IS NULL").count() == 4
