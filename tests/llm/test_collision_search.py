"""Scores are exact, recall against brute force is high, odd vectors are left out."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sentiforge.llm import collision_search as cs
from sentiforge.llm.collision_search import inner_products, nearest, op10_collision_search


def brute(rows, k=20):
    """{query: [(vec_id, score), ...]} by comparing with every row."""
    keys = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32)
    out = {}
    for i in np.flatnonzero(keys % 20 == 0):
        s = inner_products(x, x[i])
        best = [j for j in np.lexsort((keys, -s)) if keys[j] != keys[i]][:k]
        out[int(keys[i])] = [(int(keys[j]), float(s[j])) for j in best]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_recall_and_scores(spark):
    for sf in (SF_SMALL, "/root/testdata/sf0.1"):
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
        got, want = answers(op10_collision_search(spark, sf)), brute(rows)
        assert set(got) == set(want)
        vec = dict(rows)
        hits = 0
        for q, found in got.items():
            assert [f[0] for f in found] == list(range(1, 21))
            assert found == sorted(found, key=lambda f: (-f[2], f[1]))
            hits += len({f[1] for f in found} & {w[0] for w in want[q]})
            s = inner_products(np.array([vec[f[1]] for f in found], np.float32), np.array(vec[q], np.float32))
            assert s.tolist() == [f[2] for f in found]
        assert hits >= 0.95 * 20 * len(want)


def test_many_equal_vectors_of_any_length(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(200)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(100)]
    rows += [(300 + i, (rng.normal(size=3) * 5).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = answers(nearest(df, F.col("key") % 20 == 0)), brute(rows)
    assert {q: [f[1:] for f in v] for q, v in got.items()} == want  # few distinct vectors: all are verified


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []),
            (7, [1.0, 1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = answers(nearest(df, F.col("key") % 20 == 0))
    assert got == {0: [(1, 20, 0.0), (2, 8, -1.0)], 20: [(1, 8, 0.5), (2, 0, 0.0)]}
    assert nearest(df.limit(0), F.col("key") % 20 == 0).count() == 0


def recalled(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got, want = answers(nearest(df, F.col("key") % 20 == 0)), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({f[1] for f in got[q]} & {w[0] for w in want[q]}) for q in want)
    assert all([f[0] for f in v] == list(range(1, 21)) for v in got.values())
    return hits / (20 * len(want))


def test_recall_over_blocks_and_lengths(spark, monkeypatch):
    """Several blocks; equal lengths, log-normal lengths, tight clusters of unequal lengths."""
    monkeypatch.setattr(cs, "BLOCK", 1500)
    monkeypatch.setattr(cs, "PART", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = {"equal": x, "log-normal": x * rng.lognormal(0, .5, (6000, 1)), "wide": x * rng.lognormal(0, 1.2, (6000, 1)),
              "clusters": (x[rng.integers(0, 30, 6000)] + .15 * x) * rng.lognormal(0, .3, (6000, 1))}
    for name, t in tables.items():
        r = recalled(spark, [(i, v.tolist()) for i, v in enumerate(t)])
        print(name, r)
        assert r >= 0.95, (name, r)


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = dict(rows)
    for r in nearest(df, F.col("key") % 20 == 0).collect():
        a, b = x[r["query_id"]], x[r["vec_id"]]
        total = 0.0
        for p, q in zip(a, b):
            total += p * q
        assert r["score"] == total
