"""Latent estimates and joints against NumPy; exact order of near ties."""

import numpy as np
import pytest

from sentiforge.operators import noise as N
from sentiforge.operators.ordering import range_index
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(6)
    label = rng.integers(0, 3, 400)
    p = rng.random((400, 3)) + 1.2 * np.eye(3)[np.where(rng.random(400) < .7, label, rng.integers(0, 3, 400))]
    return label, p / p.sum(1, keepdims=True)


def frame(spark, scored):
    return spark.createDataFrame([(i, int(y), [float(v) for v in p]) for i, (y, p) in enumerate(zip(*scored))],
                                 "uid long, label int, p array<double>").repartition(3)


def counts(label, p):
    t = np.array([p[label == j, j].mean() for j in range(3)])
    c = np.zeros((3, 3))
    for y, row in zip(label, p):
        ok = np.where(row >= t, row, -1)
        if ok.max() >= 0:
            c[y, ok.argmax()] += 1
    return c


def matrix(df, col):
    m = np.zeros((3, 3))
    for r in df.collect():
        m[r["given_label"], r["true_label"]] = r[col]
    return m


def test_converged_estimates_agree(spark, scored):
    label, p = scored
    c, ps = counts(label, p), np.bincount(label, minlength=3) / len(label)
    nm, inv = c / c.sum(0), c / c.sum(1, keepdims=True)
    py = ps @ inv
    raw = N.latent_from_counts(frame(spark, scored), 3)
    assert np.allclose(matrix(raw, "noise_rate"), nm) and np.allclose(matrix(raw, "inv_noise_rate"), inv)
    for _ in range(100_000):
        inv = nm * py / (nm * py).sum(1, keepdims=True)
        py, old = ps @ inv, py
        if abs(py - old).max() < 1e-12:
            break
    got = N.latent_from_counts(frame(spark, scored), 3, converge=True, rounds=100_000)
    m, back = matrix(got, "noise_rate"), matrix(got, "inv_noise_rate")
    prior = np.array([{r["true_label"]: r["py_true"] for r in got.collect()}[y] for y in range(3)])
    assert np.allclose(prior, py, atol=1e-6) and np.allclose(m.sum(0), 1)
    assert np.allclose(m @ prior, ps)                                   # prior, noise matrix and labels agree
    assert np.allclose(back, m * prior / (m @ prior)[:, None])          # and so does the inverse


def test_joint_from_given_matrices(spark, scored):
    label, _ = scored
    n = np.bincount(label, minlength=3)
    noise = np.array([[.8, .1, 0], [.1, .9, .3], [.1, 0, .7]])
    py = np.maximum(np.linalg.solve(noise, n / n.sum()), 0)
    inv = noise * py / (noise * py).sum(1, keepdims=True)
    df = frame(spark, scored)
    cal = lambda row: np.array([[row[f"cal{s}_{y}"] for y in range(3)] for s in range(3)])
    assert np.allclose(cal(N.joint_from_matrices(df, 3, noise.tolist()).first()), inv * n[:, None])
    other = np.full((3, 3), 1 / 3)
    assert np.allclose(cal(N.joint_from_matrices(df, 3, noise.tolist(), other.tolist()).first()), other * n[:, None])
    with pytest.raises(ValueError):
        N.joint_from_matrices(df, 3)


def test_near_ties_are_ordered_exactly(spark):
    """Margins that differ by less than 2^-47 still fall in their own order."""
    base = 0.25
    rows = [(i, 0, [base + k * 2.0 ** -53, 0.75 - base]) for i, k in enumerate([5, 1, 4, 2, 3])]
    df = spark.createDataFrame(rows, "uid long, label int, p array<double>")
    joint = spark.createDataFrame([(5, 5, 0, 0.0, 3.0, 0.0, 0.0)], "n long, n0 long, n1 long, cal0_0 double, cal0_1 double, cal1_0 double, cal1_1 double")
    assert {r["uid"] for r in N.prune_by_class(df, 2, 1.0, joint).collect()} == {1, 3, 4}


def test_range_index_with_one_hot_prefix(spark):
    """Four of five terms begin alike; every position is right and no range holds most of the terms."""
    from sentiforge import scratch
    rng = np.random.default_rng(8)
    terms = sorted({("same" if rng.random() < .8 else "") + "".join(rng.choice(list("abcdef"), 9)) for _ in range(6000)})
    df = spark.createDataFrame([(t,) for t in rng.permutation(terms)], "term string").repartition(8)
    held = {}
    real = scratch.written

    def spy(frame, tag):
        held[tag] = real(frame, tag)
        return held[tag]

    import sentiforge.operators.ordering as O
    old, O.written = O.written, spy
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # else so small a table is one range
    try:
        got = {r["term"]: r["ix"] for r in range_index(df, [F.col("term")]).collect()}
    finally:
        O.written = old
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {t: i for i, t in enumerate(terms)}
    sizes = [r["count"] for r in held["index"].groupBy(F.shiftright("_id", 33)).count().collect()]
    assert max(sizes) < 0.4 * len(terms)
