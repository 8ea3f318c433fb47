"""The distributed fit against plain numpy; calibration against a brute-force isotonic fit; held-out accuracy."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from sentiforge.llm import quality_classifier as qc


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)), min_size=1, max_size=9))
def test_pooling_is_the_isotonic_fit(rows):
    n = np.array([a for a, _ in rows], float)
    y = np.array([min(a, b) for a, b in rows], float)
    x = np.arange(len(rows), dtype=float)
    at, value = qc.pool_adjacent(x, n, y)
    m = len(rows)  # max-min formula
    brute = [max(min(y[a:b].sum() / n[a:b].sum() for b in range(i + 1, m + 1)) for a in range(i + 1)) for i in range(m)]
    assert (np.diff(value) > 0).all()
    block = np.searchsorted(value, np.array(brute) - 1e-9)
    assert np.allclose(value[block], brute)


def test_fit_equals_numpy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    train = qc.training_rows(qc.text_statistics(docs), labels).cache()
    model = qc.fit(train, n_features=32)
    p = train.toPandas()
    x, y = p[list(qc.STATS)].to_numpy(), p["_y"].to_numpy()
    z = model.features(x)
    pen = np.diag([qc.RIDGE * len(x)] * 32 + [0])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + pen, z.T @ y), atol=1e-4)
    assert model.mean == pytest.approx(x.mean(axis=0))
    score = model.score(x)
    assert ((score >= 0) & (score <= 1)).all()
    order = np.argsort(z @ model.weights)
    assert (np.diff(score[order]) >= -1e-12).all()
    train.unpersist()


def test_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in qc.op1_quality_classifier(spark, SF_SMALL).collect()}
    docs = [r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(got) == sorted(docs)
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
            if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (None, "some text", "y"), (2, "", "z"), (3, "a " * 70000, None), (3, "a b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 1), (None, 1, 1), (2, 1, None)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = qc.op1_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    empty = qc.fit(qc.training_rows(qc.text_statistics(docs), labels.limit(0)))
    assert {r["score"] for r in qc.score_rows(qc.text_statistics(docs), empty).collect()} == {0.5}
    assert qc.score_rows(qc.text_statistics(docs.limit(0)), empty).count() == 0
