"""Invariants of the label, metric and LM operators on small generated inputs."""

import random

from pyspark.sql import functions as F

from sentiforge.functions.arrays import pad_truncate
from sentiforge.operators import lmprep as LM
from sentiforge.operators import metrics as M
from sentiforge.operators import noise as N


def _scores(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for u in range(n):
        e = [rnd.random() for _ in range(3)]
        lab = rnd.randint(0, 2)
        e[rnd.choice([lab, lab, rnd.randint(0, 2)])] += 1.0
        s = sum(e)
        rows.append((u, lab, [x / s for x in e]))
    return spark.createDataFrame(rows, "uid long, label int, p array<double>")


def test_calibrated_joint_sums_to_n_and_rows_to_label_counts(spark):
    sc = _scores(spark)
    j = N.confident_joint(sc, 3).collect()
    assert abs(sum(r.calibrated for r in j) - 400) < 1e-9
    counts = {r.label: r["count"] for r in sc.groupBy("label").count().collect()}
    raw_rows = {i: sum(r["count"] for r in j if r.given_label == i) for i in range(3)}
    assert all(raw_rows[i] <= counts[i] for i in range(3))


def test_macro_f1_and_accuracy_symmetric(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 2), rnd.randint(0, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "uid long, gold int, pred int")
    a = M.macro_prf(df, "gold", "pred", [0, 1, 2]).first()
    b = M.macro_prf(df, "gold", "pred", [0, 1, 2], swap=True).first()
    assert abs(a.f1 - b.f1) < 1e-12 and abs(a.accuracy - b.accuracy) < 1e-12
    assert abs(a.precision - b.recall) < 1e-12


def test_pad_truncate_length(spark):
    df = spark.createDataFrame([([],), ([5] * 300,), ([6] * 301,), ([0, 7],)], "ids array<int>")
    out = [r[0] for r in df.select(pad_truncate(F.col("ids"), 300)).collect()]
    assert all(len(x) == 300 for x in out) and out[3][:3] == [0, 7, 0]


def test_pack_blocks_keeps_order_and_drops_tail(spark):
    rows = [(d, ln, list(range(100 * d + 10 * ln, 100 * d + 10 * ln + 7))) for d in range(5) for ln in range(3)]
    enc = spark.createDataFrame(rows, "doc_id long, line_no int, ids array<int>")
    flat = [i for _, _, ids in sorted(rows) for i in ids]
    blocks = LM.pack_blocks(enc, "doc_id", ["line_no"], 10).orderBy("block").collect()
    inner = 8
    assert len(blocks) == len(flat) // inner
    for b in blocks:
        assert b.ids == [LM.CLS] + flat[b.block * inner:(b.block + 1) * inner] + [LM.SEP]
