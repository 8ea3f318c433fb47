"""Batch scoring with a pluggable model function, and the tokenizer registry."""

import numpy as np
from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.functions.arrays import pad_truncate
from sentiforge.operators.models import batch_scores

def test_batch_scores(spark):
    # defined inside the test so the function is shipped to the workers by value
    def make_fn():
        w = np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 3.0]], dtype=np.float32)

        def predict(ids):
            return w[ids.astype(np.int64)].sum(axis=1)  # bag-of-ids linear model; pad id 0 adds nothing
        return predict

    rows = [(1, [1, 1, 1]), (2, [2]), (3, [3, 2]), (4, [])]
    df = spark.createDataFrame(rows, "uid long, ids array<int>").withColumn("ids", pad_truncate(F.col("ids"), 5))
    out = {r.uid: r for r in batch_scores(df, "ids", make_fn, 3, 5, ["negative", "neutral", "positive"],
                                          batch_size=2).collect()}
    assert [out[u].pred for u in (1, 2, 3, 4)] == [0, 1, 2, 0]
    assert out[1].predicted == "negative" and abs(sum(out[3].p) - 1.0) < 1e-9


def test_tokenizer_registry(spark):
    df = spark.createDataFrame([("Hi there, YOU",)], "t string")
    r = df.select(T.tokens(F.col("t"), "lower_whitespace").alias("a"), T.tokens(F.col("t"), "vectoriser").alias("b")).first()
    assert r.a == ["hi", "there,", "you"] and r.b == ["hi", "there", "you"]
