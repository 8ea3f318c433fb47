"""Ensemble voting over K classifier outputs.

The reference stacks K prediction lists by row position.  Here the K tables
are stacked as rows (``model, uid, cls``) and grouped by ``uid`` once; the
per-class counts are conditional counts in that single aggregation, so the
shuffle carries one partial row per (map task, uid) whatever K is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiforge.functions.arrays import argmax


def stack_models(tables: dict, uid_col: str = "uid", cls_col: str = "cls", keep: Sequence[str] = ()) -> DataFrame:
    """Union K ``(uid, *keep, cls)`` tables into ``(model, uid, *keep, cls)``."""
    out = None
    for name, t in tables.items():
        t = t.select(F.lit(name).alias("model"), F.col(uid_col).alias("uid"), *keep, F.col(cls_col).alias("cls"))
        out = t if out is None else out.unionByName(t)
    return out


def majority_vote(stacked: DataFrame, n_classes: int, uid_col: str = "uid", cls_col: str = "cls") -> DataFrame:
    """``(uid, vote, n_votes)``: most frequent class per uid; ties -> smallest class id."""
    counts = F.array(*[F.count_if(F.col(cls_col) == c) for c in range(n_classes)])
    agg = stacked.groupBy(uid_col).agg(counts.alias("_counts"))
    return agg.select(uid_col, argmax(F.col("_counts")).alias("vote"),
                      F.array_max("_counts").cast("long").alias("n_votes"))


def vote_classes(stacked: DataFrame, classes: Sequence, uid_col: str = "uid", cls_col: str = "cls") -> DataFrame:
    """Majority vote on class values (not ids): ties -> the class listed first."""
    counts = F.array(*[F.count_if(F.col(cls_col) == F.lit(c)) for c in classes])
    agg = stacked.groupBy(uid_col).agg(counts.alias("_counts"))
    names = F.array(*[F.lit(c) for c in classes])
    return agg.select(uid_col, F.get(names, argmax(F.col("_counts"))).alias("vote"))
