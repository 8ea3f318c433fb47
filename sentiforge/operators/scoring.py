"""Batch scoring of whole tables by a user's model function.

Rows with input go through the model in Arrow batches, rows without keep their
place with a null prediction.  The model is made once per Python worker, however
many tasks and batches the worker serves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiforge.functions.arrays import argmax, pad_truncate, softmax
from sentiforge.operators.labels import decode_fixed

_LOADED: dict[str, Callable] = {}      # models of this Python worker, by their name on the driver


def _model(name: str, make: Callable) -> Callable:
    if name not in _LOADED:
        _LOADED.clear()                # one model at a time
        _LOADED[name] = make()
    return _LOADED[name]


def hashed_ids(tokens: Column, size: int) -> Column:
    """Ids 1 to ``size`` of tokens by hashing (0 stays free for padding): no vocabulary, no join."""
    return F.transform(tokens, lambda t: (F.lit(1) + F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(size))).cast("int"))


def score_table(df: DataFrame, ids_col: str, make_model: Callable, n_classes: int, length: int,
                classes: Sequence[str], pad: int = 0, batch_size: int = 32) -> DataFrame:
    """``df`` with ``predicted`` and ``proba_<class>``, one row for each row of ``df``.

    ``make_model()`` returns ``f(ids, mask) -> logits``: ids ``[rows, length]`` cut and padded
    on the right with ``pad``, mask 1 where there is an id, logits ``[rows, n_classes]``.  It gets
    ``batch_size`` rows at a time.  A null or empty id list is a row without input."""
    name = uuid.uuid4().hex
    keep = df.columns
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                      F.when(F.size(ids_col) > 0, pad_truncate(F.col(ids_col), length, pad)).alias("ids"),
                      F.least(F.size(ids_col), F.lit(length)).alias("n"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = _model(name, make_model)
        for b in batches:
            rows = np.flatnonzero(np.asarray(b.column(1).is_valid()))
            ids = np.asarray(b.column(1).flatten()).reshape(len(rows), length)
            mask = (np.arange(length) < np.asarray(b.column(2))[rows][:, None]).astype(np.int32)
            got = [np.asarray(model(ids[i:i + batch_size], mask[i:i + batch_size]), dtype=np.float64)
                   for i in range(0, len(rows), batch_size)]
            if any(g.shape[1:] != (n_classes,) for g in got):
                raise ValueError(f"the model must give {n_classes} logits a row")
            size = np.zeros(b.num_rows, np.int32)
            size[rows] = n_classes
            off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            flat = np.concatenate(got).ravel() if got else np.zeros(0)
            logits = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), logits], names=["row", "logits"])

    kind = given.schema["row"].dataType.simpleString()
    out = given.mapInArrow(run, f"row {kind}, logits array<double>")
    out = out.withColumn("p", softmax(F.col("logits")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep],
                      decode_fixed(argmax(F.col("logits")), classes).alias("predicted"),
                      *[F.get("p", j).alias(f"proba_{c}") for j, c in enumerate(classes)])
