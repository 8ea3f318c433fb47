"""Splits, folds and shuffles that are functions of (seed, key).

``randomSplit``/``rand()`` change with partitioning and task retries; these
do not, and two calls with one seed agree (inputs and masks split alike).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiforge.functions.hashing import hash_int, uniform
from sentiforge.operators.ordering import row_index


def holdout_split(df: DataFrame, id_col: str, test_fraction: float, seed: int, name: str = "split") -> DataFrame:
    """``split`` = 'test' for rows whose md5 uniform falls below the fraction, else 'train'.
    Bernoulli per key: the test size is close to, not exactly, fraction * n."""
    u = uniform(seed, F.col(id_col))
    return df.withColumn(name, F.when(u < test_fraction, F.lit("test")).otherwise(F.lit("train")))


def kfold_assign(df: DataFrame, id_col: str, label_col: str, k: int, seed: int) -> DataFrame:
    """Stratified folds: inside each class, rows in md5 order are dealt round-robin
    into folds 0..k-1, so every fold holds floor or ceil of n_class / k rows."""
    h = hash_int(seed, F.col(id_col))
    ix = row_index(df.withColumn("_h", h), "_h", tiebreak=[id_col], partition_cols=[label_col],
                   bucket_width=1 << 20, name="_ix")
    return ix.withColumn("fold", F.pmod(F.col("_ix"), F.lit(k)).cast("int")).drop("_h", "_ix")


def shuffle_batches(df: DataFrame, id_col: str, epoch: int, seed: int, batch_size: int) -> DataFrame:
    """Random sampler order for one epoch cut into batches: ``batch`` = position // size."""
    h = hash_int(seed, epoch, F.col(id_col))
    ix = row_index(df.withColumn("_h", h), "_h", tiebreak=[id_col], bucket_width=1 << 20, name="_ix")
    return ix.withColumn("batch", F.floor(F.col("_ix") / batch_size)).drop("_h", "_ix")


def noise_matrix_from_trace(k: int, diag: float, frac_zero: float) -> list[list[float]]:
    """Column-stochastic K x K matrix ``M[s][y] = P(given s | true y)`` with ``diag`` on the
    diagonal and, per column, ``round(frac_zero * (k - 1))`` off-diagonal zeros at the rows
    y+1, y+2, ... (mod k); the remaining mass ``1 - diag`` is shared evenly by the other cells.
    Deterministic by construction."""
    n_zero = int(round(frac_zero * (k - 1)))
    m = [[0.0] * k for _ in range(k)]
    for y in range(k):
        m[y][y] = diag
        others = [(y + d) % k for d in range(1, k)]
        live = others[n_zero:]
        for s in live:
            m[s][y] = (1.0 - diag) / len(live)
    return m


def inject_noise(df: DataFrame, id_col: str, label_col: str, matrix: list[list[float]], seed: int,
                 name: str = "noisy_label") -> DataFrame:
    """Draw the given label from column ``y`` of the noise matrix with an md5 uniform:
    the first class whose cumulative probability exceeds u.  In-row, no join."""
    k = len(matrix)
    cums = []
    for y in range(k):
        acc, col = 0.0, []
        for s in range(k):
            acc += matrix[s][y]
            col.append(acc)
        col[-1] = 1.0 + 1e-12
        cums.append(F.array(*[F.lit(c) for c in col]))
    table = F.array(*cums)
    u = uniform(seed, "noise", F.col(id_col))
    row = F.get(table, F.col(label_col))
    return df.withColumn(name, (F.array_position(F.transform(row, lambda c: u < c), True) - 1).cast("int"))
