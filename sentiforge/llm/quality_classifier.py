"""Quality classifier: random Fourier features, ridge scores, isotonic calibration (operator 1).

Each text becomes a fixed list of statistics (never its key, source, language
or label).  Random Fourier features of the standardised statistics approximate
a Gaussian kernel; every task sums its rows' normal equations, the sums are
added in a tree, and one small system gives the ridge weights.  The equations
are kept per fold, so out-of-fold scores cost no further fit on data; their
histogram (a fixed number of bins) is made monotone by pooling adjacent
violators, which maps a score to the chance of a good label.

Nothing here grows with the corpus but the passes over it: the driver holds
the ``features x features`` sums and ``bins`` counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm import counts
from sentiforge.llm.shared import written
from sentiforge.llm.words import IS_SPACE, Words, find_words, slices

FEATURES = 256
RIDGE = 1e-3     # per training row
FOLDS = 4
BINS = 2048
SEED = 17

STATS = ("log_words", "word_length", "word_length_spread", "long_words", "symbols", "symbol_words", "upper", "capital_words",
         "digits", "marks", "high_bytes", "spaces", "distinct", "repeated_windows", "same_as_before", "dup_lines",
         "line_words", "sentence_ends")


def _bytes(*spans) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, z in spans:
        out[ord(a):ord(z) + 1] = True
    return out


_UPPER, _DIGIT = _bytes(("A", "Z")), _bytes(("0", "9"))
_MARK = _bytes(("!", "/"), (":", "@"), ("[", "`"), ("{", "~"))
_HIGH = np.arange(256) >= 0x80
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True


def statistics(w: Words) -> np.ndarray:
    """One row of ``STATS`` per text; an empty text has zeros."""
    n = counts.n_words(w)
    words = np.maximum(n, 1)
    size = np.maximum(np.diff(w.offsets), 1)
    length = (w.end - w.start).astype(float)
    by_doc = lambda x: np.bincount(w.doc, weights=x, minlength=w.n_texts) / words
    mean = by_doc(length)
    sym = np.concatenate(([0], np.cumsum(counts.SYMBOL[w.buf])))
    up = np.concatenate(([0], np.cumsum(_UPPER[w.buf])))
    first = np.unique(counts._keys(w.doc, w.hash), return_index=True)[1] if len(w.doc) else np.zeros(0, np.int64)
    dup, lines = counts.n_dup_lines(w)
    at = lambda table: counts.per_text(w, table[w.buf])
    out = np.column_stack([
        np.log1p(n), mean, np.sqrt(np.maximum(by_doc(length ** 2) - mean ** 2, 0)), by_doc(length > 14),
        at(counts.SYMBOL) / size, by_doc(sym[w.end] > sym[w.start]),
        at(_UPPER) / size, by_doc(up[w.end] - up[w.start] > 1), at(_DIGIT) / size, at(_MARK) / size, at(_HIGH) / size,
        at(IS_SPACE) / size, np.bincount(w.doc[first], minlength=w.n_texts) / words, counts.n_repeat_words(w) / words,
        by_doc(counts.same_as_before(w)), dup / np.maximum(lines, 1), np.log1p(n / np.maximum(lines, 1)),
        by_doc(_END[w.buf[w.end - 1]] if len(w.end) else np.zeros(0)),
    ])
    out[n == 0] = 0
    return out


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, *STATS)`` of every whole text (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text"):
            x = statistics(find_words(b.column(1)))
            yield pa.record_batch([b.column(0), *[pa.array(c) for c in x.T]], names=["key", *STATS])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    return src.mapInArrow(run, "key long, " + ", ".join(f"{s} double" for s in STATS))


def remainder(key: str):
    """crc32 of the key as text, modulo 5 (null for a null key)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phase
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score in 0..1 (0.5 where nothing was learned)."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, *self.knots)


def _stats_matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(s).to_numpy() for s in STATS]) if b.num_rows else np.zeros((0, len(STATS)))


def normal_equations(train: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold: the sum over rows of (features, label)(features, label)^T."""
    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.column_stack([model.features(_stats_matrix(b)), b.column("_y").to_numpy()])
            fold = b.column("_fold").to_numpy()
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, s in sums.items():
            yield pa.record_batch([pa.array([f], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["f", "s"])

    def merge(a: dict, b: dict) -> dict:
        return {f: a.get(f, 0) + b.get(f, 0) for f in {*a, *b}}

    n = len(model.phase) + 2
    rows = train.mapInArrow(run, "f int, s binary").rdd
    return rows.map(lambda r: {r.f: np.frombuffer(r.s).reshape(n, n)}).treeAggregate({}, merge, merge, depth=3)


def ridge(s: np.ndarray, penalty: float = RIDGE) -> np.ndarray:
    """Ridge weights from summed equations; the constant is not penalised."""
    g, c = s[:-1, :-1].copy(), s[:-1, -1]
    rows = g[-1, -1]
    g[np.diag_indices(len(g) - 1)] += penalty * rows
    g[-1, -1] += 1e-9
    return np.linalg.solve(g, c)


def pool_adjacent(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the bins' mean labels: (score, value) of its blocks."""
    blocks: list[list[float]] = []
    for a, m, s in zip(x, n, y):
        blocks.append([a * m, m, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], np.clip(b[:, 2] / b[:, 1], 0, 1)


def fit(train: DataFrame, n_features: int = FEATURES, seed: int = SEED, bins: int = BINS) -> Model:
    """Model from ``(*STATS, _y, _fold)``; every row counts."""
    got = train.agg(F.count(F.lit(1)).alias("n"), *[f(s).alias(f"{k}_{s}") for s in STATS
                                                      for k, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    zeros = np.zeros(len(STATS))
    if not got["n"]:
        return Model(zeros, zeros + 1, np.zeros((len(STATS), n_features)), np.zeros(n_features))
    scale = np.array([got[f"s_{s}"] for s in STATS])
    # kernel width: the distance of two random rows, sqrt(2 d), halved
    width = np.sqrt(len(STATS) / 2)
    model = Model(np.array([got[f"m_{s}"] for s in STATS]), np.where(scale > 1e-9, scale, 1.0),
                  rng.normal(size=(len(STATS), n_features)) / width, rng.uniform(0, 2 * np.pi, n_features))
    sums = normal_equations(train, model)
    total = sum(sums.values())
    model.weights = ridge(total)
    without = {f: ridge(total - s) if (total - s)[-2, -2] > 0 else model.weights for f, s in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            z, fold, y = model.features(_stats_matrix(b)), b.column("_fold").to_numpy(), b.column("_y").to_numpy()
            raw = np.zeros(len(z))
            for f in np.unique(fold).tolist():
                raw[fold == f] = z[fold == f] @ without[f]
            at = np.clip(((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)
            n = np.bincount(at, minlength=bins)
            full = np.flatnonzero(n)
            yield pa.record_batch([pa.array(full), pa.array(n[full].astype(float)),
                                   pa.array(np.bincount(at, weights=y, minlength=bins)[full])], names=["b", "n", "y"])

    hist = (train.mapInArrow(run, "b long, n double, y double").groupBy("b")
            .agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("b").toPandas())  # at most ``bins`` rows
    centre = (hist["b"].to_numpy() + 0.5) * 2 / bins - 0.5
    model.knots = pool_adjacent(centre, hist["n"].to_numpy(), hist["y"].to_numpy())
    return model


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: labelled, remainder not 0, fold = the remainder.

    Several label rows of one key are averaged; a null label counts for nothing."""
    y = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_k"))
         .agg(F.mean("quality").cast("double").alias("_y")))
    rem = remainder("key")
    return (stats.where(rem != 0).withColumn("_fold", (rem - 1).cast("int"))
            .join(y, F.col("key") == F.col("_k")).select(*STATS, "_y", "_fold"))


def score_rows(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.record_batch([b.column("key"), pa.array(model.score(_stats_matrix(b)))], names=["key", "score"])

    return stats.mapInArrow(run, "key long, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stats = written(text_statistics(docs), "statistics")
    model = fit(training_rows(stats, labels))
    return score_rows(stats, model).select(
        F.col("key").alias("doc_id"), F.coalesce(remainder("key") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
