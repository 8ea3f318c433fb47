"""Quality rules with a hashed n-gram likelihood ratio (operator 6).

Two multinomials over hashed n-grams are estimated: one from the trusted
target (texts whose label is good), one from the whole raw corpus.  Each
distinct text counts once in both, so copies do not lower their own ratio; it is
trusted if any of its copies is.  A text's score is the mean log-ratio of its n-grams, so length does not matter, and it
is kept if it passes the base counts and its score reaches ``threshold``.

N-grams come from two streams: all 4-byte windows of the text, hashed to
``2**bits`` buckets, and, for each word with two before it, whether the last
three words repeat their predecessor (8 buckets).  Each stream is normalised
by its own length and the two means are added.

Copies are found by hash, without a shuffle of texts, and each weighs one over
their number.  Counting is one pass that sends one row per task and touched bucket; the
weight table has ``2**bits + 8`` entries whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm import counts
from sentiforge.llm.shared import written
from sentiforge.llm.words import Words, find_words, slices, text_bytes

BITS = 18
SMOOTHING = 8.0
THRESHOLD = -0.2
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BROADCAST_ROWS = 1_000_000  # trusted keys, or copied texts, up to this number are sent to every executor, else both sides are shuffled


def byte_grams(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the 4 bytes from each position, whether they lie in one text)."""
    n = len(buf)
    valid = np.ones(n, dtype=bool)
    for k in range(1, 4):
        p = offsets[1:] - k
        valid[p[(p >= 0) & (p >= offsets[:-1])]] = False
    padded = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.uint32)
    g = padded[:n] | padded[1:n + 1] << np.uint32(8) | padded[2:n + 2] << np.uint32(16) | padded[3:n + 3] << np.uint32(24)
    with np.errstate(over="ignore"):
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(12)
        g *= np.uint32(0x297A2D39)
    return (g >> np.uint32(32 - bits)).astype(np.int64), valid


def repeat_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number 0..7 per word with two before it, its text)."""
    r = counts.same_as_before(w).astype(np.int64)
    if len(r) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = w.doc[2:] == w.doc[:-2]
    return (r[:-2] * 4 + r[1:-1] * 2 + r[2:])[ok], w.doc[2:][ok]


def ngram_counts(docs: DataFrame, text: str, trusted: str, weight: str, bits: int = BITS) -> DataFrame:
    """``(bucket, raw, target)`` over all rows; ``trusted`` is a boolean column,
    ``weight`` one over the number of rows with that text."""
    size = (1 << bits) + 8

    def run(batches: Iterator[pa.RecordBatch]):
        raw, target = np.zeros(size), np.zeros(size)
        for b in slices(batches, "_text"):
            w = find_words(b.column(0))
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            share = b.column(2).to_numpy(zero_copy_only=False)
            g, valid = byte_grams(w.buf, w.offsets, bits)
            length = np.diff(w.offsets)
            of_good, of_share = np.repeat(good, length), np.repeat(share, length)
            raw[:1 << bits] += np.bincount(g[valid], weights=of_share[valid], minlength=1 << bits)
            target[:1 << bits] += np.bincount(g[valid & of_good], weights=of_share[valid & of_good], minlength=1 << bits)
            r, doc = repeat_grams(w)
            raw[1 << bits:] += np.bincount(r, weights=share[doc], minlength=8)
            target[1 << bits:] += np.bincount(r[good[doc]], weights=share[doc][good[doc]], minlength=8)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])],
                              names=["bucket", "raw", "target"])

    src = docs.select(F.col(text).alias("_text"), F.col(trusted).cast("boolean").alias("_good"), F.col(weight).alias("_share"))
    # the shares of a text's copies sum to 1, so totals are whole numbers but for rounding
    return (src.mapInArrow(run, "bucket int, raw double, target double")
            .groupBy("bucket").agg(*[F.round(F.sum(c)).cast("long").alias(c) for c in ("raw", "target")]))


def log_ratios(table: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Weight per bucket: log of the smoothed target probability over the raw one.

    Both multinomials get the same pseudo-count at the target's sample size
    (raw counts are scaled to it), so an n-gram too rare to tell has weight near
    0 instead of counting against a text.  Without any trusted n-gram all weights are 0, so only the base counts decide."""
    got = table.toPandas()  # at most 2**bits + 8 rows
    c = np.zeros((2, (1 << bits) + 8))
    c[0, got["bucket"]], c[1, got["bucket"]] = got["raw"], got["target"]
    out = np.zeros((1 << bits) + 8)
    for part in (slice(0, 1 << bits), slice(1 << bits, None)):
        raw, target = c[0, part], c[1, part]
        if target.sum():
            expected = raw * (target.sum() / raw.sum())
            out[part] = np.log(target + smoothing) - np.log(expected + smoothing)
    return out


def text_scores(w: Words, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Length-normalised log-likelihood ratio per text; 0 for a text without n-grams."""
    g, valid = byte_grams(w.buf, w.offsets, bits)
    total = counts.segment_sums(np.where(valid, weights[g], 0.0), w.offsets)
    n = counts.segment_sums(valid.astype(float), w.offsets)
    r, doc = repeat_grams(w)
    m = np.bincount(doc, minlength=w.n_texts)
    rep = np.bincount(doc, weights=weights[(1 << bits) + r], minlength=w.n_texts)
    return np.round(total / np.maximum(n, 1) + rep / np.maximum(m, 1), 12)


def trusted_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_trusted``: the key is labelled, and every label row of it is good."""
    good = (labels.groupBy(F.col("doc_id").alias("_k")).agg((F.min("quality") == 1).alias("_g"))
            .where("_g AND _k IS NOT NULL"))
    if labels.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    return docs.join(good, docs[key] == good["_k"], "left").withColumn("_trusted", F.coalesce("_g", F.lit(False))).drop("_g", "_k")


def distinct_weights(marked: DataFrame, text: str = "_t") -> DataFrame:
    """``marked`` with ``_weight``, one over the number of rows with its text, and
    ``_trusted`` if any of those rows is."""
    hashes = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)}
    copied = (marked.select(*[h.alias(n) for n, h in hashes.items()], "_trusted").groupBy("_h1", "_h2")
              .agg(F.count(F.lit(1)).alias("_c"), F.max("_trusted").alias("_any")).where("_c > 1"))
    copied = written(copied, "copied")
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    return (marked.withColumns(hashes).join(copied, ["_h1", "_h2"], "left")
            .withColumns({"_weight": 1.0 / F.coalesce("_c", F.lit(1)), "_trusted": F.coalesce("_any", "_trusted")})
            .drop("_h1", "_h2", "_c", "_any"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS,
        distinct: bool = False) -> np.ndarray:
    """Weights from all texts of ``docs``, trusted ones marked by ``labels``; with ``distinct``, copies count as one text."""
    marked = trusted_texts(docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")), labels, "_key")
    marked = distinct_weights(marked) if distinct else marked.withColumn("_weight", F.lit(1.0))
    return log_ratios(ngram_counts(marked, "_t", "_trusted", "_weight", bits), bits)


def judge(docs: DataFrame, weights: np.ndarray, text: str = "text", carry: list[str] | None = None,
          threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``carry`` columns (default: all) of every row, then its counts, score and verdict.

    Null and empty texts have no word, so they fail the base counts."""
    carry = docs.columns if carry is None else carry
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text"):
            w = find_words(b.column(b.num_columns - 1))
            n, rep = counts.n_words(w), counts.n_repeat_words(w)
            failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
            score = text_scores(w, held.value, bits)
            cols = [n, counts.word_chars(w), counts.n_symbols(w), counts.n_dup_lines(w)[0], rep, failed, score,
                    ~failed & (score >= threshold)]
            yield pa.record_batch([*b.columns[:-1], *map(pa.array, cols)],
                                  names=[*b.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                         "n_repeat_words", "base_failed", "llr", "kept"])

    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, llr double, kept boolean")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document; trusted are those labelled quality 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, fit(docs, labels, distinct=True), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "llr")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that are kept, with their columns."""
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), distinct=True)
    # the counts get names that no column of documents has
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = judge(renamed, weights, text=names["text"]).where("kept")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
