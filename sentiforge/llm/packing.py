"""Best-fit packing of whole documents into fixed-length sequences (operator 5).

Only the number of pieces of each length matters for a packing, and there are
at most ``capacity`` lengths.  So the plan is made from that histogram alone:
bins are opened and filled in runs ("these 1,300 bins each take two pieces of
700 ids"), and each piece finds its bin from its length and its rank among the
pieces of that length.  The plan's size is bounded by the capacity, whatever
the number of documents, and no task ever holds a group of pieces.

Method: pieces above a third of the capacity are matched greedily, at most two
to a bin, the largest with the largest that still fits beside it; the others,
largest first, go to the bins with the smallest gap that takes them.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiforge.llm.encode import encoder
from sentiforge.llm.shared import written
from sentiforge.llm.token_codes import binary_column
from sentiforge.llm.words import slices

CAPACITY = 4096


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """``(plan, bins)`` for ``counts[length]`` pieces of each length.

    A plan row ``(length, rank0, bin0, per_bin, offset)``: the pieces of that
    length from rank ``rank0`` on go to bins ``bin0, bin0+1, ...``, ``per_bin``
    to a bin, the first of a bin at ``offset``.  Rows are ordered by (length, rank0)."""
    left = {s: c for s, c in counts.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    rank: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs [lo, hi) of bins
    open_gaps: list[int] = []
    bins = 0

    def put(size, lo, n, per, offset):
        plan.append((size, rank[size], lo, per, offset))
        rank[size] += n

    def free(gap, lo, hi):
        if gap and hi > lo:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((lo, hi))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        at = bisect.bisect_right(large, min(capacity - s, s)) - 1
        t = large[at] if at >= 0 else 0
        if t == s and left[s] == 1:
            at -= 1
            t = large[at] if at >= 0 else 0
        if not t:
            n = left[s]
            put(s, bins, n, 1, 0)
        elif t == s:
            n = left[s] // 2
            put(s, bins, 2 * n, 2, 0)
        else:
            n = min(left[s], left[t])
            put(s, bins, n, 1, 0)
            put(t, bins, n, 1, s)
            left[t] -= n
        left[s] -= 2 * n if t == s else n
        free(capacity - s - t, bins, bins + n)
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        while c:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):
                n = -(-c // (capacity // s))
                free(capacity, bins, bins + n)
                bins += n
                continue
            gap = open_gaps[i]
            lo, hi = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(i)
            per = gap // s
            n = min(hi - lo, c // per)
            if n:
                put(s, lo, n * per, per, capacity - gap)
                free(gap - per * s, lo, lo + n)
                c -= n * per
                lo += n
            if c and lo < hi:  # fewer than fill one bin
                put(s, lo, c, c, capacity - gap)
                free(gap - c * s, lo, lo + 1)
                c, lo = 0, lo + 1
            free(gap, lo, hi)
    out = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    return out, bins


def cut_pieces(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
               capacity: int = CAPACITY) -> DataFrame:
    """Written table of pieces: ``key, piece, start, length, ids_crc32, part, rank, ids``.

    Texts longer than the capacity (end id included) are cut into pieces of
    ``capacity`` ids, the last one shorter.  ``rank`` numbers the pieces of one
    length within the writing task ``part``; as the table is committed once, the
    numbers hold for every later reader.  ``ids`` are little-endian, uint16 if the
    vocabulary fits, else uint32.  Null text: empty (one end id)."""
    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        enc = encoder(vocab)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in slices(batches, "_text"):
            ids, off = enc.encode(b.column(1))
            ids = np.insert(ids, off[1:], np.uint32(end_id))
            off = off + np.arange(len(off))
            n = np.diff(off)
            per = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            at = np.append(off[row] + start, off[-1])
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            new = np.flatnonzero(np.diff(ranked, prepend=-1))
            within = np.arange(len(ranked)) - np.repeat(new, np.diff(new, append=len(ranked)))
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = within + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            raw = np.ascontiguousarray(ids, dtype="<u4")
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch(
                [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank),
                 binary_column(raw.astype(enc.dtype), at)],
                names=["key", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    return written(src.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long, "
                                       "part int, rank long, ids binary"), "pieces")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces (their other columns stay, lazily).

    The histogram (at most ``capacity`` rows) is all that reaches the driver."""
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(hist, capacity)
    width = max(hist.values(), default=1) + 1
    first = plan[:, 0] * width + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            _, r0, bin0, per, offset = plan[np.searchsorted(first, length * width + rank, side="right") - 1].T
            k = rank - r0
            yield pa.record_batch([*b.columns, pa.array(bin0 + k // per), pa.array(offset + k % per * length)],
                                  names=[*b.schema.names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = (pieces.join(starts, ["length", "part"])
              .withColumn("_rank", F.col("rank") + F.col("_before")).drop("rank", "_before", "part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").drop("_rank")


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, length, keys, offsets, ids)``: the packed sequences themselves.

    A group holds at most ``capacity`` ids, so the lists are bounded."""
    item = F.struct("offset", "key", "length", "ids")
    rows = F.array_sort(F.collect_list(item))
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("_p"))
            .select("sequence_id", "length", F.col("_p.key").alias("keys"), F.col("_p.offset").alias("offsets"),
                    F.aggregate("_p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack ``documents`` into sequences of 4,096 ids; one row per piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    small = pieces.select("key", "piece", "start", "length", "ids_crc32", "part", "rank")
    return place_pieces(small).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed sequences, with the ids of the documents in each and their offsets."""
    import public_tokenizers

    packed = sequences(place_pieces(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)))
    return packed.withColumnRenamed("keys", "doc_ids")
