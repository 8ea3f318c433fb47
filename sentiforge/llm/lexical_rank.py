"""Ranked lexical search by sorted access alone: NRA over blocks (operator 13).

Every block of documents keeps one posting list per query term, all of them
merged in one sequence of falling impact (term weight times saturated
frequency).  A round reads the next stretch of that sequence and keeps, per
item and document, a lower bound (the impacts read) and an upper bound (plus,
for every list in which the document has not been met, the impact at which that
list stands).  After a round the 20th best lower bound of an item over all
blocks is its threshold: documents whose upper bound is below it go, with their
postings, and once the bound of a document never met is below it no new ones
are taken in.  Rounds go on until every kept document's bounds meet, so
membership, ties and scores are final.  No list is looked up at random.

Spark moves the statistics (sums over blocks), the thresholds (20 rows per item
and task) and nothing else: texts and postings stay in the task that reads
their block, each round rewrites the blocks without what fell away.

Terms are compared by 64-bit hashes (two distinct terms of a corpus with 10^9
different words meet an item's term with a chance below 10^-6).

Odd input: a null or empty text has no terms and is never ranked; an item
without terms gives no rows; every row of either table counts by itself, also
where ids repeat; a null id ranks behind all others of its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiforge.llm.shared import written
from sentiforge.llm.words import LOWER, slices, span_hashes, text_bytes

TOP = 20
ITEMS = 256                    # items of one pass over the documents
SHARES = (1 / 16, 1 / 4, 1.0)  # part of the postings left that a round reads; the last one repeats
BLOCK_BYTES = 8 << 20
BLOCK_CELLS = 16 << 20         # documents of a block times terms of a pass
_EXPANDED = 4 << 20

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[0x30:0x3A] = _IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True


def find_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every term, in order: runs of digits, ASCII letters
    (A-Z lower-cased) and characters beyond ASCII."""
    buf, off = text_bytes(texts)
    term = _IS_TERM[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    start, end = term.copy(), term.copy()
    start[1:] &= ~term[:-1] | edge[1:len(buf)]
    end[:-1] &= ~term[1:] | edge[1:len(buf)]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.searchsorted(off, s, side="right") - 1, span_hashes(LOWER[buf], s, e)


@dataclass
class Items:
    """The terms of one pass: ``term`` (sorted hashes) and, in item order, the
    pairs ``pair_item, pair_term, pair_times``; ``by_term`` orders them by term."""

    ids: list
    term: np.ndarray
    pair_item: np.ndarray
    pair_term: np.ndarray
    pair_times: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list) -> Items:
        item, h = find_terms(pa.array(texts, pa.large_string()))
        term, t = np.unique(h, return_inverse=True)
        pair, times = np.unique(item * max(1, len(term)) + t, return_counts=True)
        return cls(ids, term, pair // max(1, len(term)), pair % max(1, len(term)), times)

    def weighted(self, weight: np.ndarray) -> None:
        """Set the gain of each pair and the two ways into them."""
        self.gain = self.pair_times * weight[self.pair_term]
        self.weight = weight
        self.item_at = np.searchsorted(self.pair_item, np.arange(len(self.ids) + 1))
        self.by_term = np.argsort(self.pair_term, kind="stable")
        self.term_at = np.searchsorted(self.pair_term[self.by_term], np.arange(len(self.term) + 1))


# ---- blocks ------------------------------------------------------------------

_INDEX = ("ids array<long>, n_docs long, n_terms long, held array<int>, held_in array<long>, "
          "n binary, term binary, doc binary, tf binary")
_STATE = ("ids array<long>, term binary, doc binary, sat binary, seen binary, "
          "c_item binary, c_doc binary, low binary, open long")


def _ids(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _bin(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())


def _num(batch: pa.RecordBatch, name: str, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind).astype(np.int64)


def index_blocks(docs: DataFrame, q: Items, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of whole texts: its documents that hold a term of the
    pass, their lengths and postings, and the block's share of the corpus counts."""
    rows = max(1, min(4096, BLOCK_CELLS // max(1, len(q.term))))

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in slices(batches, "_text", BLOCK_BYTES):
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                doc, h = find_terms(b.column(1))
                n = np.bincount(doc, minlength=b.num_rows)
                t = np.searchsorted(q.term, h)
                hit = t < len(q.term)
                hit[hit] = q.term[t[hit]] == h[hit]
                posting, tf = np.unique(doc[hit] * max(1, len(q.term)) + t[hit], return_counts=True)
                t, d = posting % max(1, len(q.term)), posting // max(1, len(q.term))
                kept, d = np.unique(d, return_inverse=True)
                held, held_in = np.unique(t, return_counts=True)
                yield pa.record_batch(
                    [_ids(b.column(0).take(pa.array(kept))), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                     pa.array([held], pa.list_(pa.int32())), pa.array([held_in], pa.list_(pa.int64())),
                     _bin(n[kept], "<i8"), _bin(t, "<u4"), _bin(d, "<u2"), _bin(tf, "<u4")],
                    names=["ids", "n_docs", "n_terms", "held", "held_in", "n", "term", "doc", "tf"])

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, _INDEX)


class _Block:
    """One block between two rounds: postings not yet read (impact falling),
    documents times terms already met, candidates and their lower bounds."""

    def __init__(self, q, n_docs, term, doc, sat, seen, item, cdoc, low):
        self.q, self.n = q, n_docs
        self.term, self.doc, self.sat, self.seen = term, doc, sat, seen
        self.item, self.cdoc, self.low = item, cdoc, low

    @classmethod
    def first(cls, q: Items, batch, i, n_all: int, l_all: int):
        """Postings of an index row, scored and put in order of impact."""
        n, tf = _num(batch, "n", i, "<i8"), _num(batch, "tf", i, "<u4")
        term, doc = _num(batch, "term", i, "<u4"), _num(batch, "doc", i, "<u2")
        m = 100 - 25 + (25 * n * n_all) // max(1, l_all)
        sat = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(-(q.weight[term] * sat), kind="stable")
        order = order[q.weight[term[order]] > 0]
        none = np.zeros(0, np.int64)
        return cls(q, len(n), term[order], doc[order], sat[order], np.zeros((len(n), len(q.term)), bool), none, none, none)

    @classmethod
    def again(cls, q: Items, batch, i):
        n = len(batch.column("ids")[i].values)
        width = -(-len(q.term) // 8)
        seen = np.frombuffer(batch.column("seen")[i].as_buffer(), np.uint8).reshape(n, width)
        return cls(q, n, _num(batch, "term", i, "<u4"), _num(batch, "doc", i, "<u2"), _num(batch, "sat", i, "<u4"),
                   np.unpackbits(seen, axis=1)[:, :len(q.term)].astype(bool),
                   _num(batch, "c_item", i, "<u4"), _num(batch, "c_doc", i, "<u2"), _num(batch, "low", i, "<i8"))

    def prune(self, tau: np.ndarray) -> int:
        """Drop candidates and postings that cannot count any more; what is still
        undecided: open items (a document never met may enter) and candidates whose bounds differ."""
        q = self.q
        stand = np.zeros(len(q.term), np.int64)          # where each list stands
        t, first = np.unique(self.term, return_index=True)
        stand[t] = self.sat[first]
        bound = q.gain * stand[q.pair_term]
        self.open = np.zeros(len(q.ids), bool)
        at = np.searchsorted(self.item, np.arange(len(q.ids) + 1))
        keep = np.ones(len(self.item), bool)
        undecided = 0
        for i in range(len(q.ids)):
            span = slice(q.item_at[i], q.item_at[i + 1])
            live = bound[span] > 0
            terms, gains = q.pair_term[span][live], bound[span][live]
            rest = int(gains.sum())
            self.open[i] = rest > 0 and rest >= tau[i]
            undecided += bool(self.open[i])
            mine = slice(at[i], at[i + 1])
            if len(terms):
                more = (~self.seen[np.ix_(self.cdoc[mine], terms)]).astype(np.int64) @ gains
                keep[mine] = self.low[mine] + more >= tau[i]
                undecided += int((keep[mine] & (more > 0)).sum())
            else:
                keep[mine] = self.low[mine] >= tau[i]
        self.item, self.cdoc, self.low = self.item[keep], self.cdoc[keep], self.low[keep]
        if not self.open.all() and len(self.term):
            wanted = np.zeros((len(q.ids), self.n), bool)
            wanted[self.open] = True
            wanted[self.item, self.cdoc] = True
            of_term = np.zeros((len(q.term), self.n), bool)
            step = max(1, (4 * BLOCK_CELLS) // max(1, self.n))
            for a in range(0, len(q.by_term), step):
                pairs = q.by_term[a:a + step]
                terms, begin = np.unique(q.pair_term[pairs], return_index=True)
                of_term[terms] |= np.logical_or.reduceat(wanted[q.pair_item[pairs]], begin, axis=0)
            left = of_term[self.term, self.doc]
            self.term, self.doc, self.sat = self.term[left], self.doc[left], self.sat[left]
        return undecided

    def read(self, share: float) -> None:
        """Read the next ``share`` of the postings left, in order, into the lower bounds."""
        q, k = self.q, math.ceil(len(self.term) * share)
        low = np.zeros(len(q.ids) * self.n, np.int64)
        met = np.zeros(len(low), bool)
        cell = self.item * self.n + self.cdoc
        low[cell], met[cell] = self.low, True
        times = np.diff(q.term_at)[self.term[:k]]
        cuts = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()) + _EXPANDED, _EXPANDED), side="left")
        for a, b in zip(cuts, [*cuts[1:], k]):
            t, d, s, r = self.term[a:b], self.doc[a:b], self.sat[a:b], times[a:b]
            pair = q.by_term[np.arange(int(r.sum())) + np.repeat(q.term_at[t] - (np.cumsum(r) - r), r)]
            item, d, s = q.pair_item[pair], np.repeat(d, r), np.repeat(s, r)
            cell = item * self.n + d
            ok = self.open[item] | met[cell]
            np.add.at(low, cell[ok], (q.gain[pair] * s)[ok])
            met[cell[ok]] = True
        self.seen[self.doc[:k], self.term[:k]] = True
        self.term, self.doc, self.sat = self.term[k:], self.doc[k:], self.sat[k:]
        cell = np.flatnonzero(met)
        self.item, self.cdoc, self.low = cell // max(1, self.n), cell % max(1, self.n), low[cell]

    def row(self, ids: pa.Array, undecided: int) -> pa.RecordBatch:
        """The block as stored; documents that nothing refers to any more are left out."""
        used = np.zeros(self.n, bool)
        used[self.cdoc] = used[self.doc] = True
        at = np.cumsum(used) - 1
        return pa.record_batch(
            [_ids(ids.filter(pa.array(used))), _bin(self.term, "<u4"), _bin(at[self.doc], "<u2"), _bin(self.sat, "<u4"),
             _bin(np.packbits(self.seen[used], axis=1), "u1"), _bin(self.item, "<u4"), _bin(at[self.cdoc], "<u2"),
             _bin(self.low, "<i8"), pa.array([undecided])],
            names=["ids", "term", "doc", "sat", "seen", "c_item", "c_doc", "low", "open"])


def _round(blocks: DataFrame, q: Items, tau: np.ndarray, share: float, counts: tuple[int, int] | None) -> DataFrame:
    """One round over all blocks; ``counts`` (documents, terms of the corpus) only for the first."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                block = _Block.first(q, b, i, *counts) if counts else _Block.again(q, b, i)
                if block.prune(tau):
                    block.read(share)
                yield block.row(b.column("ids")[i].values, block.prune(tau))

    if counts:
        blocks = blocks.select("ids", "n", "term", "doc", "tf")
    return blocks.mapInArrow(run, _STATE)


def _leaders(blocks: DataFrame, q: Items, top: int) -> DataFrame:
    """``(item, doc, low)``: the best ``top`` candidates of every item in each task."""
    def best(item, doc, none, low):
        order = np.lexsort((doc, none, -low, item))
        item = item[order]
        return order[np.arange(len(item)) - np.searchsorted(item, item) < top]

    def run(batches: Iterator[pa.RecordBatch]):
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                low = _num(b, "low", i, "<i8")
                at = _num(b, "c_doc", i, "<u2")
                key = np.asarray(ids.fill_null(0)) if len(ids) else np.zeros(0, np.int64)
                none = np.asarray(ids.is_null()).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
                new = [_num(b, "c_item", i, "<u4"), key[at], none[at], low]
                held = [np.concatenate((x, y)) for x, y in zip(held, new)]
                order = best(*held)
                held = [x[order] for x in held]
        item, key, none, low = held
        yield pa.record_batch([pa.array(item), pa.array(key, mask=none.astype(bool)), pa.array(low)],
                              names=["item", "doc", "low"])

    found = blocks.select("ids", "c_item", "c_doc", "low").mapInArrow(run, "item long, doc long, low long")
    return found.where("low > 0")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("low"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _weights(index: DataFrame, q: Items) -> tuple[tuple[int, int], np.ndarray]:
    """(documents with a term, terms) of the corpus and each term's weight.

    The driver gets one number per term of the pass."""
    n_all, l_all = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(q.term), np.int64)
    held = index.select(F.explode(F.arrays_zip("held", "held_in")).alias("x"))
    for r in held.groupBy("x.held").agg(F.sum("x.held_in").alias("df")).collect():
        df[r["held"]] = r["df"]
    return (n_all, l_all), np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def search_pass(docs: DataFrame, items: list, key: str = "doc_id", text: str = "text", top: int = TOP,
                shares: tuple[float, ...] = SHARES) -> tuple[Items, DataFrame]:
    """``(item, doc, low, rank)`` for one pass of items, ``[(id, text), ...]``; item is the place in the list."""
    q = Items.of([i for i, _ in items], [t for _, t in items])
    index = written(index_blocks(docs, q, key, text), "lexical-index")
    counts, weight = _weights(index, q)
    q.weighted(weight)
    tau, state, k = np.zeros(len(items), np.int64), index, 0
    while True:
        state = written(_round(state, q, tau, shares[min(k, len(shares) - 1)], None if k else counts), "lexical-round")
        k += 1
        found = _ranked(_leaders(state, q, top), top)
        if not state.agg(F.sum("open")).first()[0]:
            return q, found
        tau = np.zeros(len(items), np.int64)
        for r in found.where(F.col("rank") == top).select("item", "low").collect():
            tau[r["item"]] = r["low"]


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP, per_pass: int = ITEMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` best documents with a score above 0.

    Items are taken about ``per_pass`` at a time, so what a pass keeps on the
    driver and in a task has a bound, whatever the number of items."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("_id"), F.col(item_text).alias("_text"))
    passes = max(1, math.ceil(asked.count() / per_pass))
    which: Column = F.pmod(F.xxhash64("_id", "_text"), F.lit(passes))
    kind, dkind = items.schema[item_key].dataType, docs.schema[key].dataType
    out = None
    for p in range(passes):
        rows = [(r["_id"], r["_text"]) for r in asked.where(which == p).sort("_id", "_text").collect()]
        q, found = search_pass(docs, rows, key, text, top)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)],
                                      f"item long, item_id {kind.simpleString()}")
        got = found.join(F.broadcast(names), "item").select(  # one row per item of the pass
            "item_id", "rank", F.col("doc").cast(dkind).alias("doc_id"), F.col("low").alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each ``benchmark`` item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
qt AS (SELECT q, item_id, t, count(*) AS times FROM i GROUP BY ALL),
c AS (SELECT count(*) AS n_all, sum(len(ts))::BIGINT AS l_all FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf
      FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT n_all FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t),
s AS (SELECT q, item_id, r, doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score
      FROM p JOIN qt USING (t) JOIN w USING (t), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0) WHERE rank <= 20
"""
