"""Approximate nearest neighbours by collision counting (operator 10).

Blocks hold vectors of nearly equal length (the vectors in order of length, cut).
With M the largest length of a block, inner products become distances by one more
coordinate, ``sqrt(M^2 - |x|^2)``, and a query is scaled to length M.  Every block is
projected on single lines (the rows of random rotations) and each line keeps the
block's order: its sorted array.  A query looks at a window around its own
projection on every line, all of the same half-width; a vector inside at least
``threshold`` of the windows is a candidate, and candidates are verified exactly.

First a query visits the ``FIRST`` blocks of the longest vectors: windows widen step by
step (virtual rehashing: wider windows of the same arrays, no new index) until they
hold k + 1 candidates and ``SHARE`` of the block.  The k-th best score tau found there
bounds the answer.  Then it visits every block that can hold a better vector
(M |q| >= tau), with the windows of radius ``R^2 = 2 M^2 - 2 tau M / |q|``: a vector as good
as tau is no farther than R, so it collides on a line with probability ``P_LINE`` and
misses the threshold in less than one case of a hundred, whatever the lengths.

Counting is done for many queries at once: the ends of windows snap outwards to
cuts of the sorted arrays, the vectors before a cut are a bitmap, a window is
the difference of two, and bitmaps are added by carry-save adders.

The index is a written table with a row per block; equal vectors are indexed
once, by their k + 1 smallest ids (no other can be among k nearest).  Queries are a
stated set, sent to the blocks they need in parts of ``PART``, each block copied per
part; a visit returns k + 1 rows.  Every vector is indexed, none is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiforge.llm.shared import written
from sentiforge.operators.ordering import range_index, top_k

LINES = 128
THRESHOLD = 0.75   # share of lines
P_LINE = 1.405     # half-width in standard deviations of a projected distance: 84 of 100 lines collide
SHARE = 0.01       # of a block's vectors, verified at least on the first visit
FIRST = 3          # blocks of the first visit
BLOCK = 8192       # vectors of an index block
QUERIES = 512      # queries counted at a time
PART = 16384       # queries of one task
CUTS = 256
LEVELS = 40
WIDEN = 1.2
SEED = 11


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)``: rows that take part, each once; vectors of a length other
    than the commonest (ties: the longest) are not comparable and take no part."""
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
            .where("key IS NOT NULL AND v IS NOT NULL").where(~bad & F.exists("v", lambda x: x != 0)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (length[0]["d"] if length else 0)).dropDuplicates(["key", "v"])


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 0))


def lines(dim: int, n: int = LINES, seed: int = SEED) -> np.ndarray:
    """(dim, n) unit directions: rows of as many random rotations as needed."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-n // dim))], axis=1)[:, :n]


def _lift(x: np.ndarray, radius: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(radius ** 2 - (x ** 2).sum(axis=1), 0))])


def build_index(classes: DataFrame, dim: int, n_lines: int = LINES) -> DataFrame:
    """Written ``(block, radius, ids, vectors, orders)`` from ``(rep, v, norm)``: blocks in order of length."""
    def run(batches: Iterator[pa.RecordBatch]):
        a = lines(dim + 1, n_lines)
        held, at = [], None

        def row():
            ids = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            radius = float(np.sqrt((x ** 2).sum(axis=1).max()))
            order = np.argsort(_lift(x, radius) @ a, axis=0, kind="stable").T.astype("<u4")
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([radius]), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                                    pa.array([x.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())],
                                   names=["block", "radius", "ids", "vectors", "orders"])

        for b in batches:
            block, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2))
            for run_ in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if not len(run_):
                    continue
                if block[run_[0]] != at and held:
                    yield row()
                    held = []
                at = int(block[run_[0]])
                held.append((ids[run_], x[run_]))
        if held:
            yield row()

    placed = range_index(classes.select("rep", "v", "norm"), [F.col("norm"), F.col("rep")], "_ix")
    placed = placed.select(F.floor(F.col("_ix") / BLOCK).cast("int").alias("block"), "rep", "v")
    return written(placed.repartition("block").sortWithinPartitions("block", "rep")
                   .mapInArrow(run, "block int, radius double, ids binary, vectors binary, orders binary"), "index")


class _Block:
    """One index block, ready for counting."""

    def __init__(self, ids: bytes, vectors: bytes, orders: bytes, dim: int, radius: float, n_lines: int = LINES):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.n, self.radius = len(self.ids), radius
        order = np.frombuffer(orders, "<u4").reshape(n_lines, self.n).astype(np.int64)
        self.lines = lines(dim + 1, n_lines)
        value = np.take_along_axis((_lift(self.x, radius) @ self.lines).T, order, axis=1)
        self.spread = float(value.std(axis=1).mean()) or 1.0
        at = np.unique(np.linspace(0, self.n, min(CUTS, self.n) + 1).astype(np.int64))
        words = -(-self.n // 64)
        self.before = np.zeros((n_lines, len(at), words), dtype=np.uint64)  # vectors before each cut, as bits
        rank = np.empty(self.n, dtype=np.int64)
        for j in range(n_lines):
            rank[order[j]] = np.arange(self.n)
            bits = np.packbits(rank[None, :] < at[:, None], axis=1, bitorder="little")
            full = np.zeros((len(at), words * 8), dtype=np.uint8)
            full[:, :bits.shape[1]] = bits
            self.before[j] = full.view(np.uint64)
        # a window reaches down to the last cut not above it, up to the first not below it
        self.cut_value = value[:, np.minimum(at[:-1], self.n - 1)]

    def candidates(self, proj: np.ndarray, half: np.ndarray, need: int) -> np.ndarray:
        """Bits of the vectors that collide with each query on ``need`` lines or more, in windows of ``half`` each way."""
        buckets: list[list[np.ndarray]] = [[]]

        def add(x, weight):
            while True:
                if weight == len(buckets):
                    buckets.append([])
                buckets[weight].append(x)
                if len(buckets[weight]) < 3:
                    return
                a, b, c = buckets[weight]
                u = a ^ b
                buckets[weight] = [u ^ c]
                x, weight = (a & b) | (u & c), weight + 1

        for j in range(len(self.before)):
            lo = np.maximum(np.searchsorted(self.cut_value[j], proj[:, j] - half, side="right") - 1, 0)
            hi = np.searchsorted(self.cut_value[j], proj[:, j] + half, side="right")
            add(self.before[j][hi] ^ self.before[j][lo], 0)
        weight = 0
        while weight < len(buckets):
            while len(buckets[weight]) > 1:
                a, b = buckets[weight].pop(), buckets[weight].pop()
                buckets[weight].append(a ^ b)
                add(a & b, weight + 1)
            weight += 1
        equal = np.full_like(buckets[0][0], ~np.uint64(0))
        more = np.zeros_like(equal)
        for weight in range(len(buckets) - 1, -1, -1):
            plane = buckets[weight][0] if buckets[weight] else np.zeros_like(equal)
            if need >> weight & 1:
                equal &= plane
            else:
                more |= equal & plane
                equal &= ~plane
        return more | equal

    def _projected(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.radius / np.sqrt((q ** 2).sum(axis=1)))[:, None]
        return np.column_stack([scaled, np.zeros(len(q))]) @ self.lines

    def _numbers(self, row: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little", count=self.n))

    def within(self, q: np.ndarray, tau: np.ndarray) -> list[np.ndarray]:
        """Candidates that may score ``tau`` or more, per query (no bound: every vector)."""
        length = np.sqrt((q ** 2).sum(axis=1))
        bound = np.maximum(tau, -self.radius * length)
        reach = np.sqrt(np.maximum(2 * self.radius ** 2 - 2 * bound * self.radius / length, 0))
        half = P_LINE * reach / np.sqrt(self.lines.shape[0]) + 1e-9 * self.radius
        bits = self.candidates(self._projected(q), half, int(np.ceil(THRESHOLD * len(self.before))))
        every = np.arange(self.n)
        return [every if t == -np.inf else self._numbers(row) for t, row in zip(tau, bits)]

    def first(self, q: np.ndarray, k: int, hint: int) -> tuple[list[np.ndarray], int]:
        """Candidate numbers per query, at the narrowest windows that give enough of them."""
        proj = self._projected(q)
        need = int(np.ceil(THRESHOLD * len(self.before)))
        want = min(self.n, int(np.ceil(SHARE * self.n)) + k + 1)
        low, high = np.full(len(q), -1), np.full(len(q), LEVELS)  # too narrow; wide enough
        found: list = [None] * len(q)
        level = np.full(len(q), min(max(hint, 0), LEVELS - 1))
        todo = np.arange(len(q))
        while len(todo):
            bits = self.candidates(proj[todo], self.spread * 0.02 * WIDEN ** level[todo], need)
            count = np.bitwise_count(bits).sum(axis=1)
            for i, c, row in zip(todo.tolist(), count.tolist(), bits):
                if c >= want:
                    high[i], found[i] = level[i], row
                else:
                    low[i] = level[i]
            todo = todo[(high[todo] - low[todo] > 1)]
            # next to the known side first, then by halves
            step = np.where(high[todo] == LEVELS, low[todo] + 1, np.where(low[todo] == -1, high[todo] - 1,
                                                                        (low[todo] + high[todo]) // 2))
            level[todo] = step
        out = [np.arange(self.n) if row is None else self._numbers(row) for row in found]  # None: even the widest windows hold too few
        return out, int(np.median(high)) if len(high) else hint


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in order of the coordinates."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def _verify(block: _Block, q: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough = block.x[cand] @ q
    if len(cand) > k:
        edge = np.partition(rough, len(cand) - k)[len(cand) - k]
        cand = cand[rough >= edge - 1e-9 * block.radius * float(np.sqrt(q @ q))]   # the sums differ by rounding only
    score = inner_products(block.x[cand], q)
    best = np.lexsort((block.ids[cand], -score))[:k]
    return block.ids[cand[best]], score[best]


def search_blocks(index: DataFrame, asked: DataFrame, blocks: int, n_queries: int, dim: int, k: int) -> DataFrame:
    """``(q, rep, score)``: the k + 1 best classes found for every visit ``(block, rep, v, tau)``.

    A null ``tau`` is a first visit."""
    def run(batches: Iterator[pa.RecordBatch]):
        block, at, hint = None, None, 20
        held: list = []

        def answered():
            nonlocal hint
            ids, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            tau = np.concatenate([h[2] for h in held])
            for i in range(0, len(ids), QUERIES):
                part = slice(i, i + QUERIES)
                if np.isnan(tau[part]).any():
                    found, hint = block.first(q[part], k, hint)
                else:
                    found = block.within(q[part], tau[part])
                got = [_verify(block, x, c, k + 1) for x, c in zip(q[part], found)]
                yield pa.record_batch([pa.array(np.repeat(ids[part], [len(g[0]) for g in got])),
                                       pa.array(np.concatenate([g[0] for g in got])),
                                       pa.array(np.concatenate([g[1] for g in got]))], names=["q", "rep", "score"])

        for b in batches:
            place, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            for run_ in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) | np.diff(kind)) + 1):
                if not len(run_):
                    continue
                if place[run_[0]] != at and held:
                    yield from answered()
                    held = []
                if kind[run_[0]] == 0:
                    i, at = int(run_[0]), int(place[run_[0]])
                    block = _Block(*(b.column(c)[i].as_py() for c in ("ids", "vectors", "orders")), dim, b.column("radius")[i].as_py())
                elif place[run_[0]] == at:
                    part = b.slice(run_[0], len(run_))
                    held.append((np.asarray(part.column("rep")), _matrix(part.column("v")),
                                 np.asarray(part.column("tau").fill_null(np.nan))))
        if held:
            yield from answered()

    parts = -(-max(1, n_queries) // PART)
    none = lambda t: F.lit(None).cast(t)
    copies = index.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.col("block") * parts + p)).alias("place"),
                           F.lit(0).alias("kind"), "radius", "ids", "vectors", "orders",
                           none("long").alias("rep"), none("array<double>").alias("v"), none("double").alias("tau"))
    visits = asked.select((F.col("block") * parts + F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")).alias("place"), F.lit(1).alias("kind"),
                          none("double").alias("radius"), *[none("binary").alias(c) for c in ("ids", "vectors", "orders")], "rep", "v", "tau")
    return (copies.union(visits).repartitionById(blocks * parts, F.col("place")).sortWithinPartitions("place", "kind")
            .mapInArrow(run, "q long, rep long, score double"))


def _visits(queries: DataFrame, radii: np.ndarray, first: bool) -> DataFrame:
    """``(block, rep, v, tau)``: the blocks that each query ``(rep, v, norm, tau)`` is sent to.

    First ``FIRST`` blocks of the longest vectors (of those equally long, which ones goes by
    the query), then all blocks whose longest vector can reach tau."""
    def run(batches: Iterator[pa.RecordBatch]):
        longest = np.sort(radii)[::-1][:FIRST].min()
        ends = np.flatnonzero(radii >= longest * (1 - 1e-9))
        for b in batches:
            rep, norm, tau = (np.asarray(b.column(c).fill_null(0)) for c in ("rep", "norm", "tau"))
            for i in range(0, len(rep), QUERIES):
                part = np.arange(i, min(i + QUERIES, len(rep)))
                if first:
                    turn = (rep[part, None] + np.arange(min(FIRST, len(ends)))) % len(ends)
                    row, block = np.repeat(part, turn.shape[1]), ends[turn].ravel()
                else:
                    row, block = np.nonzero(radii[None, :] * norm[part, None] * (1 + 1e-9) >= tau[part, None])
                    row = part[row]
                at = pa.array(row)
                yield pa.record_batch([pa.array(block.astype(np.int32)), b.column("rep").take(at), b.column("v").take(at),
                                       b.column("tau").take(at)], names=["block", "rep", "v", "tau"])

    return queries.select("rep", "v", "norm", "tau").mapInArrow(run, "block int, rep long, v array<double>, tau double")


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for every row for
    which ``is_query`` (a column over ``key``) holds, among all rows of another key.

    Nearness is the inner product in double precision, ties go to the smaller
    key; rows alike in key and vector count once.  Null, zero and non-finite
    vectors and null keys take no part."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = written(usable(vectors, key, vector).withColumn("norm", F.sqrt(square)), "vectors")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    spark = vectors.sparkSession
    if not got["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = got["d"]
    members = top_k(rows, ["v"], [F.col("key")], k + 1, "_r").drop("_r")
    classes = written(members.groupBy("v", "norm").agg(F.sort_array(F.collect_list("key")).alias("keys"))
                      .select("v", "norm", "keys", F.col("keys")[0].alias("rep")), "classes")
    index = build_index(classes, dim)
    asked = rows.where(is_query).join(classes.select("v", "rep"), "v").select("key", "rep")
    queries = written(rows.where(is_query).select("v").distinct().join(classes.select("v", "rep", "norm"), "v"), "queries")
    n_queries = queries.count()
    ball = index.select("block", "radius").orderBy("block").collect()      # two numbers per BLOCK vectors
    blocks, radii = len(ball), np.array([r["radius"] for r in ball])
    first = _visits(queries.withColumn("tau", F.lit(None).cast("double")), radii, first=True)
    best = top_k(search_blocks(index, first, blocks, n_queries, dim, k), ["q"], [F.desc("score"), F.col("rep")], k + 1, "_r")
    tau = best.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("tau"))
    bounded = written(queries.join(tau, F.col("rep") == F.col("q"), "left").select(
        "rep", "v", "norm", F.coalesce("tau", F.lit(float("-inf"))).alias("tau")), "bounded")
    visits = _visits(bounded, radii, first=False)
    found = written(top_k(search_blocks(index, visits, blocks, n_queries, dim, k), ["q"],
                          [F.desc("score"), F.col("rep")], k + 1, "_r").drop("_r"), "found")
    each = found.join(classes.select("rep", "keys"), "rep").select("q", F.explode("keys").alias("vec_id"), "score")
    order = [F.desc("score"), F.col("vec_id")]
    each = top_k(each, ["q"], order, k + 1, "_r").drop("_r")  # one more: a query's own row is among them
    mine = asked.join(each, F.col("rep") == F.col("q")).where("key <> vec_id").withColumnRenamed("key", "query_id")
    return top_k(mine, ["query_id"], order, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, against all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("key") % 20 == 0)
