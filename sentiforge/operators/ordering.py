"""Positions, ranks and top-k without single-task windows.

A window with no (or a low-cardinality) ``partitionBy`` runs in one task.
``row_index`` gives every row its 0-based position in a global (or
per-group) order with bounded tasks: rows are cut into ranges of the order
key, the range totals get a running sum (itself computed over coarser
ranges, so no task holds more than a few thousand totals), and the
position is that offset plus the row number inside the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sentiforge.scratch import written


def _running_offsets(totals: DataFrame, parts: Sequence[str], bcol: str, wcol: str,
                     fanout: int = 4096, depth: int = 2) -> DataFrame:
    """``(*parts, bcol, _off)``: exclusive running sum of ``wcol`` in ``bcol`` order.

    ``totals`` has one row per (group, bucket) and ``bcol`` is a non-negative
    long.  Buckets are grouped ``fanout`` at a time into coarser buckets,
    ``depth`` levels deep, so no window task sees more than ``fanout`` rows of
    a level (enough for 4096^3 buckets per group at the default)."""
    if depth == 0:
        w = Window.partitionBy(*parts).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*parts, bcol, F.coalesce(F.sum(wcol).over(w), F.lit(0)).alias("_off"))
    c = f"_c{depth}"  # one coarse column per level: the next level's bucket column is this one
    t = totals.withColumn(c, F.floor(F.col(bcol) / F.lit(fanout)))
    coarse = t.groupBy(*parts, c).agg(F.sum(wcol).alias("_cw"))
    coff = _running_offsets(coarse, parts, c, "_cw", fanout, depth - 1).withColumnRenamed("_off", "_coff")
    w = Window.partitionBy(*parts, c).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    inner = t.select(*parts, bcol, c, F.coalesce(F.sum(wcol).over(w), F.lit(0)).alias("_ioff"))
    return inner.join(coff, [*parts, c]).select(*parts, bcol, (F.col("_coff") + F.col("_ioff")).alias("_off"))


def row_index(df: DataFrame, order_key: str | Column, tiebreak: Sequence[str] = (),
              partition_cols: Sequence[str] = (), bucket_width: int = 1 << 14,
              name: str = "row_ix", fanout: int = 4096) -> DataFrame:
    """Add ``name`` = 0-based position of the row ordered by (order_key, *tiebreak)
    within ``partition_cols``.

    ``order_key`` must be a non-negative integer column; rows with equal
    ``floor(order_key / bucket_width)`` share one window task, so choose the
    width such that a range holds a bounded number of rows (ids: any width;
    32-bit hashes: 2^12..2^16).
    """
    key = F.col(order_key) if isinstance(order_key, str) else order_key
    parts = list(partition_cols)
    keyed = df.withColumn("_ok", key).withColumn("_b", F.floor(F.col("_ok") / F.lit(bucket_width)))
    totals = keyed.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _running_offsets(totals, parts, "_b", "_n", fanout)
    inside = Window.partitionBy(*parts, "_b").orderBy("_ok", *tiebreak)
    return (keyed.join(offsets, [*parts, "_b"])
            .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_off")).cast("long"))
            .drop("_ok", "_b", "_off"))


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          rank_name: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (ties broken by the order list).

    ``row_number() <= k`` with a literal k is planned by Spark as a partial
    ``WindowGroupLimit`` before the exchange, so a hot group sends at most k
    rows per map task through the shuffle.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= k)


def _digits(col: Column, total_bits: int, digit_bits: int) -> list[Column]:
    """Base-2^digit_bits digits of a non-negative long, most significant first."""
    shifts = list(range(max(total_bits - digit_bits, 0), -1, -digit_bits))
    if shifts[-1] != 0:
        shifts.append(0)
    out = [F.shiftright(col, shifts[0])]
    prev = shifts[0]
    for s in shifts[1:]:
        out.append(F.shiftright(col, s).bitwiseAND(F.lit((1 << (prev - s)) - 1)))
        prev = s
    return out


def _small(spark, rows, key_schema: StructType, extra: list[str]) -> DataFrame:
    fields = list(key_schema.fields) + [StructField(x, LongType()) for x in extra]
    return spark.createDataFrame(rows, StructType(fields))


def first_n_per_group(df: DataFrame, group_cols: Sequence[str], n_col: str, key: Column, uid: str,
                      rest: Column | None = None, key_bits: int = 49, rest_bits: int = 63, uid_bits: int = 63,
                      digit_bits: int = 12, exact_rows: int = 1 << 18) -> DataFrame:
    """Rows among the first ``n_col`` of their group in (key asc, rest asc, uid asc) order.

    ``key``, ``rest`` and ``uid`` must be non-negative longs below 2^key_bits / 2^rest_bits / 2^uid_bits;
    ``n_col`` is constant within a group.  Exact, and no task holds a whole
    group: a radix select.  Each pass counts the undecided rows per (group,
    digit) with map-side partial counts; a window over that small histogram
    finds the digit where the running count reaches the rows still needed.
    Rows below that digit are taken, rows above it dropped, and only the
    boundary digit goes on to the next pass.  Once every boundary bucket
    holds at most ``exact_rows`` rows, a ``row_number`` window over those
    buckets finishes the cut.  Only cut points (one row per group) reach the
    driver; the input is written once (scratch table) so passes do not recompute it.
    """
    g = list(group_cols)
    spark = df.sparkSession
    low = F.lit(0) if rest is None else rest
    base = written(df.withColumns({"_k": key.cast("long"), "_r": low.cast("long"), "_u": F.col(uid).cast("long")}), "select")
    kschema = base.select(*g).schema
    digits = _digits(F.col("_k"), key_bits, digit_bits) + _digits(F.col("_u"), uid_bits, digit_bits)
    if rest is not None:
        digits = (_digits(F.col("_k"), key_bits, digit_bits) + _digits(F.col("_r"), rest_bits, digit_bits)
                  + _digits(F.col("_u"), uid_bits, digit_bits))
    need = (base.groupBy(*g).agg(F.max(n_col).cast("long").alias("_need"), F.count(F.lit(1)).alias("_have"))
            .where(F.col("_need") > 0).collect())
    taken: list[DataFrame] = []
    whole = [tuple(r[c] for c in g) for r in need if r["_have"] <= r["_need"]]
    if whole:
        taken.append(base.join(F.broadcast(_small(spark, whole, kschema, [])), g, "left_semi"))
    state = {tuple(r[c] for c in g): (int(r["_need"]), int(r["_have"])) for r in need if r["_have"] > r["_need"]}
    cand = base
    for d in digits:
        if not state or max(h for _, h in state.values()) <= exact_rows:
            break
        st = _small(spark, [(*k, v[0]) for k, v in state.items()], kschema, ["_need"])
        c = cand.join(F.broadcast(st), g, "left_semi")
        hist = c.groupBy(*g, d.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*g).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = hist.join(F.broadcast(st), g).withColumn("_cum", F.sum("_c").over(w))
        cut = (cum.where(F.col("_cum") >= F.col("_need")).groupBy(*g)
               .agg(F.min_by(F.struct("_d", (F.col("_cum") - F.col("_c")).alias("_before"), "_c", "_need"),
                             F.col("_d")).alias("s"))
               .select(*g, "s.*").collect())
        cut_df = _small(spark, [(*(r[x] for x in g), int(r["_d"])) for r in cut], kschema, ["_cut"])
        cd = c.join(F.broadcast(cut_df), g)
        taken.append(cd.where(d < F.col("_cut")).drop("_cut"))
        new_state, full = {}, []
        for r in cut:
            k = tuple(r[x] for x in g)
            left = int(r["_need"]) - int(r["_before"])
            if left == int(r["_c"]):
                full.append(k)
            else:
                new_state[k] = (left, int(r["_c"]))
        if full:
            taken.append(cd.where(d == F.col("_cut")).drop("_cut")
                         .join(F.broadcast(_small(spark, full, kschema, [])), g, "left_semi"))
        cand = cd.where(d == F.col("_cut")).drop("_cut")
        state = new_state
    if state:
        st = _small(spark, [(*k, v[0]) for k, v in state.items()], kschema, ["_need"])
        w = Window.partitionBy(*g).orderBy("_k", "_r", "_u")
        taken.append(cand.join(F.broadcast(st), g).withColumn("_rn", F.row_number().over(w))
                     .where(F.col("_rn") <= F.col("_need")).drop("_rn", "_need"))
    out = base.limit(0).select(*df.columns)
    for t in taken:
        out = out.unionByName(t.select(*df.columns))
    return out


def dense_index(df: DataFrame, bucket_exprs: Sequence[Column], order: Sequence[Column],
                name: str = "ix") -> DataFrame:
    """0-based position in the order (buckets ascending, then ``order``).

    The bucket expressions must be consistent with the order (every row of
    a smaller bucket comes first), e.g. ``(-count, substring(word, 1, 2))``
    for "count desc, word asc".  Each window task holds one bucket; bucket
    offsets are running sums taken level by level (over the distinct counts,
    then over the prefixes of one count), never over all buckets at once.
    """
    keyed = df.select("*", *[e.alias(f"_b{i}") for i, e in enumerate(bucket_exprs)])
    bcols = [f"_b{i}" for i in range(len(bucket_exprs))]
    totals = keyed.groupBy(*bcols).agg(F.count(F.lit(1)).alias("_n"))
    # offsets level by level: a window over the distinct values of the first
    # bucket column, then one per value over the next column, and so on
    offsets = totals.select(*bcols, F.lit(0).cast("long").alias("_off"))
    for i in range(len(bcols)):
        head, col = bcols[:i], bcols[i]
        lvl = totals.groupBy(*head, col).agg(F.sum("_n").alias("_t"))
        w = Window.partitionBy(*head).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
        lvl = lvl.select(*head, col, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias(f"_o{i}"))
        offsets = offsets.join(lvl, [*head, col]).withColumn("_off", F.col("_off") + F.col(f"_o{i}")).drop(f"_o{i}")
    inside = Window.partitionBy(*bcols).orderBy(*order)
    return (keyed.join(offsets, bcols)
            .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_off")).cast("long"))
            .drop(*bcols, "_off"))


def range_index(df: DataFrame, order: Sequence[Column], name: str = "ix") -> DataFrame:
    """Add ``name`` = 0-based position in ``order``, which must be a total order of the rows.

    The rows are dealt to ranges of the order that Spark samples (equally full, however
    skewed their beginnings are), sorted and numbered inside, and written; one count per
    range (as many as shuffle partitions) gives the offsets."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = written(cut, "index").withColumn("_p", F.shiftright("_id", 33))
    ranges = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)   # over one row per range
    ranges = ranges.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id") - F.shiftleft(F.col("_p"), 33)
    return held.join(F.broadcast(ranges), "_p").withColumn(name, F.col("_off") + local).drop("_p", "_id", "_off")


def prefix_sum(df: DataFrame, order_key: str, tiebreak: Sequence[str], weight: str,
               bucket_width: int = 64, name: str = "offset", fanout: int = 4096) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows before this one in
    (order_key, *tiebreak) order.  ``order_key`` is a non-negative integer;
    rows with equal ``floor(order_key / bucket_width)`` share one window task
    and bucket offsets come from the small table of bucket totals."""
    keyed = df.withColumn("_b", F.floor(F.col(order_key) / F.lit(bucket_width)))
    totals = keyed.groupBy("_b").agg(F.sum(weight).alias("_t"))
    offsets = _running_offsets(totals, [], "_b", "_t", fanout)
    inside = (Window.partitionBy("_b").orderBy(order_key, *tiebreak)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (keyed.join(offsets, "_b")
            .withColumn(name, (F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_off")).cast("long"))
            .drop("_b", "_off"))
