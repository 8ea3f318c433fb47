"""Label encoding, decoding and dictionary maps.

The class list is tiny, so encodings are either literal maps (known class
lists) or a ranked distinct-label table broadcast back onto the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def class_table(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, id)``: distinct labels, ids in lexicographic order (0-based)."""
    distinct = df.select(F.col(label_col).alias("_lab")).where(F.col("_lab").isNotNull()).distinct()
    # one row per class: this window runs on K rows only
    w = Window.orderBy("_lab")
    return distinct.select(F.col("_lab").alias(label_col), (F.dense_rank().over(w) - 1).cast("int").alias("_id"))


def label_encode(df: DataFrame, label_col: str, out_col: str = "label_id") -> DataFrame:
    """Lexicographic integer ids learnt from the data (negative=0, neutral=1, ...).

    The class table has one row per class, which Spark broadcasts by its measured
    size; a label column that turns out to be a key is joined by a shuffle.
    """
    classes = class_table(df, label_col)
    return df.join(classes, label_col, "left").withColumnRenamed("_id", out_col)


def encode_fixed(df: DataFrame, label_col: str, classes: Sequence[str], out_col: str = "label") -> DataFrame:
    """Encode with a known class list (position = id); null stays null, an unknown label raises."""
    known = map_values(F.col(label_col), {c: i for i, c in enumerate(classes)})
    unknown = F.col(label_col).isNotNull() & known.isNull()
    error = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label_col).cast("string")))
    return df.withColumn(out_col, F.when(unknown, error.cast("int")).otherwise(known))


def decode_fixed(col: Column, classes: Sequence[str]) -> Column:
    """Inverse of ``encode_fixed``; out-of-range ids -> null."""
    return F.try_element_at(F.array(*[F.lit(c) for c in classes]), col + 1)


def map_values(col: Column, mapping: dict) -> Column:
    """Dictionary map; keys missing from the dictionary give null."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v)))
    return expr


def join_counted(preds: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """``preds`` joined with ``gold``, and the counts ``matched, missing_gold, missing_prediction`` of the join.

    One full outer join gives both: its rows are counted as they pass (the observation is
    filled by the first action on the result), then the unmatched ones are dropped."""
    seen = Observation()
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    both = preds.withColumn("_a", F.lit(1)).join(gold.withColumn("_b", F.lit(1)), key, "full")
    both = both.observe(seen, F.count_if(a & b).alias("matched"), F.count_if(a & ~b).alias("missing_gold"),
                        F.count_if(~a & b).alias("missing_prediction"))
    return both.where(a & b).drop("_a", "_b"), seen
