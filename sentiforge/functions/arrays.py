"""Array-valued column functions: score vectors and id sequences.

All are higher-order SQL functions evaluated inside the row, so they add no
shuffle and stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum (ties -> lowest index)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of a double array."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def margin_to(scores: Column, label: Column, j: Column) -> Column:
    """``p_j - p_label`` for a 0-based class ``j``."""
    return F.get(scores, j) - F.get(scores, label)


def normalized_margin(scores: Column, label: Column) -> Column:
    """``p_label - max_{j != label} p_j``: negative when another class wins."""
    others = F.filter(scores, lambda x, i: i != label)
    return F.get(scores, label) - F.array_max(others)


def pad_truncate(ids: Column, length: int, pad: int = 0) -> Column:
    """Keep the first ``length`` ids and pad on the right with ``pad``."""
    head = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(head), F.lit(0)))
    return F.concat(head, fill)


def attention_mask(ids: Column, pad: int = 0) -> Column:
    """1 where the id is not the pad id, else 0."""
    return F.transform(ids, lambda x: (x != F.lit(pad)).cast("int"))


def join_ints(ids: Column, sep: str = " ") -> Column:
    """Render an int array as text (stable form for files and value checks)."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), sep)
