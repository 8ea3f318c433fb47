"""Deterministic pseudo-randomness from row keys.

``rand()`` and ``randomSplit`` give different answers after a task retry or
a repartition.  Everything random here is a function of (seed, key): an md5
of the joined parts, whose leading hex digits become an integer or a
uniform in [0, 1).  The same value is reproducible in any SQL engine that
has md5, which is what the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))


def md5_key(*parts) -> Column:
    """md5 hex of the parts joined with ``|``."""
    return F.md5(F.concat_ws("|", *[_col(p) for p in parts]))


def hex_int(hexcol: Column, start: int, ndigits: int) -> Column:
    """Integer value of ``ndigits`` hex digits starting at 1-based ``start``."""
    return F.conv(F.substring(hexcol, start, ndigits), 16, 10).cast("long")


def hash_int(*parts, ndigits: int = 8) -> Column:
    """Non-negative integer from the first ``ndigits`` hex digits of the md5."""
    return hex_int(md5_key(*parts), 1, ndigits)


def uniform(*parts, start: int = 1) -> Column:
    """Uniform double in [0, 1) from 8 hex digits of the md5."""
    return hex_int(md5_key(*parts), start, 8) / F.lit(4294967296.0)
