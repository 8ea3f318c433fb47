"""Registered queries: name -> Spark plan builder, plus its SQL oracle text.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables.  The oracle text is standard SQL for DuckDB over the
same tables; queries without one (model fits, streams) are checked on row
counts and by the pytest suite.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that the registry is filled."""
    from sentiforge.plans import (  # noqa: F401
        q_clean, q_stats, q_labels, q_lang, q_sampling, q_tfidf, q_noise, q_lmprep, q_models, q_stream, q_bpe, q_sources, q_scoring,
    )
