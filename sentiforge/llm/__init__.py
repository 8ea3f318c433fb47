"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``load()`` fills
``QUERIES`` (name -> ``(spark, sf_dir) -> DataFrame``) and ``ORACLE``
(name -> DuckDB SQL, where SQL can express the result).
"""

from __future__ import annotations


def load():
    """``(queries, oracle_sql)`` of the numbered operators and the pipeline."""
    from sentiforge.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLE)
