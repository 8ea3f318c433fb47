"""Readers and sinks as queries: tables written in a file format and read back equal the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.scratch import scratch_path, written
from sentiforge.sources import readers, sinks
from sentiforge.sources.tables import table

BREAKS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}
SPLIT = 4 << 20     # bytes of a range


@register("records_round_trip", f"""WITH t AS (SELECT doc_id, lang, coalesce({S.split_ws('text')}, []) AS toks FROM documents)
SELECT b AS line_break, doc_id AS uid, coalesce(lang, '') AS sentiment, len(toks) AS n_tokens, array_to_string(toks, ' ') AS text
FROM t, (VALUES ('lf'), ('crlf'), ('cr')) v(b)""")
def records_round_trip(spark, sf):
    """Every document as a blank-line separated record, once per kind of line end, read back in byte ranges."""
    toks = F.coalesce(T.split_ws(F.col("text")), F.array().cast("array<string>"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.col("lang").alias("sentiment"), toks.alias("tokens"))
    docs = written(docs, "record-tokens")     # three files are made of them
    out = []
    for name, br in BREAKS.items():
        path = scratch_path(spark, f"records-{name}")
        sinks.write_records(docs, path, br)
        got = readers.annotated_records(spark, path, split_bytes=SPLIT)
        out.append(got.select(F.lit(name).alias("line_break"), "uid", "sentiment",
                              F.size("tokens").cast("long").alias("n_tokens"), "text"))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("result_round_trip", """SELECT 'max_chars' AS metric, max(length(text))::DOUBLE AS value FROM documents
UNION ALL SELECT 'mean_chars', round(avg(length(text)), 3) FROM documents UNION ALL SELECT 'n_rows', count(*)::DOUBLE FROM documents""")
def result_round_trip(spark, sf):
    """Metrics of the corpus written as a result file (``name = value``) and read back."""
    d = table(spark, sf, "documents").agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"), F.round(F.avg(F.length("text")), 3).alias("mean_chars"),
        F.max(F.length("text")).cast("double").alias("max_chars"))
    path = scratch_path(spark, "result")
    sinks.write_result(sinks.metrics_from(d, "corpus", 0).select("metric", "value"), path)
    return sinks.read_result(spark, path)


@register("feature_cache", f"""SELECT doc_id, len({S.split_ws('coalesce(text, chr(0))')}) - CASE WHEN text IS NULL THEN 1 ELSE 0 END AS n_tokens FROM documents""")
def feature_cache(spark, sf):
    """A feature table stored under a key of its inputs and settings; the second call reads what the first wrote."""
    n = F.coalesce(F.size(T.split_ws(F.col("text"))), F.lit(0)).cast("long")
    feats = table(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_tokens"))
    path = sinks.cache_path(scratch_path(spark, "cache"), [sf], {"tokens": "whitespace"})
    sinks.cached(spark, feats, path)
    return sinks.cached(spark, feats.limit(0), path)
