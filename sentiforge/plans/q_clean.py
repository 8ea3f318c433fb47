"""Cleaning family: tweet cleaners, normaliser, accents, whitespace tokens,
line splitting and JSON field access."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import tweets, with_sql
from sentiforge.sources.tables import table


def _clean_sql(rule_list):
    return with_sql("tweets", f"SELECT uid, {S.rules('text', rule_list)} AS clean_text FROM tweets")


@register("clean_mark", _clean_sql(T.MARK_RULES))
def clean_mark(spark, sf):
    return tweets(spark, sf).select("uid", T.clean_mark(F.col("text")).alias("clean_text"))


@register("clean_glue", _clean_sql(T.GLUE_RULES))
def clean_glue(spark, sf):
    return tweets(spark, sf).select("uid", T.clean_glue(F.col("text")).alias("clean_text"))


@register("clean_strip", _clean_sql(T.STRIP_RULES))
def clean_strip(spark, sf):
    return tweets(spark, sf).select("uid", T.clean_strip(F.col("text")).alias("clean_text"))


@register("normalise_text", with_sql(
    "tweets", f"SELECT uid, {S.normalise(S.rules('text', T.STRIP_RULES))} AS clean_text FROM tweets"))
def normalise_text(spark, sf):
    """Variant C in full (regex part + normaliser, without the stemmer)."""
    return tweets(spark, sf).select("uid", T.normalise(T.clean_strip(F.col("text"))).alias("clean_text"))


@register("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("text"))


@register("split_tokens", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS joined
FROM (SELECT doc_id, {S.split_ws('text')} AS toks FROM documents)""")
def split_tokens(spark, sf):
    toks = T.split_ws(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("joined"))


@register("long_texts", f"""
SELECT conv_id, turn, CAST(len(toks) AS INTEGER) AS n_tokens
FROM (SELECT conv_id, turn, {S.split_ws('text')} AS toks FROM conversations) WHERE len(toks) > 1""")
def long_texts(spark, sf):
    """Texts with more than one whitespace token."""
    return (table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.split_ws(F.col("text"))).alias("n_tokens"))
            .where(F.col("n_tokens") > 1))


@register("nonblank_lines", f"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
WHERE {S.has_nonspace('line')}""")
def nonblank_lines(spark, sf):
    """One row per line holding a non-blank character (empty and blank-only lines dropped)."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(T.NONSPACE))


@register("json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", T.json_field(F.col("props"), "$.k").try_cast("int").alias("k"))


@register("normalise_stemmed")
def normalise_stemmed(spark, sf):
    """Variant C in full including the Porter stemmer (no SQL stemmer: rows check)."""
    return tweets(spark, sf).select("uid", T.normalise(T.clean_strip(F.col("text")), stem=True).alias("clean_text"))
