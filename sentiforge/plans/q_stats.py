"""Corpus statistics, slices, unions and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.operators import stats
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import corpus, labelled, with_sql
from sentiforge.scratch import written
from sentiforge.sources.tables import table


def long_tokens(spark, sf):
    """Whitespace tokens of documents with more than one token, one row each."""
    d = table(spark, sf, "documents").select(T.split_ws(F.col("text")).alias("toks"))
    return d.where(F.size("toks") > 1).select(F.explode("toks").alias("token"))


_TOKENS_SQL = f"""toks AS (SELECT unnest(t) AS token FROM (SELECT {S.split_ws('text')} AS t FROM documents) WHERE len(t) > 1),
freq AS (SELECT token, count(*) AS n FROM toks GROUP BY token)"""


@register("word_freq", f"WITH {_TOKENS_SQL}\nSELECT token, n FROM freq")
def word_freq(spark, sf):
    return stats.freq_table(long_tokens(spark, sf), "token")


@register("word_freq_tail_slice", f"WITH {_TOKENS_SQL}\nSELECT token, n FROM freq ORDER BY n ASC, token DESC LIMIT 10 OFFSET 490")
def word_freq_tail_slice(spark, sf):
    """``most_common()[-500:-490]`` (least common first)."""
    return stats.tail_slice(stats.freq_table(long_tokens(spark, sf), "token"), "token", 500, 490)


@register("vocab_size", f"WITH {_TOKENS_SQL}\nSELECT count(DISTINCT token) AS n_distinct, count(token) AS n_total FROM toks")
def vocab_size(spark, sf):
    return stats.distinct_and_total(long_tokens(spark, sf), "token")


@register("label_distribution", with_sql("labelled", """
SELECT sentiment, label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled), 6) AS share
FROM labelled GROUP BY sentiment, label"""))
def label_distribution(spark, sf):
    lab = labelled(spark, sf)
    total = lab.select(F.count(F.lit(1))).scalar()
    return lab.groupBy("sentiment", "label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.round(F.col("n") / total, 6))


@register("profile_columns", with_sql("corpus", """,
stacked AS (
  SELECT 'text' AS column_name, text AS value FROM corpus UNION ALL
  SELECT 'lang', lang FROM corpus UNION ALL
  SELECT 'sentiment', sentiment FROM corpus),
counts AS (SELECT column_name, value, count(*) AS n FROM stacked WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM counts)
SELECT column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       max(CASE WHEN r = 1 THEN value END) AS top, max(n) AS freq
FROM ranked GROUP BY column_name""".replace("WITH corpus", "WITH corpus")))
def profile_columns(spark, sf):
    return stats.profile_strings(corpus(spark, sf), ["text", "lang", "sentiment"])


@register("freq_profile", f"""WITH {_TOKENS_SQL}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n IS NULL) AS n_missing, count(DISTINCT n) AS n_distinct,
       min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       count(*) FILTER (WHERE n = 1) AS n_ones
FROM freq""")
def freq_profile(spark, sf):
    p = stats.numeric_profile(stats.freq_table(long_tokens(spark, sf), "token"), "n")
    return p.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_UNION_SQL = """
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS sub, length(text) AS n_chars FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, length(text) FROM conversations
UNION ALL SELECT 'benchmark', item_id, CAST(0 AS BIGINT), length(text) FROM benchmark"""


@register("corpus_union", _UNION_SQL)
def corpus_union(spark, sf):
    """Union-all of the text sources with a source tag (corpus assembly)."""
    d = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"),
                                              F.lit(0).cast("long").alias("sub"), "text")
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"),
                                                  F.col("turn").alias("sub"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"),
                                              F.lit(0).cast("long").alias("sub"), "text")
    u = d.unionByName(c).unionByName(b)
    return u.select("source", "id", "sub", F.length("text").cast("long").alias("n_chars"))


@register("corpus_union_missing_cols", with_sql("corpus", """
SELECT uid, 'labelled' AS source, sentiment, length(text) AS n_chars FROM corpus
UNION ALL SELECT item_id, 'benchmark', NULL, length(text) FROM benchmark"""))
def corpus_union_missing_cols(spark, sf):
    """Union by name where one side has no label column (it comes back null)."""
    a = corpus(spark, sf).select("uid", F.lit("labelled").alias("source"), "sentiment", "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"), F.lit("benchmark").alias("source"), "text")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select("uid", "source", "sentiment", F.length("text").cast("long").alias("n_chars"))


def _freq(spark, sf):
    return stats.freq_table(long_tokens(spark, sf), "token")


QUANTILES, BINS, SHOWN = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0], 20, 10


@register("freq_quantiles", f"""WITH {_TOKENS_SQL},
o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS t FROM freq),
q AS (SELECT unnest({[float(q) for q in QUANTILES]})::DOUBLE AS q)
SELECT q, n AS value FROM q JOIN o ON r = greatest(1, CAST(ceil(q * t - 1e-9) AS BIGINT))""")
def freq_quantiles(spark, sf):
    """Exact quantiles of the word frequencies."""
    return stats.exact_quantiles(_freq(spark, sf), "n", QUANTILES)


@register("length_histogram", f"""WITH m AS (SELECT max(length(text))::DOUBLE AS hi FROM documents),
b AS (SELECT least(CAST(floor(length(text) / (hi / {BINS})) AS INTEGER), {BINS - 1}) AS bin, count(*) AS n FROM documents, m WHERE text IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(i * (hi / {BINS}), 6) AS lower, round((i + 1) * (hi / {BINS}), 6) AS upper, coalesce(n, 0) AS n
FROM (SELECT unnest(range({BINS})) AS i), m LEFT JOIN b ON i = bin""")
def length_histogram(spark, sf):
    """Text lengths in 20 equal bins from 0 to the longest."""
    d = table(spark, sf, "documents").select(F.length("text").cast("double").alias("n_chars"))
    h = stats.histogram(d, "n_chars", 0.0, float(d.agg(F.max("n_chars")).first()[0] or 1.0), BINS)
    return h.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


@register("freq_extremes", f"""WITH {_TOKENS_SQL},
a AS (SELECT 'most' AS side, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS rank, token AS value, n FROM freq),
z AS (SELECT 'least' AS side, CAST(row_number() OVER (ORDER BY n, token DESC) AS INTEGER) AS rank, token AS value, n FROM freq)
SELECT * FROM a WHERE rank <= {SHOWN} UNION ALL SELECT * FROM z WHERE rank <= {SHOWN}""")
def freq_extremes(spark, sf):
    """The ten most and the ten least common words."""
    return stats.extremes(_freq(spark, sf), "token", SHOWN)


@register("distinct_sketch", """WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents)
SELECT lang, true AS within FROM w GROUP BY lang UNION ALL SELECT 'all', true""")
def distinct_sketch(spark, sf):
    """HLL sketches of the distinct words per language, merged to one over all: each estimate against the
    exact count (within 3 %)."""
    w = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    sketches = written(stats.distinct_sketches(w, "word", ["lang"]), "sketches")
    est = stats.merged_estimate(sketches, ["lang"]).unionByName(stats.merged_estimate(sketches).select(F.lit("all").alias("lang"), "estimate"))
    exact = w.groupBy("lang").agg(F.count_distinct("word").alias("n")).unionByName(
        w.agg(F.count_distinct("word").alias("n")).select(F.lit("all").alias("lang"), "n"))
    near = F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n") + 1
    return est.join(exact, F.equal_null(est["lang"], exact["lang"])).select(est["lang"], near.alias("within"))


@register("corpus_texts", """
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS sub, text FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
UNION ALL SELECT 'benchmark', item_id, CAST(0 AS BIGINT), text FROM benchmark
UNION ALL SELECT 'pages', page_id, CAST(0 AS BIGINT), html FROM pages""")
def corpus_texts(spark, sf):
    """Corpus assembly with the texts themselves: four sources, two of them cleaned by nobody."""
    zero = F.lit(0).cast("long").alias("sub")
    d = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), zero, "text")
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("sub"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), zero, "text")
    p = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), zero, F.col("html").alias("text"))
    return d.unionByName(c).unionByName(b).unionByName(p)


@register("head_documents", """SELECT doc_id, lang, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT 5""")
def head_documents(spark, sf):
    """The first five documents by id."""
    return stats.head(table(spark, sf, "documents"), [F.col("doc_id")]).select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))
