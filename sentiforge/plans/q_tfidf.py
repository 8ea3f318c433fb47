"""TF-IDF family: flagship top terms, L2 tf, bigram/sublinear TF-IDF,
fit/transform on a hold-out split, NB log-count ratio."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.operators import tfidf as TF
from sentiforge.operators.ordering import top_k
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import labelled, tweets, with_sql
from sentiforge.scratch import written
from sentiforge.sources.tables import table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


_TOP_SQL = with_sql("tweets", f""",
toks AS (SELECT uid, lang, unnest({S.word_tokens(S.rules('text', T.MARK_RULES))}) AS term FROM tweets),
tf AS (SELECT uid, lang, term, count(*) AS tf FROM toks GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT uid, lang, term, tf * (ln((1 + (SELECT count(*) FROM tweets)) / (1 + df)::DOUBLE) + 1) AS w
      FROM tf JOIN dfreq USING (term)),
wn AS (SELECT uid, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) AS weight FROM w),
agg AS (SELECT lang, term, round(sum(weight), 6) AS weight FROM wn GROUP BY lang, term),
ranked AS (SELECT lang, term, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM agg)
SELECT lang, rank, term, weight FROM ranked WHERE rank <= 5""")


@register("tfidf_top_terms_by_lang", _TOP_SQL)
def tfidf_top_terms_by_lang(spark, sf):
    """Clean (variant A) -> vectoriser tokens -> TF-IDF -> per-language weight sums -> top 5."""
    docs = tweets(spark, sf).select("uid", "lang", T.word_tokens(T.clean_mark(F.col("text"))).alias("tokens"))
    w = TF.tfidf(docs, "uid", "tokens", keep=["lang"])
    agg = w.groupBy("lang", "term").agg(F.round(F.sum("weight"), 6).alias("weight"))
    top = top_k(agg, ["lang"], [F.desc("weight"), F.asc("term")], 5)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "term", "weight")


# ---------------------------------------------------------------------------
# Long-table feature queries over the labelled corpus.
# ---------------------------------------------------------------------------
SPLIT_SEED = 2018
MIN_DF, MAX_DF = 3, 0.75
NB_POS, NB_NEG = 1, 0  # the log-count ratio compares class 1 with class 0 only


def _mark_docs(spark, sf):
    return labelled(spark, sf).select("uid", "label", T.word_tokens(T.clean_mark(F.col("text"))).alias("tokens"))


def _v2_docs(spark, sf):
    """Glue-clean -> strip accents -> vectoriser tokens -> unigrams + bigrams, with the hold-out split.
    Tokens are materialised first so the bigram lambda reads a column, not the regex chain."""
    base = labelled(spark, sf).select(
        "uid", "label", T.word_tokens(T.strip_accents(T.clean_glue(F.col("text")))).alias("_t"))
    from sentiforge.operators.sampling import holdout_split
    base = holdout_split(base, "uid", 0.1, SPLIT_SEED)
    return base.select("uid", "label", "split", T.with_bigrams(F.col("_t")).alias("tokens"))


def _every_doc(spark, sf):
    """All documents, labelled or not, with the tokens of ``_v2_docs``."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), T.word_tokens(T.strip_accents(T.clean_glue(F.coalesce("text", F.lit(""))))).alias("_t"))
    return d.select("uid", T.with_bigrams(F.col("_t")).alias("tokens"))


def _rounded(w):
    return w.select("uid", "term", F.round("weight", 6).alias("weight"))


_MARK_SQL = with_sql("labelled", f""",
tf AS (SELECT uid, term, count(*) AS tf
       FROM (SELECT uid, unnest({S.word_tokens(S.rules('text', T.MARK_RULES))}) AS term FROM labelled) GROUP BY ALL)""")


@register("tf_l2", _MARK_SQL + """
SELECT uid, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY uid)), 6) AS weight FROM tf""")
def tf_l2(spark, sf):
    """Term counts scaled to unit L2 length per document (no idf)."""
    return _rounded(TF.tf_l2(_mark_docs(spark, sf), "uid", "tokens"))


@register("tfidf_plain", _MARK_SQL + """,
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT uid, term, tf * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN dfreq USING (term))
SELECT uid, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY uid)), 6) AS weight FROM w""")
def tfidf_plain(spark, sf):
    """Smoothed TF-IDF with library defaults on the mark-cleaned labelled corpus."""
    return _rounded(TF.tfidf(_mark_docs(spark, sf), "uid", "tokens"))


_V2_SQL = with_sql("labelled", f""",
v2a AS (SELECT uid, label, CASE WHEN {S.uniform(str(SPLIT_SEED), 'uid')} < 0.1 THEN 'test' ELSE 'train' END AS split,
               {S.word_tokens("strip_accents(" + S.rules('text', T.GLUE_RULES) + ")")} AS t0 FROM labelled),
v2 AS (SELECT uid, label, split, list_concat(t0, list_transform(range(1, len(t0)), lambda i: t0[i] || ' ' || t0[i + 1])) AS toks
       FROM v2a),
tf AS (SELECT uid, label, split, term, count(*) AS tf FROM (SELECT uid, label, split, unnest(toks) AS term FROM v2) GROUP BY ALL)""")


def _v2_fit_sql(where: str) -> str:
    """idf CTE fitted on the rows matching ``where`` (df bounds applied)."""
    return f""",
fit AS (SELECT * FROM tf WHERE {where}),
nfit AS (SELECT count(*) AS n FROM v2 WHERE {where}),
idf AS (SELECT term, ln((1 + (SELECT n FROM nfit)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM fit GROUP BY term
        HAVING count(*) >= {MIN_DF} AND count(*) <= {MAX_DF} * (SELECT n FROM nfit))"""


_W_SQL = """w AS (SELECT uid, term, (1 + ln(tf)) * idf AS w FROM {src} JOIN idf USING (term)),
wn AS (SELECT uid, term, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) AS weight FROM w)"""


@register("tfidf_bigram_sublinear", _V2_SQL + _v2_fit_sql("true") + ",\n" + _W_SQL.format(src="tf") + """
SELECT uid, term, round(weight, 6) AS weight FROM wn""")
def tfidf_bigram_sublinear(spark, sf):
    """Accent-stripped uni+bigram TF-IDF, sublinear tf, df in [3, 0.75 n], fitted on the whole corpus."""
    return _rounded(TF.tfidf(_v2_docs(spark, sf), "uid", "tokens", sublinear=True, min_df=MIN_DF, max_df=MAX_DF))


@register("tfidf_transform_holdout", _V2_SQL + _v2_fit_sql("split = 'train'") + ",\n"
          + _W_SQL.format(src="(SELECT * FROM tf WHERE split = 'test')") + """
SELECT uid, term, round(weight, 6) AS weight FROM wn""")
def tfidf_transform_holdout(spark, sf):
    """Fit vocabulary and idf on the train split, apply to the test split (unknown terms ignored)."""
    docs = _v2_docs(spark, sf)
    model = TF.TfidfModel.fit(docs.where(F.col("split") == "train"), "uid", "tokens",
                              sublinear=True, min_df=MIN_DF, max_df=MAX_DF)
    return _rounded(model.transform(docs.where(F.col("split") == "test"), "uid", "tokens"))


def _train_features(spark, sf):
    train = written(_v2_docs(spark, sf).where(F.col("split") == "train"), "tokens")  # read by four branches
    model = TF.TfidfModel.fit(train, "uid", "tokens", sublinear=True, min_df=MIN_DF, max_df=MAX_DF)
    return train, model, written(model.transform(train, "uid", "tokens", keep=["label"]), "weights")


_NB_SQL = _V2_SQL + _v2_fit_sql("split = 'train'") + ",\n" + _W_SQL.format(src="fit") + f""",
lab AS (SELECT uid, label FROM v2 WHERE split = 'train'),
sums AS (SELECT term, sum(CASE WHEN label = {NB_POS} THEN weight ELSE 0.0 END) AS s_pos,
                sum(CASE WHEN label = {NB_NEG} THEN weight ELSE 0.0 END) AS s_neg
         FROM wn JOIN lab USING (uid) GROUP BY term),
r AS (SELECT i.term, ln(((1 + coalesce(s_pos, 0.0)) / (1 + (SELECT count(*) FILTER (WHERE label = {NB_POS}) FROM lab)))
                      / ((1 + coalesce(s_neg, 0.0)) / (1 + (SELECT count(*) FILTER (WHERE label = {NB_NEG}) FROM lab)))) AS r
      FROM idf i LEFT JOIN sums USING (term))"""


@register("nb_log_ratio", _NB_SQL + "\nSELECT term, round(r, 6) AS r FROM r")
def nb_log_ratio(spark, sf):
    """Per-term NB log-count ratio of class 1 against class 0 over the train TF-IDF features."""
    train, model, w = _train_features(spark, sf)
    r = TF.nb_log_ratio(w, train.select("uid", "label"), "uid", "label", model.idf, NB_POS, NB_NEG)
    return r.select("term", F.round("r", 6).alias("r"))


@register("nb_scaled_features", _NB_SQL + "\nSELECT uid, term, round(weight * r, 6) AS weight FROM wn JOIN r USING (term)")
def nb_scaled_features(spark, sf):
    """Train features multiplied element-wise by the log-count ratio (the NB-SVM input)."""
    train, model, w = _train_features(spark, sf)
    r = TF.nb_log_ratio(w, train.select("uid", "label"), "uid", "label", model.idf, NB_POS, NB_NEG)
    return _rounded(TF.scale_by_ratio(w, r))
