"""Labels, score vectors, ensemble vote, classification metrics and loss logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions import arrays as A
from sentiforge.functions.hashing import hex_int, md5_key
from sentiforge.operators import labels as L
from sentiforge.operators import metrics as M
from sentiforge.operators.vote import majority_vote
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import CLASSES, corpus, labelled, loss_log, preds, scores, with_sql
from sentiforge.sources.tables import table

K = [0, 1, 2]


def _r(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


def _round_all(df, cols):
    return df.select(*[(_r(c) if c in cols else F.col(c)) for c in df.columns])


# -- SQL helpers for the oracle -------------------------------------------------
def _prf_sql(src: str, gold: str, pred: str, group: list[str], observed: bool, swap: bool,
             digits: int | None = 6) -> str:
    g, p = (pred, gold) if swap else (gold, pred)
    cnt = ["count(*) AS n"]
    for c in K:
        cnt += [f"count(*) FILTER (WHERE {g} = {c} AND {p} = {c}) AS tp{c}",
                f"count(*) FILTER (WHERE {p} = {c}) AS pp{c}", f"count(*) FILTER (WHERE {g} = {c}) AS ap{c}"]
    gsel = "".join(f"{x}, " for x in group)
    gby = f" GROUP BY {', '.join(group)}" if group else ""

    def w(c):
        return f"(CASE WHEN pp{c} + ap{c} > 0 THEN 1.0 ELSE 0.0 END)" if observed else "1.0"

    def sd(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"

    k = " + ".join(w(c) for c in K)
    prec = " + ".join(f"{sd(f'tp{c}', f'pp{c}')} * {w(c)}" for c in K)
    rec = " + ".join(f"{sd(f'tp{c}', f'ap{c}')} * {w(c)}" for c in K)
    f1 = " + ".join(f"{sd(f'2 * tp{c}', f'pp{c} + ap{c}')} * {w(c)}" for c in K)
    tp = " + ".join(f"tp{c}" for c in K)

    def rd(x):
        return f"round({x}, {digits})" if digits is not None else x
    return f"""SELECT {gsel}n, {rd(sd(tp, 'n'))} AS accuracy,
       {rd(sd(prec, k))} AS precision, {rd(sd(rec, k))} AS recall,
       {rd(sd(f1, k))} AS f1
FROM (SELECT {gsel}{', '.join(cnt)} FROM {src}{gby})"""


_VOTE_SQL = """,
votes AS (
  SELECT uid, count(*) FILTER (WHERE cls = 0) AS c0, count(*) FILTER (WHERE cls = 1) AS c1,
         count(*) FILTER (WHERE cls = 2) AS c2
  FROM preds GROUP BY uid),
vote AS (
  SELECT uid, CAST(CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INTEGER) AS vote,
         greatest(c0, c1, c2) AS n_votes FROM votes),
judged AS (SELECT v.uid, v.vote, l.label FROM vote v JOIN labelled l ON v.uid = l.uid)"""


def _judged(spark, sf):
    v = majority_vote(preds(spark, sf), len(K))
    return v.join(labelled(spark, sf).select("uid", "label"), "uid")


# -- queries --------------------------------------------------------------------
@register("label_encode", with_sql("corpus", """,
classes AS (SELECT sentiment, CAST(dense_rank() OVER (ORDER BY sentiment) - 1 AS INTEGER) AS label_id
            FROM (SELECT DISTINCT sentiment FROM corpus WHERE sentiment IS NOT NULL))
SELECT c.uid, c.sentiment, k.label_id FROM corpus c LEFT JOIN classes k ON c.sentiment = k.sentiment"""))
def label_encode(spark, sf):
    """Lexicographic ids learnt from the data."""
    return L.label_encode(corpus(spark, sf), "sentiment").select("uid", "sentiment", "label_id")


@register("label_map", with_sql("corpus", """
SELECT uid, CASE sentiment WHEN 'neutral' THEN 0 WHEN 'negative' THEN 1 WHEN 'positive' THEN 2 END AS label FROM corpus"""))
def label_map(spark, sf):
    """Explicit dictionary map (neutral=0, negative=1, positive=2); missing keys -> null."""
    m = {"neutral": 0, "negative": 1, "positive": 2}  # fixed value: the other label order in use
    return corpus(spark, sf).select("uid", L.map_values(F.col("sentiment"), m).alias("label"))


@register("argmax_decode", with_sql("scores", """
SELECT uid, pred_id, ['negative', 'neutral', 'positive'][pred_id + 1] AS pred_label,
       round(p[1], 6) AS proba_negative, round(p[2], 6) AS proba_neutral, round(p[3], 6) AS proba_positive
FROM (SELECT uid, p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred_id FROM scores)"""))
def argmax_decode(spark, sf):
    """Arg-max (first maximum wins) -> class name; score vector unpacked into named columns."""
    s = scores(spark, sf).withColumn("pred_id", A.argmax(F.col("p")))
    return s.select("uid", "pred_id", L.decode_fixed(F.col("pred_id"), CLASSES).alias("pred_label"),
                    *[F.round(F.get("p", j), 6).alias(f"proba_{c}") for j, c in enumerate(CLASSES)])


@register("softmax_scores", with_sql("scores", """,
lg AS (SELECT uid, [4.0 * p[1], 4.0 * p[2], 4.0 * p[3]] AS z FROM scores),
ex AS (SELECT uid, [exp(z[1] - list_max(z)), exp(z[2] - list_max(z)), exp(z[3] - list_max(z))] AS e FROM lg)
SELECT uid, round(e[1] / (e[1] + e[2] + e[3]), 6) AS s0, round(e[2] / (e[1] + e[2] + e[3]), 6) AS s1,
       round(e[3] / (e[1] + e[2] + e[3]), 6) AS s2 FROM ex"""))
def softmax_scores(spark, sf):
    """Softmax of logits (here 4 * p) so that stored scores become probabilities."""
    sm = A.softmax(F.transform("p", lambda x: F.lit(4.0) * x))
    return scores(spark, sf).select("uid", *[F.round(F.get(sm, j), 6).alias(f"s{j}") for j in K])


@register("majority_vote", with_sql("preds", _VOTE_SQL + "\nSELECT uid, vote, n_votes FROM vote"))
def majority_vote_q(spark, sf):
    return majority_vote(preds(spark, sf), len(K))


@register("vote_metrics", with_sql("preds", _VOTE_SQL + "\n" + _prf_sql("judged", "label", "vote", [], False, False)))
def vote_metrics(spark, sf):
    m = M.macro_prf(_judged(spark, sf), "label", "vote", K)
    return _round_all(m, ["accuracy", "precision", "recall", "f1"])


@register("macro_prf", with_sql("preds", _prf_sql("preds", "label", "cls", ["model"], True, False)))
def macro_prf(spark, sf):
    """Per-model macro P/R/F1 over the observed classes."""
    m = M.macro_prf(preds(spark, sf), "label", "cls", K, ["model"], observed=True)
    return _round_all(m, ["accuracy", "precision", "recall", "f1"])


@register("macro_prf_swapped", with_sql("preds", _prf_sql("preds", "label", "cls", ["model"], True, True)))
def macro_prf_swapped(spark, sf):
    """Same with predictions passed as the truth (precision and recall exchanged)."""
    m = M.macro_prf(preds(spark, sf), "label", "cls", K, ["model"], observed=True, swap=True)
    return _round_all(m, ["accuracy", "precision", "recall", "f1"])


@register("confusion_matrix", with_sql("preds", _VOTE_SQL + """,
cells AS (SELECT g.x AS gold, p.x AS pred FROM (VALUES (0), (1), (2)) g(x), (VALUES (0), (1), (2)) p(x))
SELECT c.gold, c.pred, count(j.uid) AS n
FROM cells c LEFT JOIN judged j ON j.label = c.gold AND j.vote = c.pred GROUP BY c.gold, c.pred"""))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_judged(spark, sf), "label", "vote", K)


@register("batch_mean_metrics", with_sql("preds", _VOTE_SQL + """,
batched AS (SELECT *, (row_number() OVER (ORDER BY uid) - 1) // 32 AS batch FROM judged),
per_batch AS (""" + _prf_sql("batched", "label", "vote", ["batch"], False, False, None) + """)
SELECT count(*) AS n_batches, round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM per_batch"""))
def batch_mean_metrics(spark, sf):
    """Mean of per-batch metrics (batches of 32 in uid order), every batch weighing the same."""
    m = M.batch_mean_metrics(_judged(spark, sf), "label", "vote", K, "uid", 32)
    return _round_all(m, ["accuracy", "precision", "recall", "f1"])


@register("running_loss", with_sql("loss_log", """
SELECT run, epoch, step, round(cum / nb, 6) AS avg_loss FROM (
  SELECT run, epoch, step,
         sum(loss) OVER (PARTITION BY run, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         count(*) OVER (PARTITION BY run, epoch) AS nb
  FROM loss_log)
WHERE step % 40 = 0 AND step <> 0"""))
def running_loss(spark, sf):
    return _round_all(M.running_loss(loss_log(spark, sf), 40), ["avg_loss"])


@register("logged_mean_loss", with_sql("loss_log", """
SELECT run, CAST((w + 1) * 50 AS BIGINT) AS global_step, round(s / 50, 6) AS mean_loss
FROM (SELECT run, ix // 50 AS w, sum(loss) AS s, count(*) AS n FROM loss_log GROUP BY run, ix // 50)
WHERE n = 50"""))
def logged_mean_loss(spark, sf):
    return _round_all(M.logged_mean_loss(loss_log(spark, sf), 50), ["mean_loss"])


@register("perplexity", with_sql("loss_log", """
SELECT run, count(*) AS n_batches, round(exp(avg(loss)), 6) AS perplexity FROM loss_log GROUP BY run"""))
def perplexity(spark, sf):
    """exp(mean batch loss) per run (each logged loss is one evaluation batch)."""
    return _round_all(M.perplexity(loss_log(spark, sf)), ["perplexity"])


_MATCH_SQL = with_sql("labelled", f""",
p AS (SELECT doc_id AS uid, CAST({S.hex_int(S.md5_key("'guess'", 'doc_id'), 1, 4)} % 3 AS INTEGER) AS pred FROM documents),
j AS (SELECT p.uid AS a, l.uid AS b, p.pred, l.label FROM p FULL JOIN labelled l ON p.uid = l.uid)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS missing_gold,
       count(*) FILTER (WHERE a IS NULL) AS missing_prediction,
       round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN pred = label THEN 1.0 ELSE 0.0 END END), 6) AS accuracy FROM j""")


@register("prediction_match", _MATCH_SQL)
def prediction_match(spark, sf):
    """Predictions of all documents against the gold labels of some: matched and unmatched rows and the accuracy
    of the matched ones, from one pass over the join."""
    preds_ = table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), F.pmod(hex_int(md5_key("guess", F.col("doc_id")), 1, 4), F.lit(3)).cast("int").alias("pred"))
    joined, seen = L.join_counted(preds_, labelled(spark, sf).select("uid", "label"), "uid")
    right = joined.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy")).first()[0]
    row = seen.get
    return spark.createDataFrame([(row["matched"], row["missing_gold"], row["missing_prediction"], right)],
                                 "matched long, missing_gold long, missing_prediction long, accuracy double")
