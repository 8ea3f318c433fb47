"""Reference-shaped inputs derived from the driver's tables.

The reference works on labelled tweets, K model outputs, class scores and a
training-loss log.  The driver provides ``documents``, ``labels``,
``events``...  Each builder here derives one reference input from those
tables (so the work grows with them) and ``SQL`` holds the same derivation
as a DuckDB common table expression for the oracle.

Mapping (fixed):
* corpus(uid, text, lang, sentiment): documents JOIN labels; sentiment is
  negative if toxic, neutral if quality = 0, else positive.
* tweets(uid, text, lang): documents text wrapped as a retweet with a
  mention, a hashtag and a URL, so that every cleaning rule fires.
* preds(model, uid, label, cls): K = 5 model outputs; each agrees with the
  gold label when an md5 uniform is below 0.6, else an md5 class.
* scores(uid, label, p): 3-class probabilities from md5 uniforms, one class
  boosted by 0.8 (the gold class for 70 % of rows, an md5 class otherwise),
  normalised.
* loss_log(run, epoch, step, loss): events per user ordered by event_id,
  50 steps per epoch, loss = ln(1 + value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.functions.hashing import hex_int, md5_key, uniform
from sentiforge.operators.labels import encode_fixed
from sentiforge.operators.ordering import row_index
from sentiforge.operators.vote import stack_models
from sentiforge.sources.tables import table

CLASSES = ["negative", "neutral", "positive"]  # lexicographic label order -> ids 0, 1, 2
N_MODELS = 5
STEPS_PER_EPOCH = 50


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text", "lang")
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("uid"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral")
        .otherwise("positive").alias("sentiment"))
    return d.join(lab, "uid")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """corpus plus the integer label (lexicographic ids)."""
    return encode_fixed(corpus(spark, sf), "sentiment", CLASSES, "label")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("RT @user"), F.pmod(F.col("doc_id"), F.lit(50)).cast("string"), F.lit(": "),
                    F.col("text"), F.lit(" #"), F.col("lang"), F.lit(" https://t.co/"),
                    F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("uid"), text.alias("text"), "lang")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Long table of K model outputs (model, uid, label, cls)."""
    base = labelled(spark, sf).select("uid", "label")
    tables = {}
    for k in range(1, N_MODELS + 1):
        rnd = F.pmod(hex_int(md5_key(k, F.col("uid")), 1, 4), F.lit(3)).cast("int")
        cls = F.when(uniform(k, "agree", F.col("uid")) < 0.6, F.col("label")).otherwise(rnd)
        tables[k] = base.select("uid", "label", cls.alias("cls"))
    return stack_models(tables, keep=["label"])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    base = labelled(spark, sf).select("uid", "label")
    boost = F.when(uniform("s", F.col("uid")) < 0.7, F.col("label")).otherwise(
        F.pmod(hex_int(md5_key("s", F.col("uid")), 9, 4), F.lit(3)).cast("int"))
    e = [(hex_int(md5_key("p", j, F.col("uid")), 1, 4) + F.lit(1)) / F.lit(65537.0)
         + F.when(boost == j, F.lit(0.8)).otherwise(F.lit(0.0)) for j in range(3)]
    s = e[0] + e[1] + e[2]
    return base.select("uid", "label", F.array(*[x / s for x in e]).alias("p"))


def loss_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id",
                                             F.ln(F.lit(1.0) + F.col("value")).alias("loss"))
    ix = row_index(ev, "event_id", partition_cols=["run"], name="ix")
    return ix.select("run", (F.col("ix") / STEPS_PER_EPOCH).cast("long").alias("epoch"),
                     F.pmod(F.col("ix"), F.lit(STEPS_PER_EPOCH)).alias("step"), "ix", "loss")


# ---------------------------------------------------------------------------
# The same derivations for the DuckDB oracle.
# ---------------------------------------------------------------------------
def _md5(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def _hex(expr: str, start: int, n: int) -> str:
    return f"('0x' || substr({expr}, {start}, {n}))::BIGINT"


def _uniform(*parts: str) -> str:
    return f"({_hex(_md5(*parts), 1, 8)} / 4294967296.0::DOUBLE)"


SQL = {}
SQL["corpus"] = """corpus AS (
  SELECT d.doc_id AS uid, d.text, d.lang,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 0 THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SQL["labelled"] = SQL["corpus"] + """,
labelled AS (
  SELECT *, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS label
  FROM corpus)"""
SQL["tweets"] = """tweets AS (
  SELECT doc_id AS uid,
         'RT @user' || CAST(doc_id % 50 AS VARCHAR) || ': ' || text || ' #' || lang || ' https://t.co/' || CAST(doc_id AS VARCHAR) AS text,
         lang
  FROM documents)"""
SQL["preds"] = SQL["labelled"] + ",\npreds AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT {k} AS model, uid, label, CASE WHEN {_uniform(str(k), repr('agree'), 'uid')} < 0.6 THEN label "
    f"ELSE CAST({_hex(_md5(str(k), 'uid'), 1, 4)} % 3 AS INTEGER) END AS cls FROM labelled"
    for k in range(1, N_MODELS + 1)) + ")"
_BOOST = f"(CASE WHEN {_uniform(repr('s'), 'uid')} < 0.7 THEN label ELSE CAST({_hex(_md5(repr('s'), 'uid'), 9, 4)} % 3 AS INTEGER) END)"
_E = [f"(({_hex(_md5(repr('p'), str(j), 'uid'), 1, 4)} + 1) / 65537.0::DOUBLE + CASE WHEN {_BOOST} = {j} THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)"
      for j in range(3)]
SQL["scores"] = SQL["labelled"] + f""",
scores_e AS (SELECT uid, label, {_E[0]} AS e0, {_E[1]} AS e1, {_E[2]} AS e2 FROM labelled),
scores AS (SELECT uid, label, [e0 / (e0 + e1 + e2), e1 / (e0 + e1 + e2), e2 / (e0 + e1 + e2)] AS p FROM scores_e)"""
SQL["loss_log"] = f"""loss_ix AS (
  SELECT user_id AS run, event_id, ln(1.0 + value) AS loss,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ix
  FROM events),
loss_log AS (
  SELECT run, CAST(ix // {STEPS_PER_EPOCH} AS BIGINT) AS epoch, ix % {STEPS_PER_EPOCH} AS step, ix, loss FROM loss_ix)"""


def with_sql(name: str, body: str) -> str:
    """``WITH <stand-in CTEs> <body>``."""
    return "WITH " + SQL[name] + "\n" + body
