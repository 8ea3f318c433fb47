"""Batch prediction over every document, checked against the same model in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.operators.scoring import hashed_ids, score_table
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import CLASSES
from sentiforge.sources.tables import table

IDS = 4095        # hashed ids
LENGTH = 300      # ids of a row
SCALE = 64.0      # of the fixed linear model


def linear_model():
    """A fixed linear function of position and id (whole numbers over a power of two, so sums are exact)."""
    import numpy as np
    place = np.arange(LENGTH)

    def f(ids, mask):
        return np.stack([(((ids * (j + 2) + place) % 7 - 3) * mask).sum(axis=1) / SCALE for j in range(len(CLASSES))], axis=1)

    return f


_SQL = f"""WITH t AS (SELECT doc_id AS uid, {S.split_ws('lower(clean)')} AS toks FROM (
  SELECT doc_id, {S.rules('text', T.MARK_RULES)} AS clean FROM documents)),
i AS (SELECT uid, list_transform(toks[1:{LENGTH}], lambda x: 1 + ('0x' || substr(md5(x), 1, 8))::BIGINT % {IDS}) AS ids FROM t),
l AS (SELECT uid, len(ids) AS n_ids, CASE WHEN len(ids) > 0 THEN [{', '.join(
    f'list_sum(list_transform(ids, lambda x, i: (x * {j + 2} + i - 1) % 7 - 3)) / {SCALE}::DOUBLE' for j in range(len(CLASSES)))}] END AS l FROM i),
e AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l)
SELECT uid, CAST(coalesce(n_ids, 0) AS INTEGER) AS n_ids,
       [{', '.join(S.lit(c) for c in CLASSES)}][list_position(l, list_max(l))] AS predicted,
       {', '.join(f"round(e[{j + 1}] / list_sum(e), 6) AS proba_{c}" for j, c in enumerate(CLASSES))} FROM e"""


@register("score_documents", _SQL)
def score_documents(spark, sf):
    """Clean, hash to ids, cut / pad to 300, mask, score in batches of 32, arg-max, decode:
    one row per document, null where a document has no token."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), T.split_ws(F.lower(T.clean_mark(F.col("text")))).alias("toks"))
    d = d.select("uid", hashed_ids(F.coalesce(F.slice("toks", 1, LENGTH), F.array().cast("array<string>")), IDS).alias("ids"))
    d = d.select("uid", F.size("ids").alias("n_ids"), "ids")
    out = score_table(d, "ids", linear_model, len(CLASSES), LENGTH, CLASSES)
    return out.select("uid", "n_ids", "predicted", *[F.round(f"proba_{c}", 6).alias(f"proba_{c}") for c in CLASSES])
