"""Hold-out splits, stratified folds, shuffled batches and corpus mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.functions.text import NONSPACE
from sentiforge.operators import sampling
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import labelled, with_sql
from sentiforge.sources.tables import table

SPLIT_SEED = 2018
FOLD_SEED = 42
LM_SEED = 7


@register("holdout_split", with_sql("labelled", f"""
SELECT uid, CASE WHEN {S.uniform(str(SPLIT_SEED), 'uid')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM labelled"""))
def holdout_split(spark, sf):
    return sampling.holdout_split(labelled(spark, sf).select("uid"), "uid", 0.1, SPLIT_SEED)


@register("kfold_assign", with_sql("labelled", f"""
SELECT uid, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {S.hex_int(S.md5_key(str(FOLD_SEED), 'uid'), 1, 8)}, uid) - 1) % 5 AS INTEGER) AS fold
FROM labelled"""))
def kfold_assign(spark, sf):
    return sampling.kfold_assign(labelled(spark, sf).select("uid", "label"), "uid", "label", 5, FOLD_SEED)


@register("shuffle_batches", with_sql("labelled", f"""
SELECT uid, (row_number() OVER (ORDER BY {S.hex_int(S.md5_key(str(FOLD_SEED), '0', 'uid'), 1, 8)}, uid) - 1) // 32 AS batch
FROM labelled"""))
def shuffle_batches(spark, sf):
    return sampling.shuffle_batches(labelled(spark, sf).select("uid"), "uid", 0, FOLD_SEED, 32)


def lm_lines(spark, sf):
    """Non-blank lines of every document: the language-model text, keyed (doc_id, line_no)."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(NONSPACE))


LM_LINES_SQL = f"""lm_lines AS (
  SELECT doc_id, line_no, line FROM (
    SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE {S.has_nonspace('line')})"""


@register("lm_split", f"""WITH {LM_LINES_SQL}
SELECT doc_id, line_no, CASE WHEN {S.uniform(str(LM_SEED), 'doc_id', 'line_no')} < 0.1 THEN 'valid' ELSE 'train' END AS split
FROM lm_lines""")
def lm_split(spark, sf):
    """10 % validation split of the language-model lines (key = document and line)."""
    lines = lm_lines(spark, sf)
    u = sampling.uniform(LM_SEED, F.col("doc_id"), F.col("line_no"))
    return lines.select("doc_id", "line_no", F.when(u < 0.1, "valid").otherwise("train").alias("split"))


@register("corpus_mixes", with_sql("labelled", f""",
cls AS (SELECT 'classifier' AS mix, CASE WHEN {S.uniform(str(SPLIT_SEED), 'uid')} < 0.1 THEN 'valid' ELSE 'train' END AS split FROM labelled),
lm AS (SELECT 'lm' AS mix, CASE WHEN {S.uniform(str(LM_SEED), 'doc_id')} < 0.1 THEN 'valid' ELSE 'train' END AS split FROM documents)
SELECT mix, split, count(*) AS n FROM (SELECT * FROM cls UNION ALL SELECT * FROM lm) GROUP BY mix, split"""))
def corpus_mixes(spark, sf):
    """Classifier mix = labelled rows (train/valid); LM mix = every document, labelled
    or not (train/valid by its own seed).  Row counts per mix and split."""
    return _mixes(spark, sf).groupBy("mix", "split").agg(F.count(F.lit(1)).alias("n"))


def _mixes(spark, sf):
    split = F.when(F.col("split") == "test", "valid").otherwise("train").alias("split")
    c = sampling.holdout_split(labelled(spark, sf).select("uid", "text", "sentiment"), "uid", 0.1, SPLIT_SEED)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")
    lm = sampling.holdout_split(d, "uid", 0.1, LM_SEED)
    return c.select(F.lit("classifier").alias("mix"), split, "uid", "text", "sentiment").unionByName(
        lm.select(F.lit("lm").alias("mix"), split, "uid", "text"), allowMissingColumns=True)


@register("corpus_mix_rows", with_sql("labelled", f"""
SELECT 'classifier' AS mix, CASE WHEN {S.uniform(str(SPLIT_SEED), 'uid')} < 0.1 THEN 'valid' ELSE 'train' END AS split, uid, text, sentiment FROM labelled
UNION ALL SELECT 'lm', CASE WHEN {S.uniform(str(LM_SEED), 'doc_id')} < 0.1 THEN 'valid' ELSE 'train' END, doc_id, text, NULL FROM documents"""))
def corpus_mix_rows(spark, sf):
    """The mixes themselves: every row of both with its split and text (the LM mix has no label)."""
    return _mixes(spark, sf)
