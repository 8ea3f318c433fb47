"""Sub-word vocabulary: first-round pair counts (SQL-checked), learned merges,
and the corpus lines encoded into pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentiforge.operators import bpe as B
from sentiforge.plans import sqltext as S
from sentiforge.plans.q_sampling import LM_LINES_SQL, lm_lines
from sentiforge.plans.registry import register

N_MERGES = 8000  # the reference learns a vocabulary of 8,000 pieces (the operator takes any number)


@register("bpe_pair_counts", f"""WITH {LM_LINES_SQL},
w AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.split_ws('lower(line)')}) AS word FROM lm_lines) GROUP BY word),
s AS (SELECT n, regexp_extract_all({S.lit(B.WORD_START)} || word, '(?s).', 0) AS c FROM w)
SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, unnest(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) AS pair FROM s)
GROUP BY pair""")
def bpe_pair_counts(spark, sf):
    """Adjacent symbol pairs of every corpus word, weighted by word frequency (round 1 of learning)."""
    return B.pair_counts(B.word_table(lm_lines(spark, sf), "line"))


def _merges(spark, sf):
    return B.learn_merges(B.word_table(lm_lines(spark, sf), "line"), N_MERGES)


@register("bpe_merges")
def bpe_merges(spark, sf):
    """The learned merges in rank order (rank, left, right, n, piece)."""
    return B.merges_frame(spark, _merges(spark, sf))


@register("bpe_encode")
def bpe_encode(spark, sf):
    """Every non-blank line as sub-word pieces, and its detokenised text."""
    enc = B.encode_pieces(lm_lines(spark, sf), ["doc_id", "line_no"], "line", _merges(spark, sf))
    return enc.select("doc_id", "line_no", F.size("pieces").alias("n_pieces"),
                      F.array_join("pieces", " ").alias("pieces"), B.detokenise(F.col("pieces")).alias("text"))
