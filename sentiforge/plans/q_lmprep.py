"""LM-corpus preparation: vocabulary, id encoding, padding, masks, line
examples, block packing, batch collation, MLM masking, bigram perplexity.

Text: the non-blank lines of every document, lower-cased and split on
blanks; keys (doc_id, line_no); corpus order is (doc_id, line_no, position).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentiforge.functions import text as T
from sentiforge.functions.arrays import attention_mask, join_ints, pad_truncate
from sentiforge.operators import lmprep as LM
from sentiforge.operators.ordering import row_index
from sentiforge.plans import sqltext as S
from sentiforge.plans.q_sampling import LM_LINES_SQL, LM_SEED, lm_lines
from sentiforge.functions.hashing import uniform
from sentiforge.plans.registry import register
from sentiforge.scratch import written

MAX_LEN = 300      # padded length of classifier inputs
BLOCK = 128        # LM block size (two of them are <cls>/<sep>)
BATCH = 32
MLM_SEED = 42
MIN_COUNT = 2

KEYS = ["doc_id", "line_no"]


def _lines(spark, sf):
    return lm_lines(spark, sf).select(*KEYS, T.split_ws(F.lower(F.col("line"))).alias("tokens"))


def _vocab(spark, sf):
    toks = _lines(spark, sf).select(F.explode("tokens").alias("token")).where(~F.col("token").isin(*LM.SPECIALS))
    return LM.build_vocab(toks, min_count=MIN_COUNT)


def _encoded(spark, sf, vocab=None):
    return LM.encode(_lines(spark, sf), KEYS, "tokens", MIN_COUNT if vocab is None else vocab)


_SPECIALS_SQL = ", ".join(f"({S.lit(t)}, {i}, 0)" for i, t in enumerate(LM.SPECIALS))
BASE_SQL = f"""WITH {LM_LINES_SQL},
lt AS (SELECT doc_id, line_no, {S.split_ws('lower(line)')} AS toks FROM lm_lines),
tokc AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM lt)
         WHERE token NOT IN ({', '.join(S.lit(t) for t in LM.SPECIALS)}) GROUP BY token HAVING count(*) >= {MIN_COUNT}),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + {len(LM.SPECIALS)} AS INTEGER) AS id, n FROM tokc
          UNION ALL SELECT t, CAST(i AS INTEGER), CAST(n AS BIGINT) FROM (VALUES {_SPECIALS_SQL}) v(t, i, n)),
ex AS (SELECT doc_id, line_no, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM lt),
enc AS (SELECT doc_id, line_no, list(coalesce(v.id, {LM.UNK}) ORDER BY pos) AS ids
        FROM ex LEFT JOIN vocab v USING (token) GROUP BY doc_id, line_no)"""

_EXAMPLE_SQL = f"[{LM.CLS}] || ids[1:{BLOCK - 2}] || [{LM.SEP}]"


@register("lm_vocab", BASE_SQL + "\nSELECT token, id, n FROM vocab")
def lm_vocab(spark, sf):
    """Specials, then tokens seen at least twice ranked by count desc, token asc."""
    return _vocab(spark, sf)


@register("encode_ids", BASE_SQL + "\nSELECT doc_id, line_no, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS ids FROM enc")
def encode_ids(spark, sf):
    e = _encoded(spark, sf)
    return e.select(*KEYS, F.size("ids").alias("n_ids"), join_ints(F.col("ids")).alias("ids"))


_PAD_SQL = f"(ids[1:{MAX_LEN}] || list_transform(range(greatest({MAX_LEN} - len(ids), 0)), lambda x: 0))"


@register("pad_truncate", BASE_SQL + f"\nSELECT doc_id, line_no, array_to_string({_PAD_SQL}, ' ') AS ids FROM enc")
def pad_truncate_q(spark, sf):
    """Ids cut to 300 and right-padded with <pad> = 0."""
    e = _encoded(spark, sf)
    return e.select(*KEYS, join_ints(pad_truncate(F.col("ids"), MAX_LEN, LM.PAD)).alias("ids"))


@register("attention_mask", BASE_SQL + f""",
padded AS (SELECT doc_id, line_no, {_PAD_SQL} AS p FROM enc)
SELECT doc_id, line_no, CAST(len(list_filter(p, lambda x: x <> 0)) AS INTEGER) AS n_attended,
       array_to_string(list_transform(p, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS mask FROM padded""")
def attention_mask_q(spark, sf):
    """1 over real tokens, 0 over padding (pad id is a parameter, 0 here)."""
    e = _encoded(spark, sf).select(*KEYS, pad_truncate(F.col("ids"), MAX_LEN, LM.PAD).alias("p"))
    m = attention_mask(F.col("p"), LM.PAD)
    return e.select(*KEYS, F.size(F.filter("p", lambda x: x != LM.PAD)).alias("n_attended"), join_ints(m).alias("mask"))


@register("line_examples", BASE_SQL + f"\nSELECT doc_id, line_no, array_to_string({_EXAMPLE_SQL}, ' ') AS ids FROM enc")
def line_examples(spark, sf):
    """One example per non-blank line: <cls> + first 126 ids + <sep>."""
    e = _encoded(spark, sf)
    return e.select(*KEYS, join_ints(LM.line_example(F.col("ids"), BLOCK)).alias("ids"))


@register("pack_blocks", BASE_SQL + f""",
off AS (SELECT doc_id, line_no, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id, line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM enc),
toks AS (SELECT off + unnest(range(len(ids))) AS gpos, unnest(ids) AS id FROM off),
total AS (SELECT sum(len(ids)) AS t FROM enc)
SELECT CAST(gpos // {BLOCK - 2} AS BIGINT) AS block,
       array_to_string([{LM.CLS}] || list(id ORDER BY gpos) || [{LM.SEP}], ' ') AS ids
FROM toks WHERE gpos < (SELECT t FROM total) // {BLOCK - 2} * {BLOCK - 2} GROUP BY gpos // {BLOCK - 2}""")
def pack_blocks(spark, sf):
    """All ids in corpus order cut into blocks of 126 (+ <cls>, <sep>); the short tail is dropped."""
    b = LM.pack_blocks(_encoded(spark, sf), "doc_id", ["line_no"], BLOCK)
    return b.select(F.col("block").cast("long").alias("block"), join_ints(F.col("ids")).alias("ids"))


@register("collate_batches", BASE_SQL + f""",
ord AS (SELECT doc_id, line_no, len({_EXAMPLE_SQL}) AS n,
               (row_number() OVER (ORDER BY doc_id, line_no) - 1) // {BATCH} AS batch FROM enc)
SELECT doc_id, line_no, CAST(batch AS BIGINT) AS batch, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS padded_len FROM ord""")
def collate_batches(spark, sf):
    """Sequential batches of 32 examples; each batch is padded to its own longest example."""
    e = _encoded(spark, sf).select(*KEYS, F.size(LM.line_example(F.col("ids"), BLOCK)).alias("n"))
    ix = row_index(e, "doc_id", tiebreak=["line_no"], bucket_width=64, name="_ix")
    ix = ix.withColumn("batch", F.floor(F.col("_ix") / BATCH).cast("long"))
    return ix.select(*KEYS, "batch", F.max("n").over(Window.partitionBy("batch")).cast("int").alias("padded_len"))


@register("padded_batches", BASE_SQL + f""",
ord AS (SELECT doc_id, line_no, {_EXAMPLE_SQL} AS e, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // {BATCH} AS batch FROM enc),
mx AS (SELECT *, max(len(e)) OVER (PARTITION BY batch) AS l FROM ord)
SELECT doc_id, line_no, CAST(batch AS BIGINT) AS batch,
       array_to_string(e || list_transform(range(l - len(e)), lambda x: {LM.PAD}), ' ') AS ids FROM mx""")
def padded_batches(spark, sf):
    """The padded rows themselves: sequential batches of 32 examples, each row as long as its batch's longest."""
    e = _encoded(spark, sf).select(*KEYS, LM.line_example(F.col("ids"), BLOCK).alias("e"))
    return LM.collate(e, KEYS, "e", BATCH).select(*KEYS, "batch", join_ints(F.col("e")).alias("ids"))


@register("examples_by_mode", BASE_SQL + f""",
off AS (SELECT doc_id, line_no, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id, line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM enc),
toks AS (SELECT off + unnest(range(len(ids))) AS gpos, unnest(ids) AS id FROM off),
total AS (SELECT sum(len(ids)) AS t FROM enc)
SELECT 'pack' AS mode, CAST(CAST(gpos // {BLOCK - 2} AS BIGINT) AS VARCHAR) AS example,
       array_to_string([{LM.CLS}] || list(id ORDER BY gpos) || [{LM.SEP}], ' ') AS ids
FROM toks WHERE gpos < (SELECT t FROM total) // {BLOCK - 2} * {BLOCK - 2} GROUP BY gpos // {BLOCK - 2}
UNION ALL SELECT 'line', doc_id || ':' || line_no, array_to_string({_EXAMPLE_SQL}, ' ') FROM enc""")
def examples_by_mode(spark, sf):
    """Packed blocks and line examples of the same corpus, chosen by the ``mode`` argument."""
    e = written(_encoded(spark, sf), "encoded")
    out = [LM.examples(e, KEYS, BLOCK, mode).select(F.lit(mode).alias("mode"), "example", join_ints(F.col("ids")).alias("ids"))
           for mode in ("pack", "line")]
    return out[0].unionByName(out[1])


def _mlm_sql():
    def u(k):
        return f"(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT / 4294967296.0::DOUBLE)"
    h = f"md5(concat_ws('|', '{MLM_SEED}', doc_id, line_no, i - 1))"
    picked = f"(x NOT IN ({LM.PAD}, {LM.CLS}, {LM.SEP}) AND {u(0)} < 0.15)"
    new = (f"CASE WHEN NOT {picked} THEN x WHEN {u(1)} < 0.8 THEN {LM.MASK} "
           f"WHEN {u(2)} < 0.5 THEN CAST(('0x' || substr(h, 25, 8))::BIGINT % vs AS INTEGER) ELSE x END")
    lab = f"CASE WHEN {picked} THEN x ELSE {LM.IGNORE} END"
    # h is spelled out inside each lambda (DuckDB lambdas cannot bind a local name)
    new = new.replace("h,", h + ",")
    lab = lab.replace("h,", h + ",")
    return BASE_SQL + f""",
vs AS (SELECT count(*) AS vs FROM vocab),
exs AS (SELECT doc_id, line_no, {_EXAMPLE_SQL} AS e FROM enc)
SELECT doc_id, line_no,
       array_to_string(list_transform(e, lambda x, i: {new}), ' ') AS input_ids,
       array_to_string(list_transform(e, lambda x, i: {lab}), ' ') AS labels
FROM exs, vs"""


@register("mlm_mask", _mlm_sql())
def mlm_mask(spark, sf):
    """Masked-LM inputs and labels for every line example (15 % picked; 80/10/10)."""
    vocab = written(_vocab(spark, sf), "vocab")
    vocab_size = vocab.count()  # one scalar: the random-id range
    ex = _encoded(spark, sf, vocab).select(*KEYS, LM.line_example(F.col("ids"), BLOCK).alias("e"))
    m = LM.mlm_mask(ex, KEYS, "e", MLM_SEED, vocab_size)
    return m.select(*KEYS, join_ints(F.col("input_ids")).alias("input_ids"), join_ints(F.col("labels")).alias("labels"))


_BIGRAM_SQL = f"""WITH {LM_LINES_SQL},
lt AS (SELECT doc_id, line_no, {S.split_ws('lower(line)')} AS toks,
              CASE WHEN {S.uniform(str(LM_SEED), 'doc_id', 'line_no')} < 0.1 THEN 'valid' ELSE 'train' END AS split
       FROM lm_lines),
bg AS (SELECT doc_id, split, unnest(list_transform(range(1, len(t)), lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS b
       FROM (SELECT doc_id, split, list_concat(['<s>'], toks, ['</s>']) AS t FROM lt)),
tb AS (SELECT b.w1 AS w1, b.w2 AS w2 FROM bg WHERE split = 'train'),
pair AS (SELECT w1, w2, count(*) AS c12 FROM tb GROUP BY w1, w2),
ctx AS (SELECT w1, count(*) AS c1 FROM tb GROUP BY w1),
v AS (SELECT count(DISTINCT w2) AS v FROM tb),
eb AS (SELECT doc_id, b.w1 AS w1, b.w2 AS w2, count(*) AS cnt FROM bg WHERE split = 'valid' GROUP BY ALL)
"""
_PER_DOC_SQL = """SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens,
         -sum(cnt * ln((coalesce(c12, 0) + {k}) / (coalesce(c1, 0) + {k} * (SELECT v FROM v)))) / sum(cnt) AS nll
  FROM eb LEFT JOIN pair USING (w1, w2) LEFT JOIN ctx USING (w1) GROUP BY doc_id"""
ADD_K = 0.1


def _split_lines(spark, sf):
    lt = lm_lines(spark, sf).select("doc_id", T.split_ws(F.lower(F.col("line"))).alias("tokens"),
                                    (uniform(LM_SEED, F.col("doc_id"), F.col("line_no")) < 0.1).alias("_valid"))
    return lt.where(~F.col("_valid")), lt.where(F.col("_valid"))


@register("corpus_perplexity", _BIGRAM_SQL + f"""SELECT CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       round(sum(nll * n_tokens) / sum(n_tokens), 6) AS nll, round(exp(sum(nll * n_tokens) / sum(n_tokens)), 2) AS perplexity
FROM ({_PER_DOC_SQL.format(k=f"{ADD_K}::DOUBLE")})""")
def corpus_perplexity(spark, sf):
    """Token-weighted perplexity of all held-out lines under an add-0.1 bigram model of the train lines."""
    p = LM.corpus_perplexity(LM.bigram_perplexity(*_split_lines(spark, sf), "tokens", "doc_id", ADD_K))
    return p.select("n_tokens", F.round("nll", 6).alias("nll"), F.round("perplexity", 2).alias("perplexity"))


@register("bigram_perplexity", _BIGRAM_SQL + f"""SELECT doc_id, n_tokens, round(nll, 6) AS nll, round(exp(nll), 2) AS perplexity FROM (
  {_PER_DOC_SQL.format(k='1.0')})""")
def bigram_perplexity(spark, sf):
    """Add-one bigram model on the train lines; perplexity of each document's held-out lines."""
    p = LM.bigram_perplexity(*_split_lines(spark, sf), "tokens", "doc_id")
    return p.select("doc_id", "n_tokens", F.round("nll", 6).alias("nll"), F.round("perplexity", 2).alias("perplexity"))
