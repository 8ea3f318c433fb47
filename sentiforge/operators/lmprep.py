"""Language-model data preparation as Spark jobs.

* vocabulary: token counts (partial aggregation) ranked count desc, token
  asc into dense ids after the special tokens;
* encode: a task turns its lines, ``CHUNK_LINES`` at a time, into a list of
  distinct tokens and each line's places in it; only (chunk, distinct token)
  rows are joined with the vocabulary, unknown -> <unk>, and the chunk's lines
  are filled in (a frequent token is one row per chunk);
* pack: running token offsets in corpus order; a line gives each block it
  touches one slice of its ids, a block joins its slices; short tail dropped;
* MLM masking: per-position md5 draws of (seed, key, position), so the
  result is the same after a retry or a repartition;
* bigram LM: add-one smoothed bigram probabilities from the train lines,
  per-document perplexity of the held-out lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentiforge.functions.hashing import md5_key
from sentiforge.operators.ordering import prefix_sum, range_index, row_index
from sentiforge.scratch import written

# Special tokens and their ids.
SPECIALS = ["<pad>", "<unk>", "<cls>", "<sep>", "<mask>"]
PAD, UNK, CLS, SEP, MASK = range(5)
IGNORE = -100  # label of positions that are not predicted
CHUNK_LINES = 4096  # lines that are encoded together


def build_vocab(tokens: DataFrame, token_col: str = "token", min_count: int = 2, count_col: str | None = None) -> DataFrame:
    """``(token, id, n)``: specials first (n = 0), then tokens seen at least ``min_count`` times
    (a row is one occurrence, or ``count_col`` of them)."""
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(n.alias("n"))
    counts = counts.where(F.col("n") >= min_count)
    ranked = range_index(counts, [F.desc("n"), F.asc("token")], "_ix")
    words = ranked.select("token", (F.col("_ix") + len(SPECIALS)).cast("int").alias("id"), "n")
    spark = tokens.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, n long")
    return specials.unionByName(words)


def encode(lines: DataFrame, key_cols: Sequence[str], tokens_col: str, vocab: DataFrame | int) -> DataFrame:
    """``(*keys, ids array<int>)`` with unknown tokens mapped to <unk>; a line
    without tokens keeps its row with an empty array.  Where ``vocab`` is a number, the
    vocabulary is that of the lines themselves with this ``min_count``, specials in the text
    left out; its counts come with the chunks, so the lines are read once."""
    def chunked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401 - `import pyarrow` alone does not load it in a new Python worker
        from pyspark import TaskContext
        part, k = TaskContext.get().partitionId(), 0
        for b in (b.slice(i, CHUNK_LINES) for b in batches for i in range(0, b.num_rows, CHUNK_LINES)):
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            one = pa.array([0, b.num_rows], pa.int32())
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + k]), pa.ListArray.from_arrays(one, b.column(0)), pa.ListArray.from_arrays(one, size.cast(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(coded)], pa.int32()), coded.indices.cast(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
                 pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()),
                                          pa.array(np.bincount(coded.indices.drop_null(), minlength=len(coded.dictionary)), pa.int64()))],
                names=["chunk", "keys", "size", "places", "words", "times"])
            k += 1

    def filled(chunk):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401
        keys, size, places, ids = (chunk.column(c).combine_chunks().flatten() for c in ("keys", "size", "places", "ids"))
        got = pa.compute.fill_null(ids.take(places), UNK) if len(ids) else pa.array(np.full(len(places), UNK, np.int32))
        off = np.concatenate(([0], np.cumsum(np.asarray(size)))).astype(np.int32)
        return pa.table([keys, pa.ListArray.from_arrays(pa.array(off), got.cast(pa.int32()))], names=["key", "ids"])

    src = lines.select(F.struct(*key_cols).alias("key"), F.col(tokens_col).alias("_t"))
    key = src.schema["key"].dataType.simpleString()
    chunks = written(src.mapInArrow(chunked, f"chunk long, keys array<{key}>, size array<int>, places array<int>, "
                                     "words array<string>, times array<long>"), "chunks")
    if isinstance(vocab, int):
        seen = chunks.select(F.inline(F.arrays_zip(F.col("words").alias("token"), F.col("times").alias("n"))))
        vocab = build_vocab(seen.where(~F.col("token").isin(*SPECIALS)), "token", vocab, "n")
    found = (chunks.select("chunk", F.posexplode("words").alias("pos", "token")).join(vocab.select("token", "id"), "token", "left")
             .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")))).alias("_s"))
             .select("chunk", F.col("_s.id").alias("ids")))
    rows = chunks.select("chunk", "keys", "size", "places").join(found, "chunk", "left")
    # one chunk (a group of one row) is in Python at a time, however many a task has
    return rows.groupBy("chunk").applyInArrow(filled, f"key {key}, ids array<int>").select(*[F.col(f"key.{c}").alias(c) for c in key_cols], "ids")


def line_example(ids: Column, block_size: int) -> Column:
    """``[<cls>] + ids[:block_size - 2] + [<sep>]``."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, block_size - 2), F.array(F.lit(SEP)))


def pack_blocks(encoded: DataFrame, order_key: str, tiebreak: Sequence[str], block_size: int) -> DataFrame:
    """``(block, ids)``: all ids in (order_key, *tiebreak) order cut into blocks of
    ``block_size - 2`` tokens, each wrapped in <cls> ... <sep>; the short last block is dropped."""
    inner = block_size - 2
    # read three times (total, range totals, slices): encode once
    sized = written(encoded.withColumn("_n", F.size("ids")), "encoded")
    blocks = int(sized.agg(F.sum("_n")).first()[0] or 0) // inner
    off = prefix_sum(sized, order_key, tiebreak, "_n", name="_start").where("_n > 0")
    touched = F.sequence(F.floor(F.col("_start") / inner), F.floor((F.col("_start") + F.col("_n") - 1) / inner))
    parts = off.select("_start", "_n", "ids", F.explode(touched).alias("block")).where(F.col("block") < blocks)
    low = F.greatest(F.col("block") * inner - F.col("_start"), F.lit(0))
    high = F.least(F.col("_n").cast("long"), (F.col("block") + 1) * inner - F.col("_start"))
    parts = parts.select("block", (F.col("_start") + low).alias("at"),
                         F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = parts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_s"))
    return joined.select("block", F.concat(F.array(F.lit(CLS)), F.flatten(F.transform("_s", lambda x: x["part"])),
                                           F.array(F.lit(SEP))).alias("ids"))


def examples(encoded: DataFrame, key_cols: Sequence[str], block_size: int, mode: str = "pack") -> DataFrame:
    """Language-model examples ``(example, ids)``: ``mode`` ``"pack"`` cuts all ids in key order into full
    blocks, ``"line"`` makes one example of each line; ``example`` is the block's number or the line's keys."""
    if mode == "pack":
        return pack_blocks(encoded, key_cols[0], list(key_cols[1:]), block_size).select(
            F.col("block").cast("string").alias("example"), "ids")
    if mode == "line":
        return encoded.select(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols]).alias("example"),
                              line_example(F.col("ids"), block_size).alias("ids"))
    raise ValueError(f"mode must be pack or line, not {mode!r}")


def collate(encoded: DataFrame, key_cols: Sequence[str], ids_col: str, batch_size: int, pad: int = PAD) -> DataFrame:
    """``(*keys, batch, ids)``: sequential batches in key order, every row padded on the right to the
    longest of its batch."""
    ix = row_index(encoded, key_cols[0], tiebreak=list(key_cols[1:]), bucket_width=64, name="_ix")
    ix = ix.withColumn("batch", F.floor(F.col("_ix") / batch_size).cast("long"))
    longest = F.max(F.size(ids_col)).over(Window.partitionBy("batch"))       # batch_size rows
    return ix.withColumn("_l", longest).select(
        *key_cols, "batch", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad), F.col("_l") - F.size(ids_col))).alias(ids_col))


def mlm_mask(examples: DataFrame, key_cols: Sequence[str], ids_col: str, seed: int, vocab_size: int,
             prob: float = 0.15) -> DataFrame:
    """Add ``input_ids`` and ``labels``.  Each non-special position is picked when
    its draw u1 < prob; a picked token becomes <mask> when u2 < 0.8, else a
    random id in [0, vocab_size) when u3 < 0.5, else stays.  Labels hold the
    original id at picked positions and -100 elsewhere.  All draws come from
    one md5 of (seed, keys, position)."""
    keys = [F.col(c) for c in key_cols]
    hashed = F.transform(F.col(ids_col), lambda x, i: F.struct(x.alias("x"), md5_key(seed, *keys, i).alias("h")))

    def u(h, k):
        return F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") / F.lit(4294967296.0)

    def picked(s):
        return (~s["x"].isin(PAD, CLS, SEP)) & (u(s["h"], 0) < F.lit(prob))

    def new_id(s):
        rnd = F.pmod(F.conv(F.substring(s["h"], 25, 8), 16, 10).cast("long"), F.lit(vocab_size)).cast("int")
        return (F.when(~picked(s), s["x"]).when(u(s["h"], 1) < F.lit(0.8), F.lit(MASK))
                .when(u(s["h"], 2) < F.lit(0.5), rnd).otherwise(s["x"]))

    # one md5 per position, materialised once and read by both outputs
    out = examples.withColumn("_hx", hashed)
    return (out.withColumn("input_ids", F.transform("_hx", new_id))
            .withColumn("labels", F.transform("_hx", lambda s: F.when(picked(s), s["x"]).otherwise(F.lit(IGNORE))))
            .drop("_hx"))


def bigrams(tokens: Column) -> Column:
    """``array<struct<w1, w2>>`` of adjacent pairs of ``<s> + tokens + </s>``."""
    t = F.concat(F.array(F.lit("<s>")), tokens, F.array(F.lit("</s>")))
    n = F.size(t) - 1
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))


def bigram_perplexity(train: DataFrame, evaluate: DataFrame, tokens_col: str, key: str, add: float = 1.0) -> DataFrame:
    """``(key, n_tokens, nll, perplexity)`` of each evaluated group under the add-k
    smoothed bigram model ``P(w2 | w1) = (c(w1 w2) + k) / (c(w1) + k V)`` fitted on
    ``train`` (``add`` is k); V = number of distinct predicted tokens in train (words and </s>)."""
    tb = train.select(F.inline(bigrams(F.col(tokens_col))))
    pair = tb.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c12"))
    # contexts and vocabulary come from counts of single words, so that only one table of pairs is shuffled
    words = train.select(F.posexplode(F.concat(F.array(F.lit("<s>")), F.col(tokens_col))).alias("_i", "w1"))
    words = written(words.groupBy("w1").agg(F.count(F.lit(1)).alias("c1"), F.count_if(F.col("_i") > 0).alias("_in")), "words")
    ctx = words.select("w1", "c1")
    inside = F.count_if((F.col("_in") > 0) & (F.col("w1") != "</s>"))
    v = words.agg(inside + F.coalesce(F.max(F.when(F.col("w1") == "<s>", 1)), F.lit(0))).scalar()  # </s> ends every line
    eb = (evaluate.select(key, F.inline(bigrams(F.col(tokens_col))))
          .groupBy(key, "w1", "w2").agg(F.count(F.lit(1)).alias("cnt")))
    j = eb.join(pair, ["w1", "w2"], "left").join(ctx, "w1", "left")
    logp = F.ln((F.coalesce("c12", F.lit(0)) + F.lit(add)) / (F.coalesce("c1", F.lit(0)) + F.lit(add) * v))
    agg = j.groupBy(key).agg(F.sum("cnt").alias("n_tokens"), F.sum(F.col("cnt") * logp).alias("_lp"))
    nll = -F.col("_lp") / F.col("n_tokens")
    return agg.select(key, "n_tokens", nll.alias("nll"), F.exp(nll).alias("perplexity"))


def corpus_perplexity(per_group: DataFrame) -> DataFrame:
    """``(n_tokens, nll, perplexity)`` of all groups together, weighted by their tokens."""
    nll = F.sum(F.col("nll") * F.col("n_tokens")) / F.sum("n_tokens")
    return per_group.agg(F.sum("n_tokens").alias("n_tokens"), nll.alias("nll"), F.exp(nll).alias("perplexity"))
