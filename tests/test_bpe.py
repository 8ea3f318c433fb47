"""BPE learning against a plain-Python trainer; segmentation reproduces training."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sentiforge.functions.text import split_ws
from sentiforge.operators import bpe as B


def _python_merges(counts, n_merges):
    words = {w: [B.WORD_START] + list(w) for w in counts}
    out = []
    for rank in range(n_merges):
        pc = Counter()
        for w, s in words.items():
            for a, b in zip(s, s[1:]):
                pc[a + " " + b] += counts[w]
        if not pc:
            break
        pair, n = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < 2:
            break
        a, b = pair.split(" ")
        out.append((rank, a, b, n))
        for w, s in words.items():
            t, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    t.append(a + b)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            words[w] = t
    return out, words


def test_learn_and_segment(spark):
    text = ["low lower lowest newer newest wider", "new news low low lowest aaa aaaa", "ünï ünï café café"]
    df = spark.createDataFrame([(t,) for t in text], "line string")
    counts = Counter(w for t in text for w in t.lower().split())
    merges = B.learn_merges(B.word_table(df, "line"), 15, checkpoint_every=4)
    expected, segmented = _python_merges(counts, 15)
    assert merges == expected
    seg = {r.word: r.pieces for r in B.segment_words(B.word_table(df, "line"), merges).collect()}
    assert seg == {w: " ".join(s) for w, s in segmented.items()}
    keyed = spark.createDataFrame(list(enumerate(text)), "k long, line string")
    enc = B.encode_pieces(keyed, ["k"], "line", merges)
    got = {r.k: (r.pieces, r.text) for r in enc.select("k", "pieces", B.detokenise(F.col("pieces")).alias("text")).collect()}
    for k, t in enumerate(text):
        assert got[k][0] == [p for w in t.lower().split() for p in segmented[w]]
        assert got[k][1] == " ".join(t.lower().split())


def test_a_merge_recounts_only_the_words_that_hold_its_pair(spark, monkeypatch):
    text = ["aaaa aaaab abab ababa $1$1 $1$ a\\1 a\\1 (x)(x) .*.* .*.", "日本日本 日本語 aaaa abab 𝔘𝔫𝔘𝔫 𝔘𝔫"]
    words = B.word_table(spark.createDataFrame([(t,) for t in text], "line string"), "line")
    counted = []
    full = B.pair_counts
    monkeypatch.setattr(B, "pair_counts", lambda w: counted.append(1) or full(w))
    for every in (1, 3, 100):
        counted.clear()
        expected, _ = _python_merges(Counter(w for t in text for w in t.split()), 12)
        assert B.learn_merges(words, 12, every) == expected
        assert len(counted) == 1
    assert B.learn_merges(words.limit(0), 5) == []


def test_many_merges_of_a_job_are_those_of_one_at_a_time(spark, monkeypatch):
    """Few jobs, and pieces of one text that come from different pairs are one symbol."""
    rng = random.Random(3)
    counts = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(400))
    words = B.word_table(spark.createDataFrame([(w,) for w in counts.elements()], "line string"), "line")
    rounds = []
    full = B._accepted
    monkeypatch.setattr(B, "_accepted", lambda *a: rounds.append(full(*a)) or rounds[-1])
    expected, segmented = _python_merges(counts, 150)
    assert B.learn_merges(words, 150) == expected and sum(rounds) == len(expected) > 2 * len(rounds)
    found = B._Pieces(expected)
    assert [[found.text(s) for s in np.frombuffer(b, np.int32)] for b in found.symbols(list(counts))] == [segmented[w] for w in counts]


def test_the_queries_learn_the_whole_vocabulary():
    from sentiforge.plans import q_bpe
    assert q_bpe.N_MERGES >= 8000   # the reference's vocabulary


def test_lines_are_encoded_where_they_lie(spark, monkeypatch):
    """No row a word, unless a key occurs twice: such rows are one line."""
    rows = [(1, "Low lower aaaa"), (2, ""), (3, None), (None, "low 日本日本"), (4, "lower low"), (4, "aaa b c"), (5, "  ")]
    df = spark.createDataFrame(rows, "k long, line string").repartition(2)
    merges, _ = _python_merges(Counter("low lower aaaa 日本日本 low".split()), 9)
    monkeypatch.setattr(B, "CHUNK_WORDS", 2)
    got = {r.k: r.pieces for r in B.encode_pieces(df, ["k"], "line", merges).collect()}
    words = df.select("k", split_ws(F.lower("line")).alias("_w"))
    assert got == {r.k: r.pieces for r in B._encode_words(words, ["k"], merges).collect()} and len(got) == 6
    monkeypatch.setattr(B, "_encode_words", None)
    alone = df.where("k <> 4 or k is null")
    assert {r.k: r.pieces for r in B.encode_pieces(alone, ["k"], "line", merges).collect()} == {k: v for k, v in got.items() if k != 4}
