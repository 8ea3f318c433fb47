"""Base counts against a plain Python version; the verdict against a plain likelihood ratio."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sentiforge.llm import counts, words
from sentiforge.llm.quality_rules import fit, judge, op6_quality_rules, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if seen[tuple(ws[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def counted(texts):
    w = words.find_words(pa.array(texts, pa.string()))
    return list(zip(*(x.tolist() for x in (counts.n_words(w), counts.word_chars(w), counts.n_symbols(w),
                                           counts.n_dup_lines(w)[0], counts.n_repeat_words(w)))))


ATOM = st.sampled_from(["a", "b", "é", "the", "x#", "|", "*$", " ", "  ", "\n", "\t", "\x0b", " ", "日本", "a b c d e f g h "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(ATOM, max_size=40).map("".join)), max_size=6))
def test_counts(texts):
    assert counted(texts) == [plain(t) for t in texts]


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(words, "_CHUNK", 64)
    texts = ["word " * 400, "x" * 500 + " " + "x" * 500 + "\n" + "y" * 300 + "\n" + "y" * 300, None]
    assert counted(texts) == [plain(t) for t in texts]
    w = words.find_words(pa.array(["x" * 500 + " " + "x" * 500 + " " + "x" * 499]))
    assert w.hash[0] == w.hash[1] != w.hash[2]


def test_verdict_equals_a_plain_ratio(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    weights = fit(docs, labels, bits=20)
    rows = {r["doc_id"]: r for r in judge(docs, weights, carry=["doc_id"], bits=20).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target, rep = Counter(), Counter(), [Counter(), Counter()]
    data = {}
    for r in docs.collect():
        t = (r["text"] or "").encode()
        g = [t[i:i + 4] for i in range(len(t) - 3)]
        ws = WORD.findall(r["text"] or "")
        same = [False] + [a == b for a, b in zip(ws, ws[1:])]
        f = [tuple(same[i:i + 3]) for i in range(len(ws) - 2)]
        data[r["doc_id"]] = (g, f)
        raw.update(g), rep[0].update(f)
        if r["doc_id"] in good:
            target.update(g), rep[1].update(f)

    def ratio(xs, a, b):
        scale = sum(b.values()) / sum(a.values())
        return sum(math.log(b[x] + 8) - math.log(a[x] * scale + 8) for x in xs) / max(len(xs), 1)

    for k, (g, f) in data.items():
        want = ratio(g, raw, target) + ratio(f, *rep)
        assert rows[k]["llr"] == pytest.approx(want, abs=0.05)  # buckets may be shared by several n-grams
        assert rows[k]["kept"] == (not rows[k]["base_failed"] and rows[k]["llr"] >= -0.2)


def test_query_and_planted_quality(spark):
    got = op6_quality_rules(spark, SF_SMALL)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bad = got.join(labels, "doc_id").where("(quality = 0 AND kept) OR (quality = 1 AND NOT kept AND NOT base_failed)")
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert bad.count() <= 2


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, "a"), (None, long, "b"), (2, "", "c"), (3, long, "d"), (3, long, "d"), (4, "***", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = fit(docs, none)
    assert not weights.any()
    kept = judge(docs.select("doc_id", "text"), weights, carry=["doc_id"]).where("kept").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3", "None"]
    none.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 3
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert np.isfinite(fit(docs.limit(0), none)).all()


def test_copies_count_once(spark, tmp_path, monkeypatch):
    """A clean unlabelled group of copies that holds a third of all rows is kept, as its text is alone."""
    from sentiforge.llm import quality_rules
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").dropDuplicates(["text"]).cache()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain_weights = fit(docs, labels)  # no text twice
    probe = judge(docs, plain_weights, carry=["doc_id"]).where("kept").join(labels, "doc_id", "left_anti").orderBy("llr").first()
    n = docs.count() // 2
    first = 10 ** 9
    ids = spark.range(first, first + n).withColumnRenamed("id", "_id")
    copies = ids.crossJoin(docs.where(docs["doc_id"] == probe["doc_id"])).withColumn("doc_id", F.col("_id")).select(*docs.columns)
    hot = docs.union(copies).cache()
    assert np.array_equal(fit(hot, labels, distinct=True), plain_weights)
    assert stage(spark, hot, str(tmp_path)).where(F.col("doc_id") >= first).count() == n
    one = labels.union(spark.createDataFrame([(first, 1, 0)], labels.schema))  # any trusted copy makes the text trusted
    alone = labels.union(spark.createDataFrame([(probe["doc_id"], 1, 0)], labels.schema))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert np.array_equal(fit(hot, one, distinct=True), fit(docs, alone))
    docs.unpersist(), hot.unpersist()
