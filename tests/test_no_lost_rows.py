"""Rows that earlier readers and encoders lost stay."""

import json

import pytest

from sentiforge.operators import bpe, langid, lmprep
from sentiforge.operators.labels import label_encode
from sentiforge.session import ensure_checkpoint_dir
from sentiforge.sources.readers import annotated_records, json_columns


def test_records_with_any_line_end(spark, tmp_path):
    for name, end in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
        p = tmp_path / f"{name}.txt"
        p.write_bytes(end.join(["meta\t1\tpositive", "good\tEng", "din\tHin", "", "meta\t2\tnegative", "bad\tEng", ""]).encode())
        got = [(r["uid"], r["sentiment"], r["text"], r["_corrupt"]) for r in annotated_records(spark, str(p)).orderBy("uid").collect()]
        assert got == [(1, "positive", "good din", None), (2, "negative", "bad", None)], name


def test_json_columns_with_keys_missing_anywhere(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"uid": {"0": 7, "2": 9}, "text": {"0": "x", "1": "kept"}}))
    (tmp_path / "b.json").write_text(json.dumps({"uid": {"0": 8}}))
    rows = json_columns(spark, str(tmp_path), {"uid": "long", "text": "string"}).collect()
    assert sorted((r["row"], r["uid"], r["text"]) for r in rows if r["uid"]) == [(0, 7, "x"), (0, 8, None), (2, 9, None)]
    assert [(r["row"], r["text"]) for r in rows if r["uid"] is None] == [(1, "kept")]


def test_lines_without_tokens_keep_their_row(spark):
    lines = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, toks array<string>")
    vocab = lmprep.build_vocab(spark.createDataFrame([("a",), ("b",)], "token string"), min_count=1)
    got = {r["k"]: r["ids"] for r in lmprep.encode(lines, ["k"], "toks", vocab).collect()}
    assert len(got[1]) == 2 and got[2] == got[3] == []
    text = spark.createDataFrame([(1, "ab ab"), (2, ""), (3, None)], "k int, text string")
    pieces = {r["k"]: r["pieces"] for r in bpe.encode_pieces(text, ["k"], "text", []).collect()}
    assert pieces[1] and pieces[2] == pieces[3] == []


def test_texts_without_grams_are_detected_as_null(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, "", "en"), (3, None, "en"), (4, "ab", "en")], "id int, text string, lang string")
    counts = langid.doc_gram_counts(docs, "id", "text", "lang")
    got = {r["id"]: r["detected"] for r in langid.detect(counts, "id", langid.train_profiles(counts), docs).collect()}
    counts.unpersist()
    assert got == {1: "en", 2: None, 3: None, 4: "en"}  # two letters still make a padded gram


def test_labels_need_no_forced_broadcast(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "lab string")
    assert sorted((r["lab"] or "", r["label_id"]) for r in label_encode(df, "lab").where("lab IS NOT NULL").collect()) == [("a", 0), ("b", 1), ("b", 1)]


def test_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_encode_holds_one_chunk_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lmprep, "CHUNK_LINES", 3)
    lines = spark.createDataFrame([(k, ["a", "b", "c", None][:k % 5] if k % 7 else None) for k in range(40)], "k long, toks array<string>")
    vocab = lmprep.build_vocab(spark.createDataFrame([("a",), ("b",)], "token string"), min_count=1)
    out = lmprep.encode(lines.repartition(2), ["k"], "toks", vocab)
    got = {r["k"]: r["ids"] for r in out.collect()}
    assert got == {k: [5, 6, 1, 1][:k % 5] if k % 7 else [] for k in range(40)}
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
