"""Readers, sinks and the streaming word count on small files in tmp_path."""

import json

from pyspark.sql import functions as F

from sentiforge.sources import readers as R
from sentiforge.sources import sinks as K
from sentiforge.streaming.word_count import current_counts, run_word_counts


def test_annotated_records(spark, tmp_path):
    p = tmp_path / "conll.txt"
    p.write_text("meta\t1\tpositive\nhello\tEn\nworld\tEn\n\n"
                 "meta\t2\tnegative\nbas\tHi\n\n"
                 "meta\t3\nbroken\tEn\n\n", encoding="utf-8")
    rows = {r.uid: r for r in R.annotated_records(spark, str(p)).collect()}
    assert rows[1].text == "hello world" and rows[1].sentiment == "positive"
    assert rows[2].tokens == ["bas"]
    bad = [r for r in rows.values() if r._corrupt is not None]
    assert len(bad) == 1 and bad[0].uid is None
    test = R.annotated_records(spark, str(p), labelled=False).where(F.col("_corrupt").isNull()).collect()
    assert [r.uid for r in test] == [3] and test[0].sentiment is None


def test_json_layouts(spark, tmp_path):
    (tmp_path / "rec.json").write_text(json.dumps([
        {"uid": 1, "sentiment": "neutral", "text": "a b", "clean_text": "a b"},
        {"uid": 2, "sentiment": "positive", "text": "", "clean_text": None}]))
    assert R.json_records(spark, str(tmp_path / "rec.json")).count() == 2
    (tmp_path / "cols.json").write_text(json.dumps({"uid": {"0": 7, "2": 9}, "text": {"0": "x", "2": "z"}}))
    got = sorted(tuple(r) for r in R.json_columns(spark, str(tmp_path / "cols.json"),
                                                   {"uid": "long", "text": "string"}).collect())
    assert got == [(0, 7, "x"), (2, 9, "z")]
    (tmp_path / "str.json").write_text(json.dumps(["", "hi 🙂", "b"]))
    assert [r.text for r in R.json_strings(spark, str(tmp_path / "str.json")).orderBy("pos").collect()] == ["", "hi 🙂", "b"]


def test_tweet_dir_keeps_bad_lines(spark, tmp_path):
    d = tmp_path / "tweets"
    d.mkdir()
    (d / "a.jsonl").write_text('{"text": "one two", "user": {"id": 1}}\n{broken\n')
    (d / "b.jsonl").write_text('{"text": "solo"}\n')
    rows = R.tweet_dir(spark, str(d)).select("text", "_corrupt_record").collect()
    assert sum(r._corrupt_record is not None for r in rows) == 1
    assert sorted(r.text for r in rows if r.text is not None) == ["one two", "solo"]


def test_csv_with_blank_after_comma(spark, tmp_path):
    (tmp_path / "labels.txt").write_text('Uid, Sentiment\n1, positive\n2, "neg,ative"\n')
    df = R.csv_table(spark, str(tmp_path / "labels.txt"), "Uid long, Sentiment string")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "positive"), (2, "neg,ative")]


def test_text_lines_nonblank(spark, tmp_path):
    (tmp_path / "lm.txt").write_text("a\n\n   \n \nb c\n", encoding="utf-8")
    assert [r.line for r in R.text_lines(spark, str(tmp_path / "lm.txt"), nonblank=True).collect()] == ["a", "b c"]


def test_piece_vocab(spark, tmp_path):
    (tmp_path / "v.vocab").write_text('<unk>\t0\n<s>\t0\n</s>\t0\n"\t0\n▁\t-1\n▁a\t-2\n', encoding="utf-8")
    got = [tuple(r) for r in R.piece_vocab(spark, str(tmp_path / "v.vocab")).orderBy("id").collect()]
    assert [g[1] for g in got] == ["<unk>", "<s>", "</s>", '"', "▁", "▁a"]
    assert [g[0] for g in got] == list(range(6))


def test_error_report_round_trip(spark, tmp_path):
    errs = spark.createDataFrame([(5, 2, "some text  "), (9, 0, "x")], "uid long, pred int, text string")
    out = str(tmp_path / "report")
    K.write_error_report(errs.coalesce(1), out, ["negative", "neutral", "positive"])
    back = sorted(tuple(r) for r in R.error_report(spark, out).collect())
    assert back == [(5, "positive", "some text  "), (9, "negative", "x")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [0.1, 0.2, 0.7]), (1, "a", [0.5, 0.5, 0.0])],
                               "uid long, clean_text string, p array<double>")
    K.write_predictions(df, str(tmp_path / "pred"), ["negative", "neutral", "positive"])
    back = R.csv_table(spark, str(tmp_path / "pred"))
    assert sorted((r.uid, r.sentiment) for r in back.collect()) == [(1, "negative"), (2, "positive")]
    K.write_lines(spark.createDataFrame([("x",), ("",)], "t string"), "t", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["x"]
    K.append_metrics(spark, str(tmp_path / "m"), "r1", 40, {"loss": 0.5, "f1": 0.7})
    K.append_metrics(spark, str(tmp_path / "m"), "r1", 80, {"loss": 0.4})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    c1 = K.cached(spark, df.select("uid"), str(tmp_path / "cache"))
    c2 = K.cached(spark, df.select("uid").limit(1), str(tmp_path / "cache"))  # existing cache is kept
    assert c1.count() == c2.count() == 2


def test_stream_word_counts_match_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"text": "a b a"}\n{"text": "single"}\n')
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run_word_counts(spark, str(src), out, state)
    (src / "2.json").write_text('{"text": "b c"}\n')
    run_word_counts(spark, str(src), out, state)  # resumes from the checkpoint: only the new file
    got = {r.token: r.n for r in current_counts(spark, out).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}
