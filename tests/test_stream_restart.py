"""The keyed sink of the word-count stream: restart after a failure, no growth, versions that are needed stay."""

import json

import pytest

from sentiforge.streaming import word_count as wc
from sentiforge.streaming.word_count import current_counts, manifest, run_word_counts


def land(src, name, texts):
    (src / name).write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))


def counted(df):
    return {r["token"]: r["n"] for r in df.collect()}


def plain(texts):
    out = {}
    for t in texts:
        ws = t.split()
        for w in ws if len(ws) > 1 else []:
            out[w] = out.get(w, 0) + 1
    return out


def test_restart_gives_the_batch_result(spark, tmp_path, monkeypatch):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    texts = [[f"w{i} w{j % 7} same" for j in range(5)] + ["single"] for i in range(5)]
    for i in range(3):
        land(src, f"{i}.json", texts[i])
    run_word_counts(spark, str(src), out, state, files_per_batch=1)
    assert counted(current_counts(spark, out)) == plain(sum(texts[:3], []))

    # the next batch dies after its data are written, before its manifest is
    class Died(Exception):
        pass

    real = wc.remove
    land(src, "3.json", texts[3])
    before = counted(current_counts(spark, out))
    create = type(spark).createDataFrame

    def dying(self, data, schema=None, *a, **k):
        if schema == "bucket int, version long":
            raise Died("executor and driver lost")
        return create(self, data, schema, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", dying)
        with pytest.raises(Exception, match="lost"):
            run_word_counts(spark, str(src), out, state, files_per_batch=1)
    assert counted(current_counts(spark, out)) == before          # readers see the last commit
    assert real is wc.remove
    land(src, "4.json", texts[4])
    run_word_counts(spark, str(src), out, state, files_per_batch=1)
    assert counted(current_counts(spark, out)) == plain(sum(texts, []))


def test_no_growth_with_batches(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    for i in range(8):
        land(src, f"{i}.json", ["alpha beta gamma", "beta delta"])
    run_word_counts(spark, str(src), out, state, files_per_batch=1)
    assert counted(current_counts(spark, out)) == {"alpha": 8, "beta": 16, "gamma": 8, "delta": 8}
    assert len(list((tmp_path / "out" / "data").glob("batch=*"))) <= 2
    assert len(list((tmp_path / "out" / "manifest").glob("batch=*"))) <= 2
    assert set(manifest(spark, out).values()) == {7}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "token string, n long")
    two = spark.createDataFrame([("b", 5), ("c", 1)], "token string, n long")
    wc.merge_batch(spark, one, 0, out)
    for _ in range(2):
        wc.merge_batch(spark, two, 1, out)
    assert counted(current_counts(spark, out)) == {"a": 1, "b": 5, "c": 1}
    assert counted(current_counts(spark, str(tmp_path / "none"))) == {}
