"""The record source: any cut into ranges gives the same records, for every line end."""

import io

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from sentiforge.sources import readers, sinks
from sentiforge.sources.records import records

BREAKS = ["\n", "\r\n", "\r"]


def plain(raw: bytes):
    """Records by walking over the lines of the whole file."""
    out, begin, pos = [], 0, 0
    while pos < len(raw):
        n = 2 if raw[pos:pos + 2] == b"\r\n" else 1 if raw[pos:pos + 1] in (b"\n", b"\r") else 0
        if not n:
            pos += 1
            continue
        stop, count = pos, 0
        while pos < len(raw) and raw[pos:pos + 1] in (b"\n", b"\r"):
            pos += 2 if raw[pos:pos + 2] == b"\r\n" else 1
            count += 1
        if count >= 2:
            if stop > begin:
                out.append((begin, True, raw[begin:stop]))
            begin = pos
    if begin < len(raw):
        out.append((begin, False, raw[begin:]))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc\td", "\n", "\r\n", "\r", "\n\n", "\r\n\r\n", "é", "x" * 9]), max_size=25).map("".join),
       st.integers(1, 12), st.integers(1, 9))
def test_any_cut_gives_the_same_records(text, split, block):
    raw = text.encode()
    got = [r for s in range(0, len(raw), split) for r in records(io.BytesIO(raw), s, min(s + split, len(raw)), block)]
    assert got == plain(raw)


@pytest.mark.parametrize("br", BREAKS)
def test_three_records_in_ranges(spark, tmp_path, br):
    recs = ["meta\t1\tpositive\nI\tO\nam\tO", "meta\t2\nbroken\tO", "meta\t3\tneutral"]
    (tmp_path / "a.txt").write_bytes("\n\n".join(recs).replace("\n", br).encode())
    rows = [set(map(str, readers.annotated_records(spark, str(tmp_path / "a.txt"), split_bytes=n).collect())) for n in (1 << 20, 17, 5)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 3
    got = {r["uid"]: r for r in readers.annotated_records(spark, str(tmp_path / "a.txt"), split_bytes=9).collect()}
    assert (got[1]["text"], got[1]["sentiment"], got[3]["tokens"]) == ("I am", "positive", [])
    assert got[None]["_corrupt"].startswith("meta\t2")
    parity = {r["uid"]: r["text"] for r in readers.annotated_records(spark, str(tmp_path / "a.txt"), parity=True).collect()}
    assert parity == {1: "I am  ", None: "broken  "}  # two blanks, the unclosed record is left out


def test_folder_glob_list_and_round_trip(spark, tmp_path):
    rows = [(i, "pos" if i % 2 else None, [f"w{j}" for j in range(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, sentiment string, tokens array<string>").repartition(4)
    for n, br in enumerate(BREAKS):
        sinks.write_records(df, str(tmp_path / f"part{n}"), br)
    want = sorted((u, s or "", t) for u, s, t in rows)
    for where, times in ((str(tmp_path / "part1"), 1), (str(tmp_path / "part*" / "*.txt"), 3),
                         ([str(tmp_path / "part0"), "file://" + str(tmp_path / "part2")], 2)):
        got = readers.annotated_records(spark, where, split_bytes=64)
        assert sorted((r["uid"], r["sentiment"], r["tokens"]) for r in got.collect()) == sorted(want * times)
    sinks.write_records(df.drop("sentiment"), str(tmp_path / "test"))
    bare = readers.annotated_records(spark, str(tmp_path / "test"), labelled=False)
    assert sorted((r["uid"], r["tokens"]) for r in bare.collect()) == [(u, t) for u, _, t in want]
    assert readers.input_files(spark, [str(tmp_path / "part0" / "*.txt"), str(tmp_path / "test")]).where("size > 0").count() >= 2


def test_a_record_is_split_once(spark, tmp_path):
    """Whatever is read of a record, its lines are made once; empty lines and a lone blank record leave no row."""
    (tmp_path / "a.txt").write_bytes(b"\r\n\r\nmeta\t1\tx\r\nA\tO\n\tO\rb\r\n\r\nmeta\t2\r\nC\tD\tE\r")
    got = readers.annotated_records(spark, str(tmp_path / "a.txt"))
    plan = got.select("uid", "sentiment", F.size("tokens"), "text", "_corrupt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(split(") == 1 and plan.count("transform(") == 1
    assert [tuple(r) for r in got.orderBy("_corrupt").collect()] == [
        (1, "x", ["A", "", "b"], "A  b", None), (None, None, ["C"], "C", "meta\t2\nC\tD\tE\n")]


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none.txt").write_bytes(b"")
    assert readers.annotated_records(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(Exception, match="gone.txt"):
        readers.annotated_records(spark, str(tmp_path / "gone.txt")).count()


def test_other_sinks(spark, tmp_path):
    """JSON lines, submission, result file and cache: what is written is read back, half-written folders are not."""
    rows = [(3, "neg", "b"), (1, "pos", "a\nb"), (2, None, "")]
    df = spark.createDataFrame(rows, "uid long, sentiment string, text string").repartition(3)
    sinks.write_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, readers.json_records(spark, str(tmp_path / "json"), df.schema, array=False).collect())) == sorted(rows)
    sinks.write_json(df.select("text"), str(tmp_path / "strings"))
    assert spark.read.json(str(tmp_path / "strings")).count() == 3
    sinks.write_submission(df, str(tmp_path / "sub"))
    lines = [x for f in sorted((tmp_path / "sub").glob("*.csv")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x != "uid,sentiment"] == ["1,pos", "2,", "3,neg"]
    one = spark.createDataFrame([(0.5, 7, "x")], "loss double, n long, name string")
    sinks.write_result(sinks.metrics_from(one, "r", 1).select("metric", "value"), str(tmp_path / "res"))
    assert "".join(f.read_text() for f in (tmp_path / "res").glob("part*")) == "loss = 0.5\nn = 7.0\n"
    assert {tuple(r) for r in sinks.read_result(spark, str(tmp_path / "res")).collect()} == {("loss", 0.5), ("n", 7.0)}
    (tmp_path / "res" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        sinks.read_result(spark, str(tmp_path / "res"))
    path = sinks.cache_path(str(tmp_path), ["b", "a"], {"k": 1})
    assert path == sinks.cache_path(str(tmp_path), ["a", "b"], {"k": 1}) != sinks.cache_path(str(tmp_path), ["a", "b"], {"k": 2})
    assert sinks.cached(spark, df, path).count() == 3 and sinks.cached(spark, df.limit(0), path).count() == 3

    broken = df.withColumn("uid", F.when(F.col("uid") == 3, F.raise_error(F.lit("disk lost")).cast("long")).otherwise(F.col("uid")))
    other = sinks.cache_path(str(tmp_path), [], {})
    with pytest.raises(Exception, match="disk lost"):
        sinks.cached(spark, broken, other)
    assert sinks.cached(spark, df, other).count() == 3        # what the broken write left is not taken for the cache
    ranked = readers.error_report(spark, _report(spark, tmp_path), rank=True)
    assert [(r["rank"], r["index"]) for r in ranked.orderBy("rank").collect()] == [(1, 9), (2, 5), (3, 7)]


def _report(spark, tmp_path):
    errs = spark.createDataFrame([(9, 0, "x"), (5, 2, "some text  "), (7, 1, "")], "uid long, pred int, text string").coalesce(1)
    sinks.write_error_report(errs, str(tmp_path / "report"), ["negative", "neutral", "positive"])
    return str(tmp_path / "report")
