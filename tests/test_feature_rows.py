"""Feature vectors come from the chunks of documents and equal those gathered from the long table of weights."""
import glob
import os

from pyspark.sql import functions as F

from sentiforge.operators import models as ML
from sentiforge.operators import tfidf as TF
from sentiforge.scratch import run_folder, written

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROWS = [(1, 0, "x b a b c d".split()), (2, 1, "y b b e".split()), (3, 0, []), (4, 1, None), (5, 0, ["z"]), (6, 2, ["b", None, "a"]),
        (None, 1, "a e".split()), (7, 0, "a b".split()), (7, 1, "b c".split()), (7, 1, "b c".split())]


def tag(name):
    return name.rsplit("-", 1)[0]


def shuffles(spark):
    """Shuffle files that a later garbage collection has not removed, by name."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {os.path.basename(f) for d in manager.localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_vectors_equal_the_long_table(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "uid long, label int, tokens array<string>").repartition(2)
    model = TF.TfidfModel.fit(docs, "uid", "tokens", sublinear=True, max_df=0.75)
    index = ML.term_index(model.idf)
    place = {r.term: r.idx for r in index.collect()}
    weights = {}
    for r in model.transform(docs, "uid", "tokens").collect():
        weights.setdefault(r.uid, {})[place[r.term]] = round(r.weight, 12)
    monkeypatch.setattr(TF, "CHUNK_TOKENS", 3)
    for some in (docs, docs.where("uid < 7 or uid is null")):
        if some is not docs:
            monkeypatch.setattr(TF, "term_counts", None)   # no row a document and term
        got = [(r.uid, r.label, {int(i): round(float(v), 12) for i, v in zip(r.features.indices, r.features.values)})
               for r in ML.feature_table(model, some, index, len(place)).collect()]
        expected = [(u, y, weights.get(u, {}) if u is not None else {}) for u, y, _ in ROWS if some is docs or u != 7]
        assert sorted(map(str, got)) == sorted(map(str, [(u, y, dict(sorted(w.items()))) for u, y, w in expected]))


def test_no_chunks_stay(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 7], "uid long, label int, tokens array<string>").repartition(2)
    model = TF.TfidfModel.fit(docs, "uid", "tokens")
    index = written(ML.term_index(model.idf), "terms")
    before = spark.conf.get(CLEAN)
    tables = set(map(tag, os.listdir(run_folder(spark).removeprefix("file:"))))
    features = ML.feature_table(model, docs, index, index.count())
    assert set(map(tag, os.listdir(run_folder(spark).removeprefix("file:")))) - tables <= {"features"}
    assert features.count() == 7 and spark.conf.get(CLEAN) == before


def test_shuffle_files_of_a_written_table_go(spark):
    big = spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count(F.lit(1)).alias("n")).hint("rebalance")
    before = shuffles(spark)
    table = written(big, "big")
    assert shuffles(spark) - before == set()
    assert table.count() == 50_000
