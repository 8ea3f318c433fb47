"""Every stage against a plain version of its decision, on planted documents; then the whole run."""

import random
import re

import pytest

from conftest import SF_SMALL
from sentiforge.llm import disclosure, ngram_join, packing, passages, quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    ws = WORD.findall((text or "").lower())
    return frozenset(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if len(ws) >= n else frozenset([tuple(ws)] if ws else [])


def planted(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(120):                               # clean
        rows.append((i, text(rng.randrange(40, 200))))
        labels.append((i, 1, 0))
    for i in range(200, 230):                          # junk
        rows.append((i, " ".join(w + rng.choice(["***", "$$$"]) for w in text(60).split())))
        labels.append((i, 0, 0))
    base = text(150).split()
    for i in range(300, 312):                          # near copies
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = "edit"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, 0))
    rows += [(400, rows[3][1]), (401, rows[3][1])]     # exact copies
    shared = text(60)
    rows += [(500 + i, f"{text(70)} {shared} {text(70)}") for i in range(4)]
    rows += [(600, text(40) + " mail joe@x.org or 10.1.2.3 or +1 555 123 4567"), (700, None), (701, ""), (702, text(30)), (702, text(30))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, shared


def test_stages(spark, tmp_path):
    rows, shared = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    kept = quality_rules.stage(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(k for k, t in rows if not 200 <= k < 230 and k not in (700, 701))

    near = ngram_join.stage(spark, kept, sf).cache()
    assert near.columns == docs.columns
    texts = {}
    for r in kept.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    left = sorted(r["doc_id"] for r in near.collect())
    drop = set()
    keys = sorted(texts)
    group = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            for x in texts[a]:
                for y in texts[b]:
                    u, v = shingles(x), shingles(y)
                    if 100 * len(u & v) >= 80 * len(u | v):
                        old, new = max(group[a], group[b]), min(group[a], group[b])
                        group = {k: new if g == old else g for k, g in group.items()}
    drop = {k for k, g in group.items() if g != k}
    assert left == [k for k in keys if k not in drop] and {400, 401} <= drop and len(drop) >= 5

    unique = passages.stage(spark, near, sf).cache()
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == left
    with_passage = [r["doc_id"] for r in unique.collect() if shared in r["text"]]
    assert with_passage == [500]
    before = {r["doc_id"]: r["text"] for r in near.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in unique.collect() if r["doc_id"] < 200)

    clean = disclosure.stage(spark, unique, sf).cache()
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and sorted(got) == left
    assert got[600].endswith("mail [EMAIL] or [IP] or [PHONE]")
    assert all(got[r["doc_id"]] == r["text"] for r in unique.collect() if r["doc_id"] != 600)

    packed = packing.stage(spark, clean, sf).collect()
    assert sorted({k for r in packed for k in r["doc_ids"]}) == left
    assert all(r["length"] <= 4096 and len(r["ids"]) == 2 * r["length"] for r in packed)
    for d in (kept, near, unique, clean):
        d.unpersist()


def test_empty_and_whole_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_clashing_columns_null_ids_and_long_texts(spark, tmp_path, name, stage, twice):
    """Whatever the other columns are called, they stay with their row; odd rows break nothing."""
    rng = random.Random(5)
    extra = ["_t", "_k", "_terms", "_node", "_gone", "_id", "_tag", "_row", "key", "tag", "_s", "_key", "_text", "kept", "n", "_d0"]
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, text(60)) for i in range(25)] + [(None, text(50)), (None, None), (30, None), (31, ""), (32, text(60_000))]
    rows += [(33, rows[0][1])] + ([(5, text(40)), (5, rows[5][1])] if twice else [])
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *[f"{c}|{k}|{(t or '')[:9]}" for c in extra]) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{c} string" for c in extra))
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    given = {(r["doc_id"], *[r[c] for c in extra]) for r in docs.collect()}
    assert got and all((r["doc_id"], *[r[c] for c in extra]) in given for r in got)
    assert len(got) >= 25
