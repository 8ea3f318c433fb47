"""The vocabulary of encoded lines comes with their chunks: the lines are made once, the ids are those of ``build_vocab``."""

from collections import Counter

from pyspark.sql import functions as F

from sentiforge.operators import lmprep as LM


def test_same_ids_as_a_vocabulary_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(LM, "CHUNK_LINES", 3)
    lines = [(i, 0, ([f"w{j % 5}" for j in range(i % 9)] + ["<unk>", "once%d" % i, "é", "<mask>"])[: i % 12]) for i in range(40)]
    lines += [(40, 0, []), (41, 0, None)]
    df = spark.createDataFrame(lines, "doc_id long, line_no int, tokens array<string>").repartition(4)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(tokens):
        seen.add(1)
        return tokens

    got = LM.encode(df.withColumn("tokens", counted.asNondeterministic()("tokens")), ["doc_id", "line_no"], "tokens", 2)
    got = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert seen.value == len(lines)
    words = Counter(w for _, _, t in lines for w in t or [] if w not in LM.SPECIALS)
    ranked = sorted((w for w in words if words[w] >= 2), key=lambda w: (-words[w], w))
    ids = {w: i for i, w in enumerate(LM.SPECIALS + ranked)}
    assert got == {d: [ids.get(w, LM.UNK) for w in t or []] for d, _, t in lines}
