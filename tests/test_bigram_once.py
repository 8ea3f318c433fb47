"""One table of pairs is made of the train lines of the bigram model, whatever else is derived from them."""
import math
import re
from collections import Counter

from sentiforge.operators import lmprep as LM

TRAIN = [["a", "b", "a"], ["b"], [], ["c", "a", "b"], ["</s>", "a"], ["<s>"], None]
VALID = [(1, ["a", "b"]), (1, ["x", "a"]), (2, ["c", "c"])]


def test_pairs_are_made_once(spark):
    for some in (TRAIN, TRAIN[:5], TRAIN[:4]):
        train = spark.createDataFrame([(t,) for t in some], "t array<string>")
        out = LM.bigram_perplexity(train, spark.createDataFrame(VALID, "k long, t array<string>"), "t", "k", 0.5)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Aggregate \[w1#\d+, w2#\d+\]", plan)) == 1
        got = {r.k: r for r in out.collect()}
        pairs = Counter(p for t in some if t is not None for p in zip(["<s>", *t], [*t, "</s>"]))
        first, size = Counter(), len({w for _, w in pairs})
        for (w, _), n in pairs.items():
            first[w] += n
        for k in (1, 2):
            mine = [p for j, t in VALID if j == k for p in zip(["<s>", *t], [*t, "</s>"])]
            nll = -sum(math.log((pairs[p] + 0.5) / (first[p[0]] + 0.5 * size)) for p in mine) / len(mine)
            assert got[k].n_tokens == len(mine) and abs(got[k].nll - nll) < 1e-12
