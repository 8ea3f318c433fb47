"""Planted passages, exact and edited, are found at their places; clean texts are left alone."""

import random

import numpy as np
import pyarrow as pa

from sentiforge.llm import passages as ps
from sentiforge.llm.words import find_words


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def edited(rng, ws, every):
    out = []
    for i, w in enumerate(ws):
        if every and i % every == every // 2:
            out += rng.choice([[], ["changed%d" % rng.randrange(999)], [w, "more%d" % rng.randrange(999)]])
        else:
            out.append(w)
    return out


def planted():
    rng = random.Random(8)
    rows, want = [], {}
    for p in range(4):
        passage = words(rng, [55, 80, 200, 60][p])
        for copy in range(6):
            key = 1000 * (p + 1) + copy
            before, after = words(rng, rng.randrange(0, 300)), words(rng, rng.randrange(0, 300))
            body = edited(rng, passage, [0, 0, 25, 20][p] if copy else 0)
            rows.append((key, " ".join(before + body + after)))
            if copy:
                want[key] = (len(before), len(before) + len(body), 1000 * (p + 1))
    rows += [(50 + i, " ".join(words(rng, 120))) for i in range(20)]            # clean
    line = words(rng, 30)
    rows += [(80 + i, " ".join(words(rng, 50) + line + words(rng, 50))) for i in range(10)]  # short common line
    rows += [(95, "same " * 300), (96, None), (97, ""), (98, "two words")]
    rows.append((1000, rows[0][1]))                                            # a repeated row
    rng.shuffle(rows)
    return rows, want


def test_planted_passages(spark):
    rows, want = planted()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, start int")
    got = {}
    for r in ps.passages(docs).collect():
        got.setdefault(r["key"], []).append(r)
    assert set(got) == set(want)
    for k, (a, z, ref) in want.items():
        assert len(got[k]) == 1
        r = got[k][0]
        assert abs(r["start"] - a) <= 3 and abs(r["end"] - z) <= 3
        assert ref <= r["ref_key"] < k
    exact = [k for k in want if k < 3000]
    assert all((got[k][0]["start"], got[k][0]["end"]) == want[k][:2] for k in exact)
    out = {r["doc_id"]: r for r in ps.without_passages(docs, ps.passages(docs)).collect()}
    text = dict(rows)
    for k, r in out.items():
        if k in exact:
            a, z, _ = want[k]
            assert r["text"].split() == text[k].split()[:a] + text[k].split()[z:]
        elif k not in want:
            assert r["text"] == text[k]


def test_copies_of_whole_texts_and_empty_table(spark):
    rng = random.Random(2)
    t = " ".join(words(rng, 90))
    docs = spark.createDataFrame([(i, t) for i in range(50)] + [(None, t)], "doc_id long, text string")
    got = ps.passages(docs).collect()
    assert sorted((r["key"], r["start"], r["end"], r["ref_key"]) for r in got) == [(i, 0, 90, 0) for i in range(1, 50)]
    assert ps.passages(docs.limit(0)).count() == 0


def test_copied_texts_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ps, "CHAINS_PER_COPY", 3)
    test_copies_of_whole_texts_and_empty_table(spark)


def brute_chain(x, y):
    """Best chain score by comparing all pairs."""
    f = [0.0] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (x[i], -y[i])):
        f[i] = ps.K
        prior = [(f[j] - ps.GAP_COST * (x[i] - x[j] + y[i] - y[j]), j) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i]]
        if prior and max(prior)[0] > 0:
            f[i] += max(prior)[0]
    return max(f)


def test_chains_are_the_best(monkeypatch):
    monkeypatch.setattr(ps, "MAX_GAP", 10**9)
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)
        c = ps.best_chains(x, y)
        assert sorted(i for q in c for i in q) == list(range(n))
        q = c[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(q, q[1:]))
        s = ps.K * len(q) - ps.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(q, q[1:]))
        assert abs(s - brute_chain(x.tolist(), y.tolist())) < 1e-6


def test_every_long_common_run_has_a_seed():
    rng = random.Random(6)
    run = words(rng, ps.K + ps.WINDOW - 1)
    for _ in range(100):
        texts = [" ".join(words(rng, rng.randrange(30)) + run + words(rng, rng.randrange(30))) for _ in range(2)]
        doc, _, h = ps.seeds_of(find_words(pa.array(texts)))
        assert set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())


def test_own_words_between_passages_stay(spark):
    rng = random.Random(9)
    left, right, phrases = words(rng, 60), words(rng, 60), [words(rng, 22) for _ in range(6)]
    common = words(rng, 1)
    rows, own = [], {}
    for i in range(4):
        own[i] = words(rng, 20 + i)
        own[i][5::6] = common * len(own[i][5::6])  # a word both have by chance
        rows.append((i, " ".join(words(rng, 30) + left + own[i] + right + words(rng, 30))))
    form = {}
    for i in range(10, 14):  # shared phrases, each below MIN_WORDS, with own content between
        form[i] = " ".join(w for p in phrases for w in p + words(rng, 12))
        rows.append((i, form[i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in ps.stage(spark, docs, "").collect()}
    text = dict(rows)
    assert got[0] == text[0]
    for i in range(1, 4):
        w = text[i].split()
        assert got[i].split() == w[:30] + own[i] + w[-30:]
    assert all(got[i] == t for i, t in form.items())


def plain_extend(a, b):
    """(words of a, words of b) of the best alignment from the start, by the whole table."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    rest_a, rest_b = a[n:], b[n:]
    table = {(i, j): (n - max(i, j), n) for i in range(len(rest_a) + 1) for j in range(len(rest_b) + 1) if not i or not j}
    best, at = n, (n, n)
    for i, u in enumerate(rest_a, 1):
        for j, v in enumerate(rest_b, 1):
            up, left, diag = table[i - 1, j], table[i, j - 1], table[i - 1, j - 1]
            table[i, j] = max((up[0] - 1, up[1]), (left[0] - 1, left[1]),
                              (diag[0] + 1, diag[1] + 1) if u == v else (diag[0] - 1, diag[1]))
            if table[i, j][0] > best:
                best, at = table[i, j][0], (n + i, n + j)
    return at


def test_ends_are_extended_to_the_best_alignment():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, (300, ps.MARGIN)).astype(np.uint64), rng.integers(0, 6, (300, ps.MARGIN)).astype(np.uint64)
    b[::2, 3:] = a[::2, 2:-1]
    b[1::3, :9] = a[1::3, :9]
    la, lb = rng.integers(0, ps.MARGIN + 1, 300), rng.integers(0, ps.MARGIN + 1, 300)
    n, m = ps.extend_many(a, la, b, lb)
    for i in range(300):
        assert (n[i], m[i]) == plain_extend(a[i, :la[i]].tolist(), b[i, :lb[i]].tolist())


def test_chains_together_and_one_by_one():
    """``align_many`` gives for each chain what ``align`` gives for it alone."""
    rng = random.Random(7)
    texts, chains = [], []
    for t in range(60):
        a = words(rng, rng.randrange(10, 160))
        b = words(rng, rng.randrange(40)) + edited(rng, a, rng.choice([0, 0, 9, 14, 30])) + words(rng, rng.randrange(40))
        ha, hb = (find_words(pa.array([" ".join(x)])).hash for x in (a, b))
        at = {tuple(b[i:i + ps.K]): i for i in range(len(b) - ps.K + 1)}
        seeds = [(i, at[tuple(a[i:i + ps.K])]) for i in range(0, len(a) - ps.K + 1, 5) if tuple(a[i:i + ps.K]) in at]
        if seeds:
            texts.append((ha, hb))
            chains.append(seeds)
    lists = lambda rows, kind: ps._Lists(np.concatenate(rows).astype(kind), np.cumsum([0, *map(len, rows)])[:-1], np.array([*map(len, rows)]))
    xs, ys = lists([[x for x, _ in c] for c in chains], np.int64), lists([[y for _, y in c] for c in chains], np.int64)
    zero = np.zeros(len(chains), np.int64)
    got = ps.align_many(xs, ys, lists([a for a, _ in texts], np.uint64), zero, lists([b for _, b in texts], np.uint64), zero)
    want = []
    for i, (c, (a, b)) in enumerate(zip(chains, texts)):
        (x0, y0), (x1, y1) = c[0], (c[-1][0] + ps.K, c[-1][1] + ps.K)
        ends = (plain_extend(a[:x0][::-1][:ps.MARGIN].tolist(), b[:y0][::-1][:ps.MARGIN].tolist()),
                plain_extend(a[x1:][:ps.MARGIN].tolist(), b[y1:][:ps.MARGIN].tolist()))
        want += [(i, *p) for p in ps.align([x for x, _ in c], [y for _, y in c], a, 0, b, 0, *ends)]
    assert sorted(map(tuple, got.tolist())) == sorted(want) and len(want) > 40


def test_every_long_common_run_is_reported(spark):
    """Against a plain search for all common runs of MIN_WORDS words or more, over random texts of shared parts."""
    rng = random.Random(11)
    parts = [words(rng, rng.choice([15, 30, 46, 50, 70, 130])) for _ in range(12)]
    rows = []
    for key in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += words(rng, rng.randrange(25)) + (rng.choice(parts) if rng.random() < .7 else [])
        rows.append((key, " ".join(text)))
    rows.append((77, " ".join(words(rng, 60_000) + parts[5] + parts[8] + words(rng, 60_000))))  # a very long text
    split = [(k, t.split()) for k, t in rows]
    first, want = {}, {}
    for k, ws in sorted(split):                      # words that lie in a run which a smaller key has
        hit = set()
        for i in range(len(ws) - ps.MIN_WORDS + 1):
            gram = tuple(ws[i:i + ps.MIN_WORDS])
            if first.setdefault(gram, k) < k:
                hit.update(range(i, i + ps.MIN_WORDS))
        want[k] = hit
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {k: set() for k, _ in rows}
    for r in ps.passages(docs).collect():
        got[r["key"]] |= set(range(r["start"], r["end"]))
    assert sum(map(bool, want.values())) > 15
    for k, ws in split:
        assert want[k] <= got[k]
        # nothing else but shared parts (of any length) and the few words between parts that touch
        shared = {w for p in parts for w in p}
        own = [i in got[k] and w not in shared for i, w in enumerate(ws)]
        assert not any(all(own[i:i + ps.JOIN_GAP + 1]) for i in range(len(ws) - ps.JOIN_GAP))


def test_a_frequent_seed_changes_nothing(spark):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = ps.seed_table(ps._rows(docs, "doc_id", "text"))
    every = {f: sorted(map(tuple, ps.seed_matches(seeds, f).collect())) for f in (1, 50, 10**6)}
    assert every[1] == every[50] == every[10**6] and every[1]


def test_nothing_broadcast_changes_nothing(spark, monkeypatch):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = []
    for limit in (ps.BROADCAST_BYTES, -1):
        monkeypatch.setattr(ps, "BROADCAST_BYTES", limit)
        found = ps.written(ps.passages(docs), "test")
        both.append((sorted(map(tuple, found.collect())), sorted(map(str, ps.without_passages(docs, found).collect()))))
    assert both[0] == both[1]
