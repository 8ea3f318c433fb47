"""Fuzzy passages that repeat across documents, by collinear chaining (operator 4).

Seeds are word k-mers, thinned to the smallest hash of every ``WINDOW`` in a
row, so any common run of ``K + WINDOW - 1`` words has a common seed.  All
occurrences of a seed are joined to its first one (smallest key), a star, never
to each other.  Per pair of documents the matches are chained: the best chain
through matches that ascend in both texts, with a cost per skipped word, is
found with a Fenwick tree of prefix maxima.  Chains are cut at wide gaps, the
words between and beyond their seeds are aligned and cut again where more than
``JOIN_GAP`` words of the document have no match, and the aligned spans of a
document that touch (perhaps against different documents) form its passages.

The first document with a passage keeps it; the others have it reported.
Positions count words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm.shared import written
from sentiforge.llm.token_codes import binary_column
from sentiforge.llm.words import Words, doc_windows, find_words, slices

K = 8            # words of a seed
WINDOW = 12      # one seed at least in so many k-mers in a row
MIN_WORDS = 45   # of a passage: a little below 50, so that edited ends do not hide one of 50
MAX_GAP = 40     # words between neighbouring seeds of a chain
GAP_COST = 0.1   # per skipped word, in either text
MARGIN = 20      # words beyond a chain that are aligned: a longer common run has a seed of its own
JOIN_GAP = 3     # spans this close are one passage; a longer stretch of a document's own words parts them
CHAINS_PER_COPY = 2000   # a text that more chains refer to is sent to several tasks
BROADCAST_BYTES = 32 << 20  # of a table that is broadcast; its size is measured first, a larger one is shuffled
FREQUENT = 4096   # seeds that are joined by broadcast at most


def seeds_of(w: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the thinned k-mers of each text (shorter texts: their smallest)."""
    pos, h = doc_windows(w, k)
    doc = w.doc[pos]
    n = len(h)
    if not n:
        return doc, pos, h
    first = np.searchsorted(doc, np.arange(w.n_texts))       # of each text among the k-mers
    end = np.searchsorted(doc, np.arange(w.n_texts), side="right")
    last = end[doc]
    best = np.arange(n)                                      # smallest of the window that starts here, in its text
    span = 1
    while span < window:                                     # doubling: minima of 1, 2, 4, ... k-mers
        step = min(span, window - span)
        other = np.minimum(np.arange(n) + step, last - 1)
        other = best[other]
        best = np.where(h[other] < h[best], other, best)
        span += step
    full = (np.arange(n) + window <= last) | (np.arange(n) == first[doc])
    keep = np.unique(best[full])
    return doc[keep], pos[keep] - w.first[doc[keep]], h[keep]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, tag, _text)``: a document is its key and a hash of its text, so repeated keys stay apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(t).alias("tag"), t.alias("_text")).where("key IS NOT NULL")


def seed_table(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text"):
            doc, pos, h = seeds_of(find_words(b.column(2), lower=True))
            at = pa.array(doc)
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column(0).take(at), b.column(1).take(at),
                                   pa.array(pos, pa.int32())], names=["h", "key", "tag", "pos"])

    return written(rows.mapInArrow(run, "h long, key long, tag long, pos int"), "seeds")


def seed_matches(seeds: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Every occurrence of a shared seed, beside its first occurrence in a smaller document.

    A seed with ``1 / frequent`` of all occurrences or more (there are ``frequent`` of
    these at most) meets its first occurrence by broadcast, so none fills a task."""
    first = written(
        seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "tag", "pos")).alias("f"), F.max(F.struct("key", "tag")).alias("z"))
        .where((F.col("f.key") != F.col("z.key")) | (F.col("f.tag") != F.col("z.tag")))
        .select("h", "n", F.col("f.key").alias("rkey"), F.col("f.tag").alias("rtag"), F.col("f.pos").alias("rpos")), "seeds-first")
    many = F.col("n") >= max(2, -(-seeds.count() // frequent))
    cols = ["key", "tag", "pos", "rkey", "rtag", "rpos"]
    split = seeds.join(F.broadcast(first.where(many).drop("n")), "h", "left")
    rare = split.where("rkey IS NULL").select("h", "key", "tag", "pos").join(first.where(~many), "h")
    return split.select(*cols).union(rare.select(*cols)).where("key <> rkey")


def best_chains(x: np.ndarray, y: np.ndarray, k: int = K) -> list[list[int]]:
    """Chains of matches (indices), each match in one chain at most, best first.

    f(i) = k' + max(0, max over j with x_j < x_i, y_j < y_i of f(j) - cost), the
    cost being ``GAP_COST`` per word from j to i in both texts; adding
    ``GAP_COST * (x + y)`` to f makes it a prefix maximum over y."""
    order = np.lexsort((-y, x))
    ys = np.unique(y)
    rank = (np.searchsorted(ys, y) + 1).tolist()
    size = len(ys)
    tree, holder = [-1e18] * (size + 1), [-1] * (size + 1)
    n = len(x)
    score, back = [0.0] * n, [-1] * n
    xl, yl = x.tolist(), y.tolist()
    for i in order.tolist():
        top, who, r = -1e18, -1, rank[i] - 1
        while r > 0:
            if tree[r] > top:
                top, who = tree[r], holder[r]
            r &= r - 1
        gain = top - GAP_COST * (xl[i] + yl[i])
        s = float(k)
        if who >= 0 and gain > 0 and xl[i] - xl[who] <= MAX_GAP + k and yl[i] - yl[who] <= MAX_GAP + k and xl[who] < xl[i]:
            s += gain
            back[i] = who
        score[i] = s
        value, r = s + GAP_COST * (xl[i] + yl[i]), rank[i]
        while r <= size:
            if value > tree[r]:
                tree[r], holder[r] = value, i
            r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda j: -score[j]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _reach(spans: list[tuple[int, int]], slack: int) -> list[int]:
    """Per span: words of the run of spans it belongs to, spans up to ``slack`` apart being one."""
    order = sorted(range(len(spans)), key=lambda i: spans[i])
    out, run, lo, hi = [0] * len(spans), [], None, None
    for i in [*order, None]:
        if i is not None and run and spans[i][0] <= hi + slack:
            run.append(i)
            hi = max(hi, spans[i][1])
            continue
        for j in run:
            out[j] = hi - lo
        if i is not None:
            run, (lo, hi) = [i], spans[i]
    return out


def chain_table(matches: DataFrame) -> DataFrame:
    """Written ``(key, tag, rkey, rtag, xs, ys)``: chains that may be part of a passage."""
    def run(batches: Iterator[pa.RecordBatch]):
        held: list = []

        def chains(rows):
            x, y = rows[:, 1], rows[:, 4]
            cut = np.flatnonzero(np.diff(rows[:, 2]) | np.diff(rows[:, 3])) + 1
            found = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
                if b - a == 1:
                    found.append([a])
                else:
                    found += [[a + i for i in c] for c in best_chains(x[a:b], y[a:b])]
            at = x.tolist()
            spans = [(at[c[0]] - MARGIN, at[c[-1]] + K + MARGIN) for c in found]
            return [c for c, n in zip(found, _reach(spans, JOIN_GAP)) if n >= MIN_WORDS]

        def close():
            rows = np.concatenate(held)
            got = chains(rows[:, 1:])
            if not got:
                return None
            head = rows[[c[0] for c in got]]
            ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
            inside = rows[[i for c in got for i in c]]
            return pa.record_batch([*(pa.array(head[:, j]) for j in (0, 1, 3, 4)),
                                    pa.ListArray.from_arrays(ends, pa.array(inside[:, 2])),
                                    pa.ListArray.from_arrays(ends, pa.array(inside[:, 5]))],
                                   names=["key", "tag", "rkey", "rtag", "xs", "ys"])

        for b in batches:
            a = np.column_stack([np.asarray(c).astype(np.int64) for c in b.columns])
            if not len(a):
                continue
            for part in np.split(a, np.flatnonzero(np.diff(a[:, 0]) | np.diff(a[:, 1])) + 1):
                if held and (held[-1][0, :2] != part[0, :2]).any():
                    row = close()
                    if row is not None:
                        yield row
                    held = []
                held.append(part)
        if held:
            row = close()
            if row is not None:
                yield row

    cols = ["key", "tag", "pos", "rkey", "rtag", "rpos"]
    ordered = matches.select(*cols).repartition("key", "tag").sortWithinPartitions("key", "tag", "rkey", "rtag", "pos")
    return written(ordered.mapInArrow(run, "key long, tag long, rkey long, rtag long, xs array<long>, ys array<long>"), "chains")


def csr(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``start[i] .. start[i] + size[i]`` end to end."""
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)


def _global(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the most words in common, in order (longest common subsequence)."""
    table = [[0] * (len(b) + 1)]
    for u in a:
        last, row = table[-1], [0]
        for j, v in enumerate(b):
            row.append(last[j] + 1 if u == v else (row[j] if row[j] >= last[j + 1] else last[j + 1]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j and table[i][j]:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matching places of two stretches that are aligned with each other."""
    if len(a) == len(b):
        return [(i, i) for i in np.flatnonzero(a == b).tolist()]
    return _global(a.tolist(), b.tolist())


_STEP = 64  # a score and a number of matches as one number: score * _STEP + matches


def extend_many(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of a, words of b) of the best alignment from the start of each row: +1 a match, -1 an edit.

    Row i compares ``a[i, :la[i]]`` with ``b[i, :lb[i]]``; words alike from the start always count."""
    width = a.shape[1]
    here = np.arange(width)
    alike = (a == b) & (here < np.minimum(la, lb)[:, None])
    n = np.where(alike.all(axis=1), width, np.argmin(alike, axis=1))
    best_a, best_b = n.copy(), n.copy()
    left_a, left_b = here < (la - n)[:, None], here < (lb - n)[:, None]
    ra = np.take_along_axis(a, np.minimum(n[:, None] + here, width - 1), axis=1)   # what is left, from its start
    rb = np.take_along_axis(b, np.minimum(n[:, None] + here, width - 1), axis=1)
    same = (ra[:, :, None] == rb[:, None, :]) & left_a[:, :, None] & left_b[:, None, :]
    todo = np.flatnonzero(same.any(axis=(1, 2)))
    if not len(todo):
        return best_a, best_b
    same, n, ka, kb = same[todo], n[todo].astype(np.int64), (la - n)[todo], (lb - n)[todo]
    best, ga, gb = n.copy(), np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    row = [(n - j) * _STEP + n for j in range(width + 1)]
    for i in range(1, int(ka.max()) + 1):
        diag, row[0] = row[0], (n - i) * _STEP + n
        for j in range(1, int(kb.max()) + 1):
            keep = row[j]
            row[j] = np.maximum(np.maximum(row[j], row[j - 1]) - _STEP, diag + np.where(same[:, i - 1, j - 1], _STEP + 1, -_STEP))
            diag = keep
            better = (row[j] // _STEP > best) & (i <= ka) & (j <= kb)
            best[better], ga[better], gb[better] = row[j][better] // _STEP, i, j
    best_a[todo] += ga
    best_b[todo] += gb
    return best_a, best_b


def align(xs: list[int], ys: list[int], a: np.ndarray, a0: int, b: np.ndarray, b0: int,
          before: tuple[int, int], after: tuple[int, int], k: int = K):
    """``(start, end, ref start, ref end, matches)`` of each repeated piece of a chain, from the words around it.

    ``a[0]`` is word ``a0`` of the document, ``b[0]`` word ``b0`` of the other;
    ``before`` and ``after`` are the words of each that ``extend_many`` adds at the ends."""
    x, y = xs[0], ys[0]
    runs = []  # (x, y, words alike from there)
    between = lambda x0, x1, y0, y1: [(x0 + i, y0 + j, 1) for i, j in _pairs(a[x0 - a0:x1 - a0], b[y0 - b0:y1 - b0])]
    n, m = before
    runs += between(x - n, x, y - m, y)
    for i, j in zip(xs, ys):  # (x, y): aligned so far
        if i > x and j > y:
            runs += between(x, i, y, j)
        step = min(k, i + k - x, j + k - y)
        if step > 0:
            runs.append((i + k - step, j + k - step, step))
        x, y = max(x, i + k), max(y, j + k)
    n, m = after
    return _pieces(runs + between(x, x + n, y, y + m), k)


class _Lists:
    """A list or binary column as flat values: row i is ``flat[at[i]:at[i] + size[i]]``."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.flat, self.at, self.size = flat, at, size

    @classmethod
    def of(cls, column: pa.Array, rows: np.ndarray) -> _Lists:
        if pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 8
            data = column.buffers()[2]
            flat = np.frombuffer(data, np.uint64, len(data) // 8) if data is not None and len(data) else np.zeros(0, np.uint64)
        else:
            off, flat = np.asarray(column.offsets), np.asarray(column.values)
        return cls(flat, off[rows].astype(np.int64), (off[rows + 1] - off[rows]).astype(np.int64))

    @classmethod
    def of_structs(cls, column: pa.Array) -> _Lists:
        """A list of structs of whole numbers: ``flat`` has one array per field, from the first row on."""
        off = np.asarray(column.offsets).astype(np.int64)
        inner = column.values.slice(off[0], off[-1] - off[0])
        return cls([np.asarray(x) for x in inner.flatten()], off[:-1] - off[0], np.diff(off))

    def first(self):
        return self.flat[self.at]

    def last(self):
        return self.flat[self.at + self.size - 1]

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.at[i]:self.at[i] + self.size[i]]

    def edge(self, start: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(``MARGIN`` words of each row from place ``start`` on, or back from it; how many there are)."""
        n = np.clip(self.size - start if step > 0 else start, 0, MARGIN)
        j = np.arange(MARGIN)
        place = self.at[:, None] + start[:, None] + (j if step > 0 else -1 - j)
        ok = j < n[:, None]
        return np.where(ok, self.flat[np.where(ok, place, 0)], 0) if len(self.flat) else np.zeros(place.shape, np.uint64), n


def align_many(xs: _Lists, ys: _Lists, a: _Lists, a0: np.ndarray, b: _Lists, b0: np.ndarray, k: int = K):
    """(chain, start, end, ref start, ref end, matches) of the pieces of all chains.

    A chain without insertions is compared word by word in one go with the
    others of its kind; only what has several runs, or an insertion, is cut on its own."""
    x0, y0, x1, y1 = xs.first(), ys.first(), xs.last() + k, ys.last() + k
    (la, na), (lb, nb) = a.edge(x0 - a0, -1), b.edge(y0 - b0, -1)
    n, m = extend_many(la, na, lb, nb)
    (ra, na), (rb, nb) = a.edge(x1 - a0, 1), b.edge(y1 - b0, 1)
    n2, m2 = extend_many(ra, na, rb, nb)
    slant = xs.flat[csr(xs.at, xs.size)] - ys.flat[csr(ys.at, ys.size)]
    begin = np.cumsum(xs.size) - xs.size
    even = (np.minimum.reduceat(slant, begin) == np.maximum.reduceat(slant, begin)) & (n == m) & (n2 == m2)
    out = []
    for i in np.flatnonzero(~even).tolist():
        for piece in align(xs.row(i).tolist(), ys.row(i).tolist(), a.row(i), int(a0[i]), b.row(i), int(b0[i]),
                           (int(n[i]), int(m[i])), (int(n2[i]), int(m2[i])), k):
            out.append((i, *piece))
    rows = np.flatnonzero(even)
    size = (x1 + n2 - (x0 - n))[rows]
    same = (a.flat[csr((a.at + x0 - n - a0)[rows], size)] == b.flat[csr((b.at + y0 - m - b0)[rows], size)])
    # runs of words alike, none over the end of a chain
    begin = np.cumsum(size) - size
    edge = np.zeros(len(same) + 1, bool)
    edge[begin] = edge[-1] = True
    first = same.copy()
    first[1:] &= ~same[:-1] | edge[1:-1]
    last = same.copy()
    last[:-1] &= ~same[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(begin, s, side="right") - 1
    x = s - begin[of] + (x0 - n)[rows][of]
    y = x - (x0 - y0)[rows][of]
    length = e - s
    alone = np.bincount(of, minlength=len(rows))[of] == 1
    whole = np.flatnonzero(alone & (length >= k))
    got = [np.stack((rows[of[whole]], x[whole], x[whole] + length[whole], y[whole], y[whole] + length[whole], length[whole]), axis=1)]
    rest = np.flatnonzero(~alone)
    runs = list(zip(x[rest].tolist(), y[rest].tolist(), length[rest].tolist()))
    chain = rows[of[rest]]
    cut = np.flatnonzero(np.diff(chain)) + 1
    for p, q in zip([0, *cut.tolist()], [*cut.tolist(), len(rest)] if len(rest) else []):
        out += [(int(chain[p]), *piece) for piece in _pieces(runs[p:q], k)]
    return np.concatenate((*got, np.array(out, np.int64).reshape(-1, 6)))


def _pieces(runs: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, int, int]]:
    """Cuts a chain's runs where the document's unmatched words outnumber the matched ones by more than ``JOIN_GAP``.

    Scattered chance matches do not bridge a document's own words; pieces below ``k`` words have no seed."""
    out, piece, score, best, end, matches = [], None, 0, 0, 0, 0
    for x, y, n in runs:
        if piece is not None:
            score -= x - end
            if best - score > JOIN_GAP or score < 0:
                out.append(piece)
                piece = None
        if piece is None:
            piece, score, best, matches = (x, x, y, y, 0), 0, 0, 0
        score, end, matches = score + n, x + n, matches + n
        if score >= best:
            best, piece = score, (piece[0], x + n, piece[2], y + n, matches)
    return [p for p in [*out, piece] if p is not None and p[1] - p[0] >= k]


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, to be broadcast if its rows take ``BROADCAST_BYTES`` together at most."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _beside(texts: DataFrame, chains: DataFrame, work, schema: str) -> DataFrame:
    """Streams each text (kind 0) and then the chains that refer to it (kind 1) through ``work``.

    A text with many chains is copied to several tasks, its chains dealt among them."""
    copies = chains.groupBy("key", "tag").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHAINS_PER_COPY)).cast("int").alias("_n"))
    copies = _small(copies, F.lit(32))
    null = lambda t: F.lit(None).cast(t)
    held = (texts.join(copies, ["key", "tag"]).dropDuplicates(["key", "tag"])
            .select(F.lit(0).alias("kind"), "key", "tag", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"), "_text",
                    null("long").alias("okey"), null("long").alias("otag"), null("array<long>").alias("xs"),
                    null("array<long>").alias("ys"), null("binary").alias("words"), null("long").alias("base")))
    asked = (chains.join(copies, ["key", "tag"])
             .select(F.lit(1).alias("kind"), "key", "tag", F.pmod(F.xxhash64("okey", "otag", "xs"), F.col("_n")).cast("int").alias("copy"),
                     null("string").alias("_text"), "okey", "otag", "xs", "ys", "words", "base"))

    def run(batches: Iterator[pa.RecordBatch]):
        at, words = None, np.zeros(0, np.uint64)     # the text that the next batch may go on with
        for b in batches:
            kind, key, tag = (np.asarray(b.column(i)) for i in range(3))
            heads = np.flatnonzero(kind == 0)
            w = find_words(b.column(4).take(pa.array(heads)), lower=True)
            flat = np.concatenate((words, w.hash))
            first = np.concatenate(([0], w.first[:-1] + len(words)))
            size = np.concatenate(([len(words)], np.diff(w.first)))
            rows = np.flatnonzero(kind == 1)
            of = np.searchsorted(heads, rows)         # 0: the text carried over
            names = np.concatenate(([at or (0, 0)], np.stack((key[heads], tag[heads]), axis=1)))
            ok = (names[of, 0] == key[rows]) & (names[of, 1] == tag[rows]) & ((of > 0) | (at is not None))
            rows, of = rows[ok], of[ok]
            if len(rows):
                yield work(b, rows, _Lists(flat, first[of], size[of]))
            if len(heads):
                at, words = (int(key[heads[-1]]), int(tag[heads[-1]])), flat[first[-1]:].copy()

    return (held.union(asked).repartition("key", "tag", "copy").sortWithinPartitions("key", "tag", "copy", "kind")
            .mapInArrow(run, schema))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, tag, start, end, n_matches, ref_key, ref_start, ref_end)``: the
    passages of each document (words ``start:end``) that a smaller key has too.

    ``ref_*`` is the longest aligned span of the passage.  Null and short texts
    have no passage; null keys take no part; rows alike in key and text count
    once, rows of one key are not compared with each other.  ``tag`` is
    ``xxhash64`` of the text."""
    rows = _rows(docs, key, text)
    chains = chain_table(seed_matches(seed_table(rows)))

    def around(at: _Lists, words: _Lists) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of the stretch of each text that a chain's places may reach."""
        lo = np.maximum(at.first() - MARGIN, 0)
        return lo, np.maximum(np.minimum(at.last() + K + MARGIN, words.size) - lo, 0)

    def cut(b: pa.RecordBatch, rows: np.ndarray, words: _Lists) -> pa.RecordBatch:
        lo, size = around(_Lists.of(b.column("xs"), rows), words)
        held = binary_column(words.flat[csr(words.at + lo, size)], np.concatenate(([0], np.cumsum(size))))
        names = ["okey", "otag", "key", "tag", "xs", "ys"]
        return pa.record_batch([*(b.column(c).take(pa.array(rows)) for c in names), pa.array(lo), held],
                               names=["key", "tag", "okey", "otag", "xs", "ys", "base", "words"])

    def match(b: pa.RecordBatch, rows: np.ndarray, words: _Lists) -> pa.RecordBatch:
        xs, ys = _Lists.of(b.column("xs"), rows), _Lists.of(b.column("ys"), rows)
        lo, size = around(ys, words)
        found = align_many(xs, ys, _Lists.of(b.column("words"), rows), np.asarray(b.column("base").take(pa.array(rows))),
                           _Lists(words.flat, words.at + lo, size), lo)
        row = pa.array(rows[found[:, 0]])
        return pa.record_batch([b.column("okey").take(row), b.column("otag").take(row), pa.array(found[:, 1]), pa.array(found[:, 2]),
                                pa.array(found[:, 5]), b.column("key").take(row), pa.array(found[:, 3]), pa.array(found[:, 4])],
                               names=["key", "tag", "start", "end", "n_matches", "ref_key", "ref_start", "ref_end"])

    need = chains.select("key", "tag").union(chains.select("rkey", "rtag")).distinct()
    need = _small(need, F.lit(32))
    texts = rows.join(need, ["key", "tag"], "left_semi")
    empty = [F.lit(None).cast("binary").alias("words"), F.lit(None).cast("long").alias("base")]
    mine = chains.select("key", "tag", F.col("rkey").alias("okey"), F.col("rtag").alias("otag"), "xs", "ys", *empty)
    slices_ = written(_beside(texts, mine, cut, "key long, tag long, okey long, otag long, xs array<long>, ys array<long>, base long, words binary"), "slices")
    spans = _beside(texts, slices_, match, "key long, tag long, start long, end long, n_matches long, ref_key long, ref_start long, ref_end long")
    return _merge(spans.where("2 * n_matches >= end - start"))


def _merge(spans: DataFrame) -> DataFrame:
    item = F.struct("start", "end", "n_matches", "ref_key", "ref_start", "ref_end")
    # a document's spans are bounded by its own seeds
    grouped = spans.groupBy("key", "tag").agg(F.sort_array(F.collect_list(item)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists = _Lists.of_structs(b.column(2))
            start, end, n, rkey, rstart, rend = lists.flat
            if not len(start):
                continue
            doc = np.repeat(np.arange(b.num_rows), lists.size)
            # each document on a stretch of its own, so that one running end serves all
            far = doc * (int(end.max()) + JOIN_GAP + 2)
            top = np.maximum.accumulate(end + far)
            begin = np.flatnonzero(np.concatenate(([True], (start + far)[1:] > top[:-1] + JOIN_GAP)))
            stop = np.append(begin[1:], len(start))
            last = (top - far)[stop - 1]
            run_of = np.repeat(np.arange(len(begin)), stop - begin)
            order = np.lexsort((np.arange(len(start)), rkey, start - end, run_of))
            long = order[begin]                       # the longest span of each run, the smallest key of equals
            keep = last - start[begin] >= MIN_WORDS
            begin, last, long = begin[keep], last[keep], long[keep]
            row = pa.array(doc[begin])
            yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), pa.array(start[begin]), pa.array(last),
                                   *(pa.array(x[long]) for x in (n, rkey, rstart, rend))],
                                  names=["key", "tag", "start", "end", "n_matches", "ref_key", "ref_start", "ref_end"])

    return grouped.mapInArrow(run, "key long, tag long, start long, end long, n_matches long, ref_key long, ref_start long, ref_end long")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that repeat one of a smaller doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return passages(docs).select(F.col("key").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                                 "n_matches", F.col("ref_key").alias("ref_doc_id"), F.col("ref_start").alias("ref_start_word"),
                                 F.col("ref_end").alias("ref_end_word"))


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, the passages of each text taken out (a text may become empty); columns stay."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    spans = (found.groupBy("key", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
             .select(F.col("key").alias("_pk"), F.col("tag").alias("_pt"), "_s"))
    spans = _small(spans, 48 + 32 * F.size("_s"))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    k, t = names[key], names[text]
    rows = rows.join(spans, (F.col(k) == F.col("_pk")) & (F.xxhash64(F.coalesce(F.col(t), F.lit(""))) == F.col("_pt")), "left").drop("_pk", "_pt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, texts, cuts = [], b.column(t).to_pylist(), b.column("_s").to_pylist()
            for x, spans_ in zip(texts, cuts):
                if spans_:
                    raw = x.encode()
                    w = find_words(pa.array([x]), hashes=False)
                    at, kept = 0, []
                    for s in spans_:
                        kept.append(raw[at:w.start[s["start"]]])
                        at = int(w.end[s["end"] - 1])
                    x = b"".join([*kept, raw[at:]]).decode()
                out.append(x)
            cols = [pa.array(out, pa.string()) if n == t else b.column(n) for n in b.schema.names[:-1]]
            yield pa.record_batch(cols, names=b.schema.names[:-1])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in names.items()])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without the passages that a smaller doc_id has."""
    return without_passages(docs, written(passages(docs), "passages"))
