"""Byte-pair-style sub-word vocabulary: learn merges on Spark, apply them.

Learning works on the distinct-word table ``(word, n)``, which is far
smaller than the corpus.  A word is a blank-joined symbol string starting
with the word-start mark.  Adjacent symbol pairs weighted by word frequency
are counted once.  The merge is always that of the most frequent pair (ties: smaller
pair text), non-overlapping, left to right.  The words lie in parts on the executors;
one job tries many merges that cannot affect each other, and the driver, which holds the
counts of the pairs, keeps as many of them as one merge at a time would have made.

Applying merges: each distinct word is segmented by repeatedly merging its
lowest-ranked adjacent pair (the standard BPE rule).  The merge ranks go to the tasks
(their number is the learned vocabulary size, a fixed bound); a task segments the distinct
words of a chunk of its lines together and fills them in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiforge.functions.text import split_ws
from sentiforge.scratch import remove, written
from sentiforge.session import ensure_checkpoint_dir

WORD_START = "▁"  # fixed value: the word-start mark of sentencepiece-style pieces
CHUNK_WORDS = 1 << 18  # words of lines that are segmented together; a longer line is a chunk of its own


def symbols(word: Column) -> Column:
    """Blank-joined code points of ``WORD_START + word``."""
    chars = F.regexp_extract_all(F.concat(F.lit(WORD_START), word), F.lit("(?s)."), 0)
    return F.array_join(chars, " ")


def word_table(texts: DataFrame, text_col: str) -> DataFrame:
    """``(word, n, sym)`` over lower-cased whitespace words."""
    words = texts.select(F.explode(split_ws(F.lower(F.col(text_col)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("word", "n", symbols(F.col("word")).alias("sym"))


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair, n)``: adjacent symbol pairs (``"a b"``) weighted by word frequency."""
    s = F.split(F.col("sym"), " ")
    m = F.greatest(F.size(s) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(s, 1, m), F.slice(s, 2, m), lambda a, b: F.concat_ws(" ", a, b))
    return (words.select(F.explode(pairs).alias("pair"), "n")
            .groupBy("pair").agg(F.sum("n").alias("n")))


# -- learning -------------------------------------------------------------------------
# A symbol is a number: a character's code point, or NEW + a place in the list of merged pieces.  A part of the
# words is ``(sym, n)``: the words' symbols one after the other, -1 behind each word, and each word's frequency.
NEW = 0x110000
SHIFT = 21          # bits of a symbol: code points and 900,000 merged pieces
PART_WORDS = 1 << 19  # distinct words of a task
FEW_TASKS = 32      # up to here the tasks' changes go to the driver as they are


def _key(left, right):
    return (np.asarray(left, np.int64) << SHIFT) | right


def _packed(batches: Iterator) -> Iterator:
    """Batches of ``(n, sym)`` as parts of the words, pickled; words of one symbol are left out."""
    import pickle

    import pyarrow as pa
    for b in batches:
        text, n = b.column(1).to_pylist(), np.asarray(b.column(0), np.int64)
        size = (np.fromiter(map(len, text), np.int64, len(text)) + 1) // 2
        codes = np.frombuffer("".join([t + " " for t in text]).encode("utf-32-le"), "<u4").reshape(-1, 2)[:, 0].astype(np.int32)
        keep = size > 1
        codes, size, n = codes[np.repeat(keep, size)], size[keep], n[keep]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((np.insert(codes, np.cumsum(size), -1), n))], pa.binary())], names=["data"])


def _hits(sym: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places where a pair of ``batch`` is merged, and the pair's place in it.

    The pairs share no occurrence, so they can be looked for at once; a run of one symbol is paired from its start."""
    left, right = np.zeros(1 << SHIFT, bool), np.zeros(1 << SHIFT, bool)
    left[[p[0] for p in batch]], right[[p[1] for p in batch]] = True, True
    at = np.flatnonzero(left[sym[:-1]] & right[sym[1:]])       # -1 is the last place, which no symbol has
    keys = _key([p[0] for p in batch], [p[1] for p in batch])
    order = np.argsort(keys)
    found = _key(sym[at], sym[at + 1])
    place = np.minimum(np.searchsorted(keys, found, sorter=order), len(keys) - 1)
    step = order[place]
    same = keys[step] == found
    at, step = at[same], step[same]
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)         # only pairs of one symbol follow each other directly
    at_run = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
    return at[at_run % 2 == 0], step[at_run % 2 == 0]


def _apply(part: tuple, batch: list[tuple[int, int, int]]) -> tuple:
    """The part with the pairs ``(left, right, merged)`` of ``batch`` merged."""
    sym, n = part
    if not batch or not len(sym):
        return part
    at, step = _hits(sym, batch)
    sym = sym.copy()
    sym[at] = np.array([p[2] for p in batch], np.int32)[step]
    sym = np.delete(sym, at + 1)
    ends = np.flatnonzero(sym < 0)
    size = np.diff(ends, prepend=-1)
    keep = size > 2                                            # one symbol and the end: no pair is left
    return (sym, n) if keep.all() else (sym[np.repeat(keep, size)], n[keep])


def _changes(part: tuple, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(step, pair, change)``: how the counts of pairs change where the pairs of ``batch`` are merged one after the other."""
    sym, n = part
    if not len(sym):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    at, step = _hits(sym, batch)
    w = n[np.searchsorted(np.flatnonzero(sym < 0), at)]
    made = np.array([p[2] for p in batch], np.int64)
    when = np.full(len(sym) + 1, -1, np.int32)
    when[at] = step
    out = [(step, _key(sym[at], sym[at + 1]), -w)]
    # the symbol before, where it is not merged itself (else it is the other's symbol behind)
    i = np.flatnonzero((at > 0) & (sym[at - 1] >= 0) & ((at < 2) | (when[at - 2] < 0)))
    before = sym[at[i] - 1]
    out += [(step[i], _key(before, sym[at[i]]), -w[i]), (step[i], _key(before, made[step[i]]), w[i])]
    # the symbol behind, which may be merged earlier, at once or later
    i = np.flatnonzero(sym[at + 2] >= 0)
    p, mine, w = at[i], step[i], w[i]
    theirs = when[p + 2]
    alone = theirs < 0
    first = np.where(alone, mine, np.minimum(mine, theirs))
    both = np.where(alone, mine, np.maximum(mine, theirs))
    behind = np.where(alone, sym[p + 2], made[theirs])
    out += [(first, _key(sym[p + 1], sym[p + 2]), -w), (both, _key(made[mine], behind), w)]
    for j, pair in ((np.flatnonzero(~alone & (mine < theirs)), lambda j: _key(made[mine[j]], sym[p[j] + 2])),
                    (np.flatnonzero(~alone & (mine > theirs)), lambda j: _key(sym[p[j] + 1], made[theirs[j]]))):
        out += [(first[j], pair(j), w[j]), (both[j], pair(j), -w[j])]
    return _summed(*[np.concatenate(x).astype(np.int64) for x in zip(*out)])


def _summed(step: np.ndarray, pair: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of one pair in one step added up; in order of pair and step."""
    order = np.lexsort((step, pair))
    step, pair, change = step[order], pair[order], change[order]
    new = np.flatnonzero((np.diff(step, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    return step[new], pair[new], np.add.reduceat(change, new) if len(new) else change


class _Pairs:
    """Counts of the pairs and texts of the symbols, on the driver: 16 bytes a pair that occurs.

    Their number is bounded by the square of the vocabulary's size, whatever the length of the text."""

    def __init__(self, counts: list[tuple[str, int]]):
        pair = np.array([_key(*map(ord, p.split(" "))) for p, _ in counts], np.int64)
        order = np.argsort(pair)
        self.pair, self.n = pair[order], np.array([n for _, n in counts], np.int64)[order]
        self.pieces: list[str] = []
        self.number: dict[str, int] = {}

    def text(self, symbol: int) -> str:
        return chr(symbol) if symbol < NEW else self.pieces[symbol - NEW]

    def texts(self, pair: int) -> tuple[str, str]:
        return self.text(pair >> SHIFT), self.text(pair & ((1 << SHIFT) - 1))

    def merged(self, pair: int) -> int:
        """The symbol of the merged pair; pieces of one text are one symbol."""
        text = "".join(self.texts(pair))
        if text not in self.number:
            self.number[text] = NEW + len(self.pieces)
            self.pieces.append(text)
        return self.number[text]

    def best(self, most: int) -> list[tuple[int, int]]:
        """The most frequent pairs ``(pair, n)``, ties in order of their texts; all that tie with the last."""
        n = self.n
        low = max(2, int(np.partition(n, len(n) - most)[len(n) - most])) if len(n) > most else 2
        at = np.flatnonzero(n >= low)
        return sorted(((int(self.pair[i]), int(n[i])) for i in at), key=lambda x: (-x[1], " ".join(self.texts(x[0]))))

    def add(self, pair: np.ndarray, change: np.ndarray) -> None:
        _, pair, change = _summed(np.zeros(len(pair), np.int64), pair, change)
        at = np.searchsorted(self.pair, pair)
        known = at < len(self.pair)
        known[known] = self.pair[at[known]] == pair[known]
        self.n[at[known]] += change[known]
        self.pair, self.n = np.insert(self.pair, at[~known], pair[~known]), np.insert(self.n, at[~known], change[~known])
        left = self.n > 0
        self.pair, self.n = self.pair[left], self.n[left]

    def count(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.n[at], 0)


def _batch(pairs: _Pairs, most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Up to ``most`` pairs to try at once, most frequent first, and those passed over.

    A pair is passed over if a merge before it changes its count: it shares a symbol that the merge takes or makes."""
    batch, over = [], []
    ends, starts, made = set(), set(), set()
    for pair, n in pairs.best(4 * most):
        left, right = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
        if left in ends or right in starts or left in made or right in made:
            over.append((pair, n))
            continue
        batch.append((pair, n))
        if len(batch) == most:
            break
        starts.add(left)
        ends.add(right)
        known = pairs.number.get("".join(pairs.texts(pair)))
        if known is not None:
            made.add(known)
    return batch, over


def _accepted(pairs: _Pairs, batch: list, over: list, step: np.ndarray, pair: np.ndarray, change: np.ndarray) -> int:
    """How many merges of the batch come one after the other: as long as no other pair is more frequent by then.

    The changes are in order of pair and step, so a pair's count holds from one of them to its next."""
    n = np.array([x[1] for x in batch])
    new = np.diff(pair, prepend=-1) != 0
    sums = np.cumsum(change)
    begin = np.flatnonzero(new)
    before = np.repeat(sums[begin] - change[begin], np.diff(begin, append=len(pair)))
    value = pairs.count(pair) + sums - before
    until = np.append(np.where(new[1:], len(batch), step[1:]), len(batch)) if len(pair) else step
    if over:
        # a pair passed over keeps its count up to its first change
        key = np.array([x[0] for x in over], np.int64)
        at = np.searchsorted(pair, key)
        end = np.where((at < len(pair)) & (np.append(pair, -1)[at] == key), np.append(step, 0)[at], len(batch))
        step, pair, value, until = (np.concatenate(x) for x in ((step, np.full(len(over), -1)), (pair, key),
                                                                (value, [x[1] for x in over]), (until, end)))
    # merge j (from 0) is made after step j - 1: a count that holds from ``step`` up to ``until`` meets merges step + 1 to until
    low = np.flatnonzero(value >= n[-1])
    step, pair, value, until = step[low] + 1, pair[low], value[low], np.minimum(until[low], len(batch) - 1)
    more = np.maximum(np.searchsorted(-n, -value, "right"), step)             # the first merge of a smaller count
    best = int(more[more <= until].min(initial=len(batch)))
    tie = np.maximum(np.searchsorted(-n, -value, "left"), step)
    for i in np.flatnonzero((tie <= until) & (tie < more) & (tie < best)):
        text = " ".join(pairs.texts(int(pair[i])))
        for j in range(tie[i], min(more[i], until[i] + 1, best)):
            if text < " ".join(pairs.texts(batch[j][0])):
                best = j
                break
    return best


def learn_merges(words: DataFrame, n_merges: int, checkpoint_every: int = 10) -> list[tuple[int, str, str, int]]:
    """Greedy merges ``(rank, left, right, count)``; stops early when no pair occurs twice.

    A round tries many of the most frequent pairs at once.  The tasks merge them in their words and return, merge by
    merge, how the counts of the neighbouring pairs change; the driver keeps the merges up to the first one that
    another pair has overtaken by then, so the result is that of one merge at a time.  The lineage is cut every
    ``checkpoint_every`` rounds."""
    import pickle
    spark = words.sparkSession
    ensure_checkpoint_dir(spark)
    cur = written(words.select("n", "sym"), "bpe")
    pairs = _Pairs([(r["pair"], r["n"]) for r in pair_counts(cur).collect()])
    slots = spark.sparkContext.defaultParallelism
    tasks = max(slots, -(-cur.count() // PART_WORDS))
    packed = cur.repartition(tasks).mapInArrow(_packed, "data binary")

    def joined(part):
        parts = [pickle.loads(x) for x in part]
        yield tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def dealt(batch):
        def one(part):
            for step, pair, change in (_changes(x, batch) for x in part):
                to = pair % (slots if tasks > FEW_TASKS else 1)
                for i in np.unique(to).tolist():
                    yield i, (step[to == i], pair[to == i], change[to == i])
        return one

    def added(part):
        parts = [x for _, x in part]
        if parts:
            yield _summed(*[np.concatenate(x) for x in zip(*parts)])

    merges: list[tuple[int, str, str, int]] = []
    state, last, most, rounds, stored = packed.rdd.map(lambda r: bytes(r["data"])).mapPartitions(joined), [], 8, 0, None
    state.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while len(merges) < n_merges:
            batch, over = _batch(pairs, min(most, n_merges - len(merges)))
            if not batch:
                break
            old = state
            if last:
                state = old.mapPartitions(lambda part, last=last: (_apply(x, last) for x in part), preservesPartitioning=True)
                state.persist(StorageLevel.MEMORY_AND_DISK)
                if rounds % checkpoint_every == 0:
                    state.checkpoint()
            made = [(p >> SHIFT, p & ((1 << SHIFT) - 1), pairs.merged(p)) for p, _ in batch]
            got = state.mapPartitions(dealt(made))
            if tasks > FEW_TASKS:
                got = got.partitionBy(slots)
            got = got.mapPartitions(added).collect()
            if old is not state:
                old.unpersist()
            if state.isCheckpointed():
                stored, done = state.getCheckpointFile(), stored
                if done and done != stored:
                    remove(spark, done)
            step, pair, change = _summed(*[np.concatenate(x) for x in zip(*got)])
            taken = _accepted(pairs, batch, over, step, pair, change)
            merges += [(len(merges) + i, *pairs.texts(p), n) for i, (p, n) in enumerate(batch[:taken])]
            pairs.add(pair[step < taken], change[step < taken])
            last, most, rounds = made[:taken], min(max(8, 2 * taken), 512), rounds + 1
    finally:
        state.unpersist()
    return merges


def merges_frame(spark, merges) -> DataFrame:
    return spark.createDataFrame(merges, "rank int, left string, right string, n long").withColumn(
        "piece", F.concat("left", "right"))


def _segmenter(merges):
    ranks = {(a, b): r for r, a, b, _ in merges}

    def seg(word: str) -> str:
        s = list(WORD_START + word)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = ranks.get((s[i], s[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            a, b = s[at], s[at + 1]
            out, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return " ".join(s)
    return seg


def segment_words(words: DataFrame, merges) -> DataFrame:
    """``(word, pieces)`` for distinct words, pieces blank-joined."""
    seg = _segmenter(merges)

    @F.pandas_udf("string")
    def _seg(ws: pd.Series) -> pd.Series:
        return ws.map(seg)

    return words.select("word", _seg(F.col("word")).alias("pieces"))


class _Pieces:
    """Segments distinct words, all at once: in every word the pair of the lowest rank is merged until none is left."""

    MEMO = 1 << 18  # words whose pieces a task remembers

    def __init__(self, merges):
        self.texts: list[str] = []
        number: dict[str, int] = {}

        def symbol(text: str) -> int:
            if len(text) == 1:
                return ord(text)
            if text not in number:
                number[text] = NEW + len(self.texts)
                self.texts.append(text)
            return number[text]

        rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, a, b, _ in merges:
            rules[symbol(a), symbol(b)] = rank, symbol(a + b)
        keys = np.array([_key(a, b) for a, b in rules], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank, self.made = (np.array([x[i] for x in rules.values()], np.int64)[order] for i in (0, 1))
        self.left, self.right = np.zeros(1 << SHIFT, bool), np.zeros(1 << SHIFT, bool)
        self.left[[a for a, _ in rules]], self.right[[b for _, b in rules]] = True, True
        self.known: dict[str, bytes] = {}

    def symbols(self, words: list[str]) -> list[bytes]:
        """Each word's symbols, as the bytes of 32-bit numbers."""
        if len(self.known) + len(words) > self.MEMO:
            self.known = {}
        new = [w for w in words if w not in self.known]
        found = dict(zip(new, self._segmented(new)))
        out = [found[w] if w in found else self.known[w] for w in words]
        self.known.update(found)
        return out

    def _segmented(self, words: list[str]) -> list[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        sym = np.frombuffer("".join([WORD_START + w + " " for w in words]).encode("utf-32-le"), "<u4").astype(np.int32)
        sym[np.cumsum(size) - 1] = -1
        name, done, none = np.arange(len(words)), [b""] * len(words), 1 << 62
        while len(name):
            rank = np.full(len(sym), none, np.int64)
            made = np.zeros(len(sym), np.int32)
            at = np.flatnonzero(self.left[sym[:-1]] & self.right[sym[1:]])
            if len(self.keys) and len(at):
                pair = _key(sym[at], sym[at + 1])
                place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
                is_rule = self.keys[place] == pair
                at, place = at[is_rule], place[is_rule]
                rank[at], made[at] = self.rank[place], self.made[place]
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            over = least == none
            if over.any():
                for k, i, n in zip(name[over].tolist(), starts[over].tolist(), size[over].tolist()):
                    done[k] = sym[i:i + n - 1].tobytes()
                stay = ~over
                rows = np.repeat(stay, size)
                sym, rank, made, name, size, least = sym[rows], rank[rows], made[rows], name[stay], size[stay], least[stay]
                if not len(name):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)      # a run of one symbol is paired from its start
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            sym[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            size = size - np.add.reduceat(gone, np.cumsum(size) - size, dtype=np.int64)
            sym = sym[~gone]
        return done

    def text(self, symbol: int) -> str:
        return chr(symbol) if symbol < NEW else self.texts[symbol - NEW]


def encode_pieces(lines: DataFrame, key_cols, text_col: str, merges) -> DataFrame:
    """``(*keys, pieces array<string>)``: every line's words replaced by their pieces.
    A task segments the distinct words of some hundred thousand words of lines at once, so no word is shuffled;
    a line without words keeps its row with an empty array.  Rows of one key are one line: their words are
    put together by place."""
    words = lines.select(*key_cols, split_ws(F.lower(F.col(text_col))).alias("_w"))
    names = [f"_k{i}" for i in range(len(key_cols))]
    repeated = lines.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        *[F.col(c).alias(k) for c, k in zip(key_cols, names)])
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return _encode_lines(words, key_cols, merges)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(key_cols, names)])
    return _encode_lines(words.join(repeated, same, "left_anti"), key_cols, merges).unionByName(
        _encode_words(words.join(repeated, same, "left_semi"), key_cols, merges))


def _encode_words(words: DataFrame, key_cols, merges) -> DataFrame:
    """``encode_pieces`` for rows that share their keys: a row a word, put together by key, place and pieces."""
    ex = words.select(*key_cols, F.posexplode_outer("_w").alias("pos", "word"))
    distinct = ex.select("word").where(F.col("word").isNotNull()).distinct()
    seg = segment_words(distinct, merges)
    j = ex.join(seg, "word", "left")
    g = j.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("pos", "pieces"))).alias("_s"))
    return g.select(*key_cols, F.flatten(F.transform(
        F.filter("_s", lambda s: s["pos"].isNotNull()), lambda s: F.split(s["pieces"], " "))).alias("pieces"))


def _encode_lines(words: DataFrame, key_cols, merges) -> DataFrame:
    """``encode_pieces`` for rows whose keys differ."""
    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401 - `import pyarrow` alone does not load it in a new Python worker
        pieces = _Pieces(merges)
        for b in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), 0), np.int64)
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(size[at:]), CHUNK_WORDS, "right")))
                coded = b.column(1).slice(at, n).flatten().dictionary_encode()
                parts = pieces.symbols(coded.dictionary.to_pylist())
                count = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
                symbols, place = np.unique(np.frombuffer(b"".join(parts), np.int32), return_inverse=True)
                own = np.asarray(coded.indices, np.int64)
                times, start = count[own], (np.cumsum(count) - count)[own]
                ends = np.concatenate(([0], np.cumsum(times)))
                flat = place[np.repeat(start - ends[:-1], times) + np.arange(ends[-1])]
                texts = pa.array([pieces.text(s) for s in symbols.tolist()], pa.string()).take(pa.array(flat))
                line = ends[np.concatenate(([0], np.cumsum(size[at:at + n])))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(line, pa.int32()), texts)], names=["key", "pieces"])
                at += n

    src = words.select(F.struct(*key_cols).alias("key"), "_w")
    key = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(encoded, f"key {key}, pieces array<string>").select(*[F.col(f"key.{c}").alias(c) for c in key_cols], "pieces")


def detokenise(pieces: Column) -> Column:
    """Pieces back to text: join, word-start marks become blanks, trim."""
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), WORD_START, " "))
