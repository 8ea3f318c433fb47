"""N-gram Jaccard join by PartEnum signatures (operator 3).

A text's set holds its distinct word shingles.  Sizes are cut into bands; two
sets of one band whose Jaccard similarity reaches the threshold differ in at
most k shingles, k following from the band.  The shingle domain is split into
n1 = k // 2 + 1 partitions, so one partition holds at most one difference; that
one is split again into three parts and the signatures are the hashes of any
two of them.  At least one choice of two has no difference, so similar sets
share a signature.  A set also signs for the next band if a partner may lie there.

Plan: signatures per text (one pass over the text, written once) -> sets that
share a signature form clusters -> every cluster is checked exactly, in blocks
of bounded size, against blocks whose sizes can still match -> components of
the links.  No list of pairs is made: a block check returns at most one link
per member, and its count.  A group of copies counts as one set; within a slice
of the input only the first set with a signature is sent to the shuffle, the
others are tied to it there, so a hot group arrives at one row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiforge.llm.components import connected_components
from sentiforge.llm.shared import written
from sentiforge.llm.words import Words, find_words, mix, slices, windows

_U = np.uint64
SHINGLE = 3
PERCENT = 90
GROWTH = 1.4     # width of a size band
PARTS = 3        # second-level partitions; one is left out at a time
BLOCK = 512_000  # weight of a block: each set counts its size, 1,000 at least
BROADCAST_ROWS = 1_000_000  # cluster members up to this number are sent to every executor, else both sides are shuffled


def shingle_sets(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-word shingles of each text, texts ascending.

    A text with fewer words has one shingle, its whole sequence; without words none."""
    h = windows(w.hash, n)
    ok = w.doc[:len(h)] == w.doc[n - 1:n - 1 + len(h)] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[:len(h)][ok], h[ok]
    count = np.diff(w.first)
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            x = np.zeros(len(short), _U)
            with np.errstate(over="ignore"):
                for k in range(m):
                    x = mix(x * _U(31) + w.hash[w.first[short] + k] + _U(m))
            doc, h = np.concatenate((doc, short)), np.concatenate((h, x))
    with np.errstate(over="ignore"):
        key = mix(h + doc.astype(_U) * _U(0xD1B54A32D192ED03))
    first = np.unique(key, return_index=True)[1]
    first = first[np.argsort(doc[first], kind="stable")]
    return doc[first], h[first]


def band_edges(limit: int, percent: int = PERCENT, growth: float = GROWTH) -> np.ndarray:
    """Lower ends of the size bands: band 0 holds the sizes that only an equal set can match."""
    low = -(-percent // (100 - percent)) + 1
    edges = [1, low]
    while edges[-1] <= limit:
        edges.append(int(edges[-1] * growth) + 1)
    return np.array(edges, dtype=np.int64)


def signatures(doc: np.ndarray, h: np.ndarray, n_texts: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) by PartEnum over the distinct shingles."""
    size = np.bincount(doc, minlength=n_texts)
    edges = band_edges(int(size.max(initial=1)) * 2, percent)
    own = np.searchsorted(edges, size, side="right") - 1
    out_doc, out_sig = [], []
    first = np.concatenate(([0], np.cumsum(size)))
    with np.errstate(over="ignore"):
        part1, part2, value = mix(h ^ _U(0xA0761D6478BD642F)), mix(h ^ _U(0xE7037ED1A0B428DB)) % _U(PARTS), mix(h ^ _U(0x8EBC6AF09C88C6E3))
        for shift in (0, 1):
            band = own + shift
            use = (size > 0) & (band > 0)
            if shift:
                use &= size * 100 // percent >= edges[band]
            texts = np.flatnonzero(use)
            if not len(texts):
                continue
            high = edges[band[texts] + 1] - 1
            k = 2 * high * (100 - percent) // (100 + percent)
            n1 = k // 2 + 1
            n_slots = n1 * PARTS
            base = np.cumsum(n_slots) - n_slots
            which = np.full(n_texts, -1)
            which[texts] = np.arange(len(texts))
            t = which[doc]
            e = t >= 0
            t = t[e]
            p1 = (part1[e] % n1[t].astype(_U)).astype(np.int64)
            slot = base[t] + p1 * PARTS + part2[e].astype(np.int64)
            sums = np.zeros(int(n_slots.sum()), _U)
            np.add.at(sums, slot, value[e])
            sums = sums.reshape(-1, PARTS)
            total = sums.sum(axis=1, dtype=_U)
            row = np.repeat(np.arange(len(texts)), n1)
            p = np.arange(len(row)) - np.repeat(np.cumsum(n1) - n1, n1)
            salt = mix((band[texts][row].astype(_U) << _U(40)) + p.astype(_U) + _U(1))
            for j in range(PARTS):
                out_sig.append(mix(total - sums[:, j] + salt * _U(2 * j + 3)))
                out_doc.append(texts[row])
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int64()))


def profiles(doc: np.ndarray, h: np.ndarray, n_texts: int) -> list[bytes]:
    """Per text: how many of its shingles fall into each of ``2**j`` buckets, about six to a bucket.

    The sum of the differences of two profiles is a lower bound of the number of
    shingles that two sets do not share (also when a count stops at 255, or the
    longer profile is folded to the length of the shorter)."""
    size = np.bincount(doc, minlength=n_texts)
    buckets = 1 << np.maximum(np.ceil(np.log2(np.maximum(size, 6) / 6)).astype(np.int64), 0)
    base = np.cumsum(buckets) - buckets
    slot = base[doc] + (mix(h ^ _U(0x589965CC75374CC3)) % buckets[doc].astype(_U)).astype(np.int64)
    count = np.minimum(np.bincount(slot, minlength=int(buckets.sum())), 255).astype(np.uint8)
    return [count[a:a + n].tobytes() for a, n in zip(base.tolist(), buckets.tolist())]


def signed_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                percent: int = PERCENT, tie: bool = True) -> DataFrame:
    """``(key, n, h1, h2, sigs, near, profile)`` per row: size and 128-bit
    hash of its set, its signatures that are new in its slice, and the slice's
    texts that had the others first.  Without ``tie`` only a copy of an earlier
    set of the slice with a key has no signatures, and the profile is filled in.  A row
    without words has n = 0 and no signature."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text"):
            w = find_words(b.column(1), lower=True)
            doc, h = shingle_sets(w, shingle)
            n = np.bincount(doc, minlength=w.n_texts)
            hashes = []
            with np.errstate(over="ignore"):
                for salt in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
                    sums = np.zeros(w.n_texts, _U)
                    np.add.at(sums, doc, mix(h ^ _U(salt)))
                    hashes.append(mix(sums + n.astype(_U)).view(np.int64))
            keys = np.asarray(b.column(0).fill_null(0))
            sig_doc, sig = signatures(doc, h, w.n_texts, percent)
            has_key = np.asarray(b.column(0).is_valid())
            known = has_key[sig_doc]
            sig_doc, sig = sig_doc[known], sig[known]
            order = np.lexsort((sig_doc, sig))
            sig_doc, sig = sig_doc[order], sig[order]
            if tie:
                new = np.append(True, sig[1:] != sig[:-1])[:len(sig)]
            else:
                live = np.flatnonzero(has_key)  # a row without a key signs for no copy
                copy_of = np.unique(np.column_stack(hashes)[live], axis=0, return_index=True, return_inverse=True)
                first = np.full(w.n_texts, -1)
                first[live] = live[copy_of[1][copy_of[2].reshape(-1)]]
                new = first[sig_doc] == sig_doc
                sig_doc, sig, new = sig_doc[new], sig[new], new[new]
            leader = sig_doc[new][np.cumsum(new) - 1]
            pair = np.unique(sig_doc[~new] * w.n_texts + leader[~new])
            near_doc, near = pair // max(w.n_texts, 1), keys[pair % max(w.n_texts, 1)]
            back = np.argsort(sig_doc[new], kind="stable")
            bounds = np.arange(w.n_texts + 1)
            yield pa.record_batch(
                [b.column(0), pa.array(n), *map(pa.array, hashes),
                 _lists(sig[new][back].view(np.int64), np.searchsorted(sig_doc[new][back], bounds)),
                 _lists(near.astype(np.int64), np.searchsorted(near_doc, bounds)),
                 pa.nulls(w.n_texts, pa.binary()) if tie else pa.array(profiles(doc, h, w.n_texts), pa.binary())],
                names=["key", "n", "h1", "h2", "sigs", "near", "profile"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    return src.mapInArrow(run, "key long, n long, h1 long, h2 long, sigs array<long>, near array<long>, profile binary")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Keys that share a signature, tied to the first key with it."""
    sigs = sets.select("key", F.explode("sigs").alias("sig"))
    first = F.first("key").over(Window.partitionBy("sig").orderBy("key"))
    shared = sigs.select(F.col("key").alias("a"), first.alias("b"))
    return shared.union(sets.select("key", F.explode("near"))).where("a <> b").distinct()


def _spanning(rows: list, percent: int) -> list[tuple[int, int]]:
    """Edges that tie together the sets of one signature whose sizes and profiles allow a link."""
    size = np.array([r[1] for r in rows])
    shortest = min(len(r[2]) for r in rows)
    prof = np.array([np.frombuffer(r[2], np.uint8).reshape(-1, shortest).sum(axis=0) for r in rows], dtype=np.int32)
    left, out = np.arange(len(rows)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            p = front.pop()
            ok = np.abs(prof[left] - prof[p]).sum(axis=1) * (100 + percent) <= (100 - percent) * (size[left] + size[p])
            for q in left[ok].tolist():
                out.append((rows[q][0], rows[p][0]))
                front.append(q)
            left = left[~ok]
    return out


def filtered_edges(signed: DataFrame, sets: DataFrame, percent: int, small: int = 64, held: int = 20_000) -> DataFrame:
    """As ``candidate_edges``, but sets of one signature are tied only through
    pairs that their sizes and profiles allow to be linked, which keeps clusters
    small where documents share passages.  No linked pair is parted: it shares a
    signature and passes the test.  Of a group beyond ``held`` sets the rest is
    tied to its first set unseen, so memory is bounded and nothing is lost."""
    sigs = signed.where("n > 0").select("key", F.explode("sigs").alias("sig"))
    w = Window.partitionBy("sig")
    shared = sigs.withColumns({"_lo": F.min("key").over(w), "_hi": F.max("key").over(w),
                               "_c": F.count(F.lit(1)).over(w)}).where("_lo < _hi")
    shared = written(shared.select("sig", "key", "_c"), "shared")
    # sets alike share many signatures: each list of members is looked at once
    lists = shared.where(F.col("_c") <= small).groupBy("sig").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    few = lists.select("keys").distinct().select(F.xxhash64("keys").alias("sig"), F.explode("keys").alias("key"))
    many = shared.where(F.col("_c") > small).select("sig", "key")
    info = sets.where("n > 0 AND key IS NOT NULL").select("key", "n", "profile")
    rows = few.union(many).join(info, "key").select("sig", "key", "n", "profile").repartition("sig").sortWithinPartitions("sig", "key")

    def run(batches: Iterator[pa.RecordBatch]):
        at, group, known = None, [], set()

        def edges():
            found = [e for e in _spanning(group, percent) if e[0] != e[1] and e not in known] if len(group) > 1 else []
            known.update(found)
            if len(known) > 500_000:
                known.clear()  # repeated edges only cost time
            return found

        for b in batches:
            out = []
            for sig, *row in zip(*(c.to_pylist() for c in b.columns)):
                if sig != at:
                    out += edges()
                    at, group = sig, []
                if len(group) < held:
                    group.append(row)
                else:
                    out.append((row[0], group[0][0]))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        last = edges()
        if last:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*last)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def check_blocks(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(a, b, links)`` from ``(cluster, key, n, elems)``: the exact links.

    Members of a cluster, in order of size, fall into blocks; pairs of blocks
    whose sizes can match are checked together.  Per pair of blocks and member
    there is one row: another member it is linked to through this check (or
    itself) and how many sets of the other block it is linked to."""
    weight = F.sum(F.greatest("n", F.lit(1000))).over(
        Window.partitionBy("cluster").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = written(members.select("cluster", "key", "n").distinct()
                    .withColumn("block", F.floor(weight / F.lit(BLOCK))), "blocks")
    ranges = place.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = ranges.alias("x"), ranges.alias("y")
    pairs = (x.join(y, F.col("x.cluster") == F.col("y.cluster"))
             .where((F.col("x.block") <= F.col("y.block")) & (F.col("y.lo") * percent <= F.col("x.hi") * 100))
             .select("x.cluster", F.col("x.block").alias("i"), F.col("y.block").alias("j")))
    sides = (pairs.select("cluster", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side"))
             .union(pairs.where("i < j").select("cluster", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side"))))
    rows = (members.join(place.select("cluster", "key", "n", "block"), ["cluster", "key", "n"])
            .join(sides, ["cluster", "block"])
            .select("cluster", "i", "j", "side", "key", "elems")
            .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key", "elems"))

    def run(batches: Iterator[pa.RecordBatch]):
        held, at = [], None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "key")]
            for c, i, j, side, key, e in zip(*cols, b.column("elems")):
                if (c, i, j) != at and held:
                    yield _links(held, at[1] == at[2], percent)
                    held = []
                at = (c, i, j)
                if not held or held[-1][0] != key or held[-1][3] != e:  # a repeated row counts once
                    held.append((key, side, np.frombuffer(e.as_buffer(), _U), e))
        if held:
            yield _links(held, at[1] == at[2], percent)

    return rows.mapInArrow(run, "a long, b long, links long")


def _links(members: list, same: bool, percent: int) -> pa.RecordBatch:
    keys = np.array([m[0] for m in members])
    side = np.array([m[1] for m in members])
    size = np.array([len(m[2]) for m in members])
    m = len(members)
    owner = np.repeat(np.arange(m), size)
    _, elem, df = np.unique(np.concatenate([x[2] for x in members]), return_inverse=True, return_counts=True)
    keep = df[elem] > 1
    elem, owner = elem[keep], owner[keep]
    number = np.cumsum(df > 1) - 1
    elem = number[elem]
    common = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(elem, kind="stable")
    elem, owner = elem[order], owner[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, z = np.searchsorted(elem, [lo, lo + 4096])
        has = np.zeros((m, 4096), dtype=np.float32)
        has[owner[a:z], elem[a:z] - lo] = 1
        common += has @ has.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    link = 100 * inter >= percent * union
    link &= keys[:, None] != keys[None, :]
    if not same:
        link &= side[:, None] != side[None, :]
    parent = np.full(m, -1)
    for root in range(m):  # spanning trees by breadth, a whole frontier at a time
        if parent[root] >= 0:
            continue
        parent[root] = root
        front = np.array([root])
        while len(front):
            hit = link[front]
            reach = np.flatnonzero(hit.any(axis=0) & (parent < 0))
            parent[reach] = front[hit[:, reach].argmax(axis=0)]
            front = reach
    return pa.record_batch([pa.array(keys), pa.array(keys[parent]), pa.array(link.sum(axis=1))], names=["a", "b", "links"])


def shingle_elements(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(key, n, elems)`` with the 64-bit shingles of each text with words of ``(key, _text)``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text"):
            w = find_words(b.column(1), lower=True)
            doc, h = shingle_sets(w, shingle)
            n = np.bincount(doc, minlength=w.n_texts)
            off = np.concatenate(([0], np.cumsum(n)))
            rows = {(k, h[a:z].tobytes()): a for k, a, z in zip(b.column(0).to_pylist(), off[:-1], off[1:]) if z > a}
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(e) // 8 for _, e in rows]),
                                   pa.array([e for _, e in rows], pa.binary())], names=["key", "n", "elems"])

    return docs.mapInArrow(run, "key long, n long, elems binary")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  percent: int = PERCENT, tie: bool = True) -> DataFrame:
    """``(key, n_shingles, component_id, n_links)`` for every row of ``docs``.

    ``tie`` chooses how sets of one signature are put into clusters, not what is
    found: all together (cheapest at high thresholds), or only through pairs that
    a lower bound of their difference allows (``filtered_edges``).

    Two texts link when ``100 * |intersection| >= percent * |union|``;
    ``component_id`` is the smallest key reachable by links, itself included;
    ``n_links`` counts the other different sets a text is linked to.  Null and
    empty texts are linked with nothing.  Rows of one key count as one document
    (linked by their key); a null key is linked with nothing and has a null component."""
    signed = signed_sets(docs, key, text, shingle, percent, tie)
    # many signatures are cheaper to make again than to keep
    sets = written(signed if tie else signed.drop("sigs", "near"), "sets")
    rows = sets.select("key", "n", "h1", "h2")
    known = rows.where("n > 0 AND key IS NOT NULL")
    classes = written(known.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.first("n").alias("n")), "classes")
    copies = known.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("key", "rep")
    of = written(copies.groupBy("key").agg(F.min("rep").alias("rep")), "representatives")
    # rows of one key but different sets: their classes are one document
    twins = copies.join(of.withColumnRenamed("rep", "_r"), "key").where("rep <> _r").select(
        F.col("rep").alias("a"), F.col("_r").alias("b")).distinct()

    ends = candidate_edges(sets) if tie else filtered_edges(signed, sets, percent)
    for c in ("a", "b"):
        ends = ends.join(of.select(F.col("key").alias(c), F.col("rep").alias(f"_{c}")), c)
    clusters = connected_components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())

    members = clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    picked = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
              .join(members.select("key"), "key", "left_semi").select("key", "_text"))
    elems = written(shingle_elements(picked, shingle).join(members, "key"), "members")
    links = written(check_blocks(elems, percent), "links")
    found = connected_components(links.where("a <> b").select("a", "b").union(twins))

    # smallest key of each class is its representative, so the smallest node is the smallest key
    count = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    answer = (of.join(found.select(F.col("node").alias("rep"), "label"), "rep", "left")
              .join(count, "rep", "left")
              .select(F.col("key").alias("_k"), F.coalesce("label", "rep").alias("component_id"), "n_links"))
    return rows.join(answer, F.col("key") == F.col("_k"), "left").select(
        "key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles reach a Jaccard similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_texts(docs).withColumnRenamed("key", "doc_id")


def _plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns ``_d0, _d1, ...``, which no column made here is called, and their own names."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Rows of one id are one document and leave one row (the smallest hash of its
    text); documents without words or without an id stay.  Columns keep their names and values."""
    rows, names = _plain_names(docs)
    key, text = names["doc_id"], names["text"]
    found = written(similar_texts(rows, key, text, shingle=5, percent=80, tie=False), "groups")
    gone = found.where("key <> component_id").select(F.col("key").alias("_gone")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = rows.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    twice = found.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select(F.col("key").alias("_twice"))
    if twice.limit(1).count():
        once = left.join(twice, F.col(key) == F.col("_twice"), "left_anti")
        again = left.join(twice, F.col(key) == F.col("_twice"), "left_semi")
        pick = again.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text))))
        left = once.unionByName(pick.where("_row = 1").drop("_row"))
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])


def stage_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near duplicates (five words, 0.8) the row with the smallest id stays.

    Each row is judged by its own text: unlike texts of one id all stay, and no
    group goes through an id.  Of rows alike in id and text one stays; rows
    without an id stay, and so do texts without words.  Columns keep their names and values."""
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not several.limit(1).count():
        return stage(spark, docs, sf_dir)
    plain, names = _plain_names(docs)
    key, text = names["doc_id"], names["text"]
    # written once, so that the numbers hold for every later reader
    rows = written(plain.withColumn("_node", F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())), "rows")
    found = written(similar_texts(rows, "_node", text, shingle=5, percent=80, tie=False), "groups").where("key IS NOT NULL")
    place = rows.where("_node IS NOT NULL").select("_node", F.col(key).alias("_id"), F.xxhash64(text).alias("_tag"))
    placed = found.join(place, F.col("key") == F.col("_node"))
    blank = F.col("n_shingles") == 0
    stays = (placed.groupBy(F.when(~blank, F.col("component_id")), F.when(blank, F.col("_id")), F.when(blank, F.col("_tag")))
             .agg(F.min(F.struct("_id", "_tag", "_node")).alias("_s")).select(F.col("_s._node").alias("key")))
    gone = written(found.select("key").join(stays, "key", "left_anti").select(F.col("key").alias("_gone")), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = rows.join(gone, F.col("_node") == F.col("_gone"), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
