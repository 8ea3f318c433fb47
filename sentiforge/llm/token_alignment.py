"""Tokens of two tokenizers aligned by interval coalescing, and corpus-wide pair counts (operator 11).

A is a byte-level BPE (tokenizers file), B a sentencepiece BPE with byte
fallback.  Both cut the same bytes (a space and the text) into intervals.  The
intervals of both are sorted by start together, a running maximum of the ends
is taken, and a group ends where the next start reaches it: the groups are the
finest cut that both tokenizers share.  Inside a group every A token is linked
with every B token.

Texts are cut into units (a run of white space and what follows) at places that
no token of either crosses, so distinct units are encoded, aligned and linked
once per worker, and a document is the sum of its units.

Corpus counts: a task writes its documents in chunks of a few MB, each with the
list of distinct id pairs it holds, the number of its documents that hold each,
and every document's pairs as places in that list.  Only (chunk, pair) rows are
shuffled: summed by pair, joined back, and collected per chunk, whose documents
are then finished in one pass.  A frequent pair is one row per chunk.

Odd input: null and empty texts, and texts whose tokens do not give back the
bytes (B writes U+2581 for a space, so a text with that character does not),
have no tokens: zeros, no groups.  Every row counts as a document, repeated ids
and null ids too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm.encode import _load, _odd_texts
from sentiforge.llm.shared import shared_path
from sentiforge.llm.words import IS_SPACE, slices, span_hashes, text_bytes

MEMO_UNITS = 350_000
CHUNK_BYTES = 3 << 20
_JOIN = 512
_BLANK = "▁"


def _csr(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``start[i] .. start[i] + size[i]`` end to end."""
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)


# ---- tokens --------------------------------------------------------------------

def _fields(message: bytes):
    """(field number, value) of a protobuf message."""
    def varint(i):
        out = shift = 0
        while True:
            out |= (message[i] & 0x7F) << shift
            shift += 7
            i += 1
            if message[i - 1] < 0x80:
                return out, i

    i = 0
    while i < len(message):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, i = varint(i)
            value, i = message[i:i + size], i + size
        yield tag >> 3, value


def load_pieces(path: str):
    """The sentencepiece model without its leading blank (units bring their own).

    Raises if it does not keep texts as they are apart from that blank."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    spec = dict(_fields(dict(x for x in _fields(raw) if x[0] == 3).get(3, b"")))
    if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or not spec.get(3, 1):
        raise ValueError("the piece model must keep white space, add one blank and change no character")
    # a repeated sub-message is merged into the first: field 3 (add_dummy_prefix) of field 3 becomes false
    return sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a\x02\x18\x00")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of units, and the bytes of each id (``raw[at[i]:at[i + 1]]``)."""

    def __init__(self, library, raw: list[bytes]):
        self.library = library
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, number of ids of each unit)."""
        order, n, ids = self.library(units)
        size, begin = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        size[order], begin[order] = n, np.cumsum(n) - n
        return ids[_csr(begin, size)].astype(np.int64), size

    def unlike(self, ids, n, buf, s, e) -> np.ndarray:
        """Units whose ids do not give back their bytes ``buf[s:e]``."""
        unit = np.repeat(np.arange(len(n)), n)
        total = np.bincount(unit, weights=self.size[ids], minlength=len(n)).astype(np.int64)
        bad = total != e - s
        keep = ~bad[unit]
        got = self.raw[_csr(self.at[ids[keep]], self.size[ids[keep]])]
        want = buf[_csr(s[~bad], (e - s)[~bad])]
        ends = np.cumsum(total[~bad])
        bad[np.flatnonzero(~bad)[np.searchsorted(ends, np.flatnonzero(got != want), side="right")]] = True
        return bad


def _units_of(encode, first: np.ndarray):
    """Ids of units through ``encode`` (list of strings -> lists of ids).

    Units of a blank and one word are joined, as their ids begin anew where an
    id has a leading blank (``first``); the others are encoded one by one."""
    def library(units: list[str]):
        plain = [u[0] == " " and not u[1:2].isspace() and len(u.split()) == 1 and not u[-1].isspace() for u in units]
        joined = [i for i, p in enumerate(plain) if p]
        rest = [i for i, p in enumerate(plain) if not p]
        order, n, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sets = [joined[k:k + _JOIN] for k in range(0, len(joined), _JOIN)]
        for g, got in zip(sets, encode(["".join([units[i] for i in g]) for g in sets])):
            got = np.asarray(got, np.int64)
            begin = np.flatnonzero(first[got])
            if len(begin) != len(g):      # a unit holds the letter that stands for the blank
                rest += g
                continue
            order += g
            n.append(np.diff(begin, append=len(got)))
            ids.append(got)
        for k in range(0, len(rest), 4096):
            part = rest[k:k + 4096]
            got = encode([units[i] for i in part])
            order += part
            n.append(np.array([len(x) for x in got], np.int64))
            ids.append(np.array([y for x in got for y in x], np.int64))
        return order, np.concatenate(n), np.concatenate(ids)

    return library


def _side_a(path: str) -> Side:
    tok, letters = _load(path), byte_letters()
    vocab = tok.get_vocab()
    raw, first = [b""] * (max(vocab.values()) + 1), np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        if all(c in letters for c in piece):  # others are special tokens, which texts never give
            raw[i] = bytes(letters[c] for c in piece)
            first[i] = raw[i][:1] == b" "

    def encode(texts: list[str]):
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    return Side(_units_of(encode, first), raw)


def _side_b(path: str) -> tuple[Side, bytes]:
    """The side and the white-space bytes that no piece holds behind another character."""
    sp = load_pieces(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i)
           else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
    first = np.array([p.startswith(_BLANK) for p in pieces])
    bound = {y for p in raw for x, y in zip(p, p[1:]) if IS_SPACE[y] and not IS_SPACE[x]}
    side = Side(_units_of(lambda texts: sp.encode(texts, num_threads=1), first), raw)
    return side, bytes(w for w in np.flatnonzero(IS_SPACE).tolist() if w not in bound)


# ---- groups --------------------------------------------------------------------

def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval: sorted by start, a group breaks where a start
    reaches the running maximum of the ends."""
    order = np.lexsort((end, start))
    s, top = start[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate(([False], s[1:] >= top[:-1]))[:len(s)]
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(fresh)
    return group


class Aligner:
    def __init__(self, a_path: str, b_path: str, memo_units: int = MEMO_UNITS):
        self.a = _side_a(a_path)
        self.b, safe = _side_b(b_path)
        self.safe = np.zeros(256, bool)
        self.safe[list(safe)] = True
        self.width = len(self.b.size)      # a pair's key is A id * width + B id
        self.memo_units = memo_units
        number = [str(i).encode() for i in range(max(len(self.a.size), self.width))]
        self.text = [[x + sep for x in number] for sep in (b",", b"|", b";")]
        self._clear()

    def _clear(self):
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n = np.zeros((0, 4), np.int64)              # A tokens, B tokens, groups, links of a unit
        self.bad = np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.pair_at = np.zeros(1, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, texts: pa.Array):
        """(bytes, text of each unit, start, end): cut before a run of white space that no piece starts before."""
        buf, off = text_bytes(texts)
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[off] = True
        cut = self.safe[buf]
        cut[1:] &= ~IS_SPACE[buf[:-1]]
        odd = _odd_texts(buf, off)
        if odd.any():
            cut &= ~np.repeat(odd, np.diff(off))
        cut |= edge[:len(buf)]
        s = np.flatnonzero(cut)
        return buf, np.searchsorted(off, s, side="right") - 1, s, np.append(s[1:], len(buf))

    def _learn(self, buf, hashes, s, e):
        raw = buf.tobytes()
        units = [raw[x:y].decode() for x, y in zip(s.tolist(), e.tolist())]
        count = len(units)
        (ia, na), (ib, nb) = self.a.ids(units), self.b.ids(units)
        bad = self.a.unlike(ia, na, buf, s, e) | self.b.unlike(ib, nb, buf, s, e)
        ia, ib = ia[~np.repeat(bad, na)], ib[~np.repeat(bad, nb)]
        na, nb = np.where(bad, 0, na), np.where(bad, 0, nb)
        ea, eb = np.cumsum(self.a.size[ia]), np.cumsum(self.b.size[ib])
        group = coalesce(np.concatenate((ea - self.a.size[ia], eb - self.b.size[ib])), np.concatenate((ea, eb)))
        ga, gb = group[:len(ia)], group[len(ia):]
        ua = np.repeat(np.arange(count), na)
        n_groups = int(group.max()) + 1 if len(group) else 0
        in_a, in_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        unit = np.zeros(n_groups, np.int64)
        unit[ga] = ua
        # links: distinct A ids times distinct B ids of a group, with the number of times
        da, ta = np.unique(ga * len(self.a.size) + ia, return_counts=True)
        db, tb = np.unique(gb * self.width + ib, return_counts=True)
        of, a_id = da // len(self.a.size), da % len(self.a.size)
        size = np.bincount(db // self.width, minlength=n_groups)
        at = _csr((np.cumsum(size) - size)[of], size[of])
        key = np.repeat(a_id, size[of]) * self.width + db[at] % self.width
        times = np.repeat(ta, size[of]) * tb[at]
        order = np.lexsort((key, np.repeat(unit[of], size[of])))
        key, times, who = key[order], times[order], np.repeat(unit[of], size[of])[order]
        fresh = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (key[1:] != key[:-1])))[:len(key)])
        times = np.add.reduceat(times, fresh) if len(fresh) else times
        per = np.bincount(who[fresh], minlength=count)

        n = np.stack((na, nb, np.bincount(unit, minlength=count), np.bincount(unit, weights=in_a * in_b, minlength=count)), axis=1)
        base = len(self.groups)
        self.groups += self._written(count, ia, ib, ga, gb, na, in_a, in_b, unit)
        self.n, self.bad = np.concatenate((self.n, n.astype(np.int64))), np.concatenate((self.bad, bad))
        self.pair_at = np.concatenate((self.pair_at, self.pair_at[-1] + np.cumsum(per)))
        self.pair, self.times = np.concatenate((self.pair, key[fresh])), np.concatenate((self.times, times))
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.slot = np.insert(self.slot, at, np.arange(base, base + count))

    def _written(self, count, ia, ib, ga, gb, na, in_a, in_b, unit) -> list[bytes]:
        """``a1,a2|b1;`` of every group, joined per unit."""
        comma, bar, semi = self.text
        last_a = np.cumsum(in_a) - 1
        last_b = np.cumsum(in_b) - 1
        ta, tb = [comma[i] for i in ia.tolist()], [comma[i] for i in ib.tolist()]
        for k in last_a.tolist():
            ta[k] = bar[ia[k]]
        for k in last_b.tolist():
            tb[k] = semi[ib[k]]
        parts = ta + tb
        order = np.lexsort((np.arange(len(parts)), np.concatenate((ga, gb))))  # stable: A's tokens stand before B's
        parts = [parts[k] for k in order.tolist()]
        size = np.bincount(unit, weights=in_a + in_b, minlength=count).astype(np.int64)
        ends = np.cumsum(size)
        return [b"".join(parts[x:y]) for x, y in zip((ends - size).tolist(), ends.tolist())]

    def slots(self, texts: pa.Array):
        """(text of each unit, distinct units: place in the memo, place of each unit among them) of ``texts``."""
        buf, doc, s, e = self.units(texts)
        uniq, first, inv = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > self.memo_units:
            self._clear()
        at = np.searchsorted(self.hash, uniq)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == uniq[known]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(buf, uniq[new], s[first[new]], e[first[new]])
            at = np.searchsorted(self.hash, uniq)
        return doc, self.slot[at], inv

    def align(self, texts: pa.Array):
        """Of each text: its groups as written, and its numbers (``_Chunk``)."""
        n_docs = len(texts)
        doc, slot, inv = self.slots(_led(texts))
        bad = np.zeros(n_docs, bool)
        bad[doc[self.bad[slot][inv]]] = True
        keep = ~bad[doc]
        doc, inv = doc[keep], inv[keep]
        n = np.stack([np.bincount(doc, weights=self.n[slot, k][inv], minlength=n_docs) for k in range(4)], axis=1).astype(np.int64)
        ends = np.searchsorted(doc, np.arange(n_docs + 1))
        written = [self.groups[i] for i in slot[inv].tolist()]
        groups = [b"".join(written[x:y])[:-1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        # each document's distinct pairs, by way of its distinct units
        unit, count = np.unique(doc * max(1, len(slot)) + inv, return_counts=True)
        d, u = unit // max(1, len(slot)), unit % max(1, len(slot))
        size = (self.pair_at[1:] - self.pair_at[:-1])[slot[u]]
        at = _csr(self.pair_at[:-1][slot[u]], size)
        pairs, place = np.unique(self.pair[at], return_inverse=True)
        code = np.repeat(d, size) * max(1, len(pairs)) + place
        order = np.argsort(code, kind="stable")
        code, times = code[order], (self.times[at] * np.repeat(count, size))[order]
        fresh = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[:len(code)])
        times = np.add.reduceat(times, fresh) if len(fresh) else times
        code = code[fresh]
        return groups, n, pairs, code // max(1, len(pairs)), code % max(1, len(pairs)), times


def _led(texts: pa.Array) -> pa.Array:
    """A space before each text; null and empty texts stay empty."""
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    t = texts.cast(pa.large_string()).fill_null(none)
    return pc.if_else(pc.equal(t, none), none, pc.binary_join_element_wise(none, t, blank))


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker and pair of vocabulary files."""
    return Aligner(a_path, b_path)


# ---- Spark -----------------------------------------------------------------------

_CHUNK = ("chunk long, ids array<long>, n array<array<long>>, sha array<string>, pairs array<long>, held array<int>, "
          "n_docs int, docs binary, places binary, times binary")


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type, compressed: type letter, length, zstd bytes."""
    top = int(x.max()) if len(x) else 0
    kind = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    return kind.encode() + len(x).to_bytes(8, "little") + pa.compress(x.astype("<" + kind).tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype("<" + chr(b[0])), int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], n * kind.itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, groups)``: the groups of each text as ``a1,a2|b1;a3|b2,b3`` (empty without tokens)."""
    def run(batches: Iterator[pa.RecordBatch]):
        al = aligner(a_path, b_path)
        for b in slices(batches, "_text", CHUNK_BYTES):
            yield pa.record_batch([b.column(0), pa.array([x.decode() for x in al.align(b.column(1))[0]])], names=["key", "groups"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text")).mapInArrow(run, "key long, groups string")


def write_chunks(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The aligned documents in chunks (see the module), written to the shared folder and read back."""
    def run(batches: Iterator[pa.RecordBatch]):
        al, part, k = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        for b in slices(batches, "_text", CHUNK_BYTES):
            text_of, n, pairs, doc, place, times = al.align(b.column(1))
            step = np.diff(place, prepend=0)
            fresh = np.concatenate(([True], doc[1:] != doc[:-1]))[:len(doc)]
            step[fresh] = place[fresh]                       # places rise inside a document
            yield pa.record_batch(
                [pa.array([(part << 32) + k]), pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0)),
                 pa.array([n.T.tolist()], pa.list_(pa.list_(pa.int64()))),
                 pa.array([[hashlib.sha256(x).hexdigest() if x else "" for x in text_of]], pa.list_(pa.string())),
                 pa.array([pairs], pa.list_(pa.int64())),
                 pa.array([np.bincount(place, minlength=len(pairs))], pa.list_(pa.int32())), pa.array([b.num_rows], pa.int32()),
                 pa.array([_pack(np.bincount(doc, minlength=b.num_rows))]), pa.array([_pack(step)]), pa.array([_pack(times)])],
                names=["chunk", "ids", "n", "sha", "pairs", "held", "n_docs", "docs", "places", "times"])
            k += 1

    path = shared_path(docs.sparkSession, "alignment")
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    src.mapInArrow(run, _CHUNK).write.parquet(path)
    return docs.sparkSession.read.schema(_CHUNK).parquet(path)


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "held"))).select(
        "chunk", "pos", F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """``(a_id, b_id, n_docs)``: how many documents hold each id pair linked."""
    n = _rows(chunks).groupBy("pair").agg(F.sum("held").alias("n_docs"))
    return n.select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n_docs")


def documents(chunks: DataFrame, width: int) -> DataFrame:
    """Each document's numbers: tokens, groups, links, links to an A id's best B id, counts over its links."""
    rows = _rows(chunks)
    total = (rows.groupBy("pair").agg(F.sum("held").alias("n_docs"))
             .withColumn("a_id", F.expr(f"pair div {width}")))
    best = total.groupBy("a_id").agg(F.max("n_docs").alias("top"))   # one row per id of A's vocabulary at most
    known = (rows.join(total, "pair").join(F.broadcast(best), "a_id")
             .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(
                 "pos", "n_docs", (F.col("n_docs") == F.col("top")).alias("is_best")))).alias("known"))
             .select("chunk", F.col("known.n_docs").alias("counts"), F.col("known.is_best").alias("best")))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                size, places, times = (_unpack(b.column(c)[i].as_py()) for c in ("docs", "places", "times"))
                doc = np.repeat(np.arange(len(size)), size)
                start = np.cumsum(size) - size
                whole = np.cumsum(places)
                before = np.concatenate(([0], whole))[start]
                place = whole - before[doc]
                counts, best_ = b.column("counts")[i], b.column("best")[i]
                counts = np.asarray(counts.values, np.int64) if counts.is_valid else np.zeros(0, np.int64)
                best_ = np.asarray(best_.values).astype(np.int64) if best_.is_valid else np.zeros(0, np.int64)

                def summed(x):
                    return np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(start, len(x))])

                yield pa.record_batch(
                    [b.column("ids")[i].values, *(pa.array(x, pa.int64()) for x in b.column("n")[i].as_py()),
                     pa.array(summed(times * best_[place])), pa.array(summed(times * counts[place])), b.column("sha")[i].values],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return (chunks.select("chunk", "ids", "n", "sha", "docs", "places", "times").join(known, "chunk", "left")
            .mapInArrow(run, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                             "groups_sha256 string"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level and the piece vocabulary aligned over every text of ``documents``."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    width = load_pieces(b).get_piece_size()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return documents(write_chunks(docs, a, b), width).withColumnRenamed("key", "doc_id")
