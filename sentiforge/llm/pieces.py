"""SentencePiece encoding and decoding by a max-plus scan (operator 9).

A text (``▁`` before it and for every space) is cut into the pieces of a
SentencePiece vocabulary with the greatest sum of scores; a character that no
piece covers costs the lowest score less 10 and is written as byte pieces.
Scores are whole numbers, so sums are exact; of equally good cuts the one whose
last piece is longest (then the one before it, and so on) is taken.

No piece goes over a pair of characters that stand beside each other in no piece,
so every cut divides there: an ordinary text is the sum of the units between such
places and each distinct unit is solved once.  A text above ``GIANT`` characters
is split into chunks that become rows: the state at a chunk boundary is how far
a piece reaches over it, and a chunk's transfer matrix holds the best score from
every state before it to every state after it.  Max-plus products of matrices
are associative: they are combined per block of chunks, then the blocks of a
text, which gives the scores of the states before every chunk.  With them each
chunk maps a state after it to the state before it on the best path (ties
included); these small maps are followed from the end of the text, and each
chunk is traced on its own.  A chunk with such a place in it has a matrix of rank
one (scores up to the place plus scores from it), found without the full recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiforge.llm.encode import Encoder
from sentiforge.llm.shared import written
from sentiforge.llm.token_codes import binary_column
from sentiforge.llm.words import slices, text_bytes

GIANT = 1 << 16   # characters of a text that is not chunked
CHUNK = 1 << 14   # characters of a chunk
BLOCK = 64        # chunks combined at a time
_NEVER = -(1 << 60)
_BARRED = -1e8    # pieces scored so low are placeholders that no cut may use


def normalise(text: str) -> str:
    return "▁" + text.replace(" ", "▁") if text else ""


class Vocabulary:
    """Pieces and whole-number scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {}
        self.ids: dict[str, tuple[int, int]] = {}
        low = 0.0
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > _BARRED:
                self.ids[p] = (i, round(sp.get_score(i)))
                low = min(low, sp.get_score(i))
        self.unknown = round(low - 10)
        self.longest = max(map(len, self.ids))
        # beginnings of pieces too (with None), so that a search ends where no piece goes on
        self.table = {p[:n]: None for p in self.ids for n in range(1, len(p))} | self.ids
        self.by_word = not any("▁" in p.lstrip("▁") for p in self.ids)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # [first byte, second byte]: both ASCII and beside each other in no piece
        self.apart = np.zeros((256, 256), dtype=bool)
        self.apart[:128, :128] = True
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                if x < "\x80" and y < "\x80":
                    self.apart[ord(x), ord(y)] = False
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len

    def divided(self, text: str, at: int) -> bool:
        """No piece goes over position ``at`` of ``text``."""
        x, y = text[at - 1], text[at]
        if y == "▁":
            return self.by_word and x != "▁"
        return x < "\x80" and y < "\x80" and bool(self.apart[ord(x), ord(y)])

    def first_division(self, text: str, size: int) -> int | None:
        """The first such position that every state before the chunk has reached."""
        return next((at for at in range(max(self.longest - 1, 1), size) if self.divided(text, at)), None)

    def starts(self, text: str, at: int):
        """(end, id or None, score) of the pieces of ``text`` from ``at``."""
        get, found = self.table.get, False
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            hit = get(text[at:end], False)
            if hit:
                found = found or end == at + 1
                yield end, hit[0], hit[1]
            elif hit is False:
                break
        if not found:
            yield at + 1, None, self.unknown

    def _forward(self, text: str, size: int, before) -> tuple[list, list]:
        """Best score and last piece at every position, from the scores ``before`` of the first positions."""
        n = max(size, len(before) - 1) + self.longest
        best, back = [_NEVER] * (n + 1), [None] * (n + 1)
        best[:len(before)] = before
        get, last, reach = self.table.get, len(text), self.longest
        for at in range(size):  # ``starts`` written out: this is the inner loop of every word
            here = best[at]
            if here <= _NEVER // 2:
                continue
            one = get(text[at], False)
            score = here + (one[1] if one else self.unknown)
            if score > best[at + 1]:
                best[at + 1], back[at + 1] = score, (at, one[0] if one else None)
            if one is False:
                continue
            for end in range(at + 2, min(at + reach, last) + 1):
                hit = get(text[at:end], False)
                if hit:
                    score = here + hit[1]
                    if score > best[end]:
                        best[end], back[end] = score, (at, hit[0])
                elif hit is False:
                    break
        return best, back

    def trace(self, text: str, size: int, before=(0,), exit_: int = 0) -> list[int]:
        """Ids of the best cut of ``text`` up to ``size + exit_``; pieces start before ``size``."""
        _, back = self._forward(text, size, before)
        out: list[int] = []
        at = size + exit_
        while back[at]:
            start, i = back[at]
            if i is None:
                out += [self.bytes[b] for b in reversed(text[start:at].encode())]
            else:
                out.append(i)
            at = start
        return out[::-1]

    def entries(self, text: str, size: int, before) -> list[int]:
        """The state before the chunk on the best path to each state after it."""
        cut = self.first_division(text, size)
        if cut is not None:  # every path goes through this place
            _, back = self._forward(text[:cut], cut, before)
            while back[cut]:
                cut = back[cut][0]
            return [cut if cut < self.longest else 0] * self.longest
        _, back = self._forward(text, size, before)
        out = []
        for j in range(self.longest):
            at = size + j
            while back[at]:
                at = back[at][0]
            out.append(at if at < self.longest else 0)
        return out

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Matrix [state before, state after] of the chunk ``text[:size]``, followed by the characters beyond it."""
        m = self.longest
        cut = self.first_division(text, size)
        if cut is None:
            return self.full_transfer(text, size)
        best, _ = self._forward(text[cut:], size - cut, (0,))
        return product(self.full_transfer(text[:cut], cut)[:, :1], np.array([best[size - cut:size - cut + m]], dtype=np.int64))

    def full_transfer(self, text: str, size: int) -> np.ndarray:
        """``transfer`` by the recursion over all states."""
        m = self.longest
        best = np.full((size + m, m), _NEVER, dtype=np.int64)
        for i in range(m):
            best[i, i] = 0
        for at in range(size):
            here = best[at]
            if here.max() > _NEVER // 2:
                for end, _, s in self.starts(text, at):
                    np.maximum(best[end], here + s, out=best[end])
        return np.maximum(best[size:size + m].T, _NEVER)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the normalised text of ids."""
        n = self.raw_len[ids]
        return self.raw[np.arange(int(n.sum())) + np.repeat(self.raw_start[ids] - np.cumsum(n) + n, n)].tobytes()

    def decode(self, ids) -> str:
        """The normalised text of ids."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


def plain_text(normalised: str) -> str:
    """Text of a decoded, normalised text."""
    return normalised.replace("▁", " ")[1:]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), _NEVER)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Words(Encoder):
    """The memo of ``Encoder`` over words of normalised text, solved by ``Vocabulary.trace``."""

    def __init__(self, path: str, memo_units: int = 320_000):
        self.vocab, self.memo_units, self.keeps_space = vocabulary(path), memo_units, False
        self._clear()

    def _units(self, texts):
        buf, off = text_bytes(texts)
        n = len(buf)
        mark = np.zeros(n + 3, dtype=bool)
        if n >= 3:
            mark[:n - 2] = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
        cut = np.zeros(n + 1, dtype=bool)
        if self.vocab.by_word:
            cut[:n] = mark[:n]
            cut[3:n] &= ~mark[:max(n - 3, 0)]  # only the first of a run of ▁
        if n > 1:
            cut[1:n] |= self.vocab.apart[buf[:-1], buf[1:]]
        cut[off[:-1]] = True
        s = np.flatnonzero(cut[:n])
        e = np.append(s[1:], n)
        if not len(s):
            e = s
        return buf, off, np.searchsorted(off, s, side="right") - 1, s, e

    def _library(self, units):
        got = [self.vocab.trace(u, len(u)) for u in units]
        lens = np.array([len(x) for x in got], dtype=np.int64)
        return list(range(len(units))), lens, np.array([y for x in got for y in x], dtype=np.uint32)


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


SLICE = 2 << 20   # bytes of text encoded at a time


def _encode_ordinary(docs: DataFrame, path: str, key: str, text: str, giant: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "_text", SLICE):
            norm = pa.array([normalise(t) for t in b.column(1).to_pylist()], pa.large_string())
            ids, off = _words(path).encode(norm)
            zero = np.zeros(len(norm), np.int64)
            yield pa.record_batch([b.column(0), pa.nulls(len(norm), pa.string()), pa.array(zero), binary_column(ids.astype("<u4"), off),
                                   b.column(1).cast(pa.string())], names=["key", "text_id", "chunk", "ids", "cut"])

    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(key).cast("long").alias("key"), t.alias("_text")).where(F.length("_text") < giant)
    return src.mapInArrow(run, "key long, text_id string, chunk long, ids binary, cut string")


def _chunks(docs: DataFrame, path: str, key: str, text: str, giant: int, size: int) -> DataFrame:
    """Written ``(key, text_id, chunk, block, size, text, source, matrix)`` of the giant texts.

    ``text`` carries the characters beyond the chunk that a piece may reach, ``source`` is the same
    stretch of the text itself.  The chunks are written before their matrices are made, so those
    of one text are spread over all tasks."""
    def cut(batches: Iterator[pa.RecordBatch]):
        vocab, part, row = vocabulary(path), TaskContext.get().partitionId(), 0
        for b in slices(batches, "_text"):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                norm = normalise(t)
                row += 1
                for c, at in enumerate(range(0, len(norm), size)):
                    n = min(size, len(norm) - at)
                    end = at + n + vocab.longest - 1
                    yield pa.record_batch(
                        [pa.array([k], pa.int64()), pa.array([f"{part}-{row}"]), pa.array([c], pa.int64()),
                         pa.array([c // BLOCK], pa.int64()), pa.array([n], pa.int64()), pa.array([norm[at:end]]),
                         pa.array([t[max(at - 1, 0):end - 1]])],      # the text lacks the blank that comes first
                        names=["key", "text_id", "chunk", "block", "size", "text", "source"])

    def matrices(batches: Iterator[pa.RecordBatch]):
        vocab = vocabulary(path)
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                n, piece = one.column(4)[0].as_py(), one.column(5)[0].as_py()
                m = vocab.transfer(piece, n)
                m[:, len(piece) - n + 1:] = _NEVER  # no piece reaches beyond the text
                yield pa.record_batch([*one.columns, pa.array([m.tobytes()], pa.binary())], names=[*one.schema.names, "matrix"])

    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(key).cast("long").alias("key"), t.alias("_text")).where(F.length("_text") >= giant)
    cols = "key long, text_id string, chunk long, block long, size long, text string, source string"
    pieces = written(src.mapInArrow(cut, cols), "cuts")
    return written(pieces.repartition("text_id", "chunk").mapInArrow(matrices, cols + ", matrix binary"), "chunks")


def _after(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of the states after a matrix, the best one being 0."""
    out = (v[:, None] + m).max(axis=0)
    return np.where(out > _NEVER // 2, out - out.max(), _NEVER)


def _fold(rows: DataFrame, group: list[str], order: str, path: str, product_only: bool) -> DataFrame:
    """Streams the matrices of a group in order: their product, or the scores before each of them.

    A task holds one matrix and the running result, however long the text."""
    def run(batches: Iterator[pa.RecordBatch]):
        m = vocabulary(path).longest
        at, total, v = None, None, None
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for r in zip(*cols):
                mat, here = np.frombuffer(r[-1], np.int64).reshape(m, m), r[:len(group)]
                if here != at:
                    if total is not None:
                        out.append(dict(zip(group, at)) | {"matrix": total.tobytes()})
                    at, total = here, None
                    if not product_only:
                        v = np.frombuffer(r[-2], np.int64) if r[-2] else np.array([0] + [_NEVER] * (m - 1))
                if product_only:
                    total = mat if total is None else product(total, mat)
                else:
                    out.append(dict(zip([*group, order], r)) | {"before": v.tobytes()})
                    v = _after(v, mat)
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if total is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(group, at)) | {"matrix": total.tobytes()}])

    types = {"text_id": "string", "block": "long", "chunk": "long"}
    keep = group if product_only else [*group, order]
    cols = [*group, order, "matrix"] if product_only else [*group, order, "before", "matrix"]
    return (rows.select(*cols).repartition(*group).sortWithinPartitions(*group, order)
            .mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + (", matrix binary" if product_only else ", before binary")))


def _encode_giants(chunks: DataFrame, path: str) -> DataFrame:
    blocks = written(_fold(chunks, ["text_id", "block"], "chunk", path, True), "blocks")
    per_block = _fold(blocks.withColumn("before", F.lit(None).cast("binary")), ["text_id"], "block", path, False)
    per_chunk = _fold(chunks.join(per_block, ["text_id", "block"]), ["text_id", "block"], "chunk", path, False)
    known = written(chunks.drop("matrix", "block").join(per_chunk.drop("block"), ["text_id", "chunk"]), "scored")

    def maps(batches: Iterator[pa.RecordBatch]):
        vocab = vocabulary(path)
        for b in batches:
            tid, c, size, text, before = (x.to_pylist() for x in b.columns)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(
                [vocab.entries(t, n, np.frombuffer(v, np.int64).tolist()) for t, n, v in zip(text, size, before)],
                pa.list_(pa.int32()))], names=["text_id", "chunk", "entries"])

    def follow(batches: Iterator[pa.RecordBatch]):
        at, state = None, 0
        for b in batches:
            out = []
            for tid, c, entries in zip(*(x.to_pylist() for x in b.columns)):
                if tid != at:
                    at, state = tid, 0
                out.append((tid, c, entries[state], state))
                state = entries[state]
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], names=["text_id", "chunk", "g_in", "g_out"])

    def trace(batches: Iterator[pa.RecordBatch]):
        vocab = vocabulary(path)
        for b in batches:
            for key, tid, c, size, text, before, source, a, z in zip(*(x.to_pylist() for x in b.columns)):
                ids = vocab.trace(text, size, np.frombuffer(before, np.int64).tolist(), z)
                lead = 0 if c else 1                  # the first chunk's blank is not in the source
                own = source[max(a - lead, 0):size + z - lead]
                yield pa.record_batch([pa.array([key], pa.int64()), pa.array([tid]), pa.array([c], pa.int64()),
                                       pa.array([np.array(ids, "<u4").tobytes()], pa.binary()), pa.array([own])],
                                      names=["key", "text_id", "chunk", "ids", "cut"])

    cols = ["text_id", "chunk", "size", "text", "before"]
    states = (known.select(*cols).mapInArrow(maps, "text_id string, chunk long, entries array<int>")
              .repartition("text_id").sortWithinPartitions("text_id", F.desc("chunk"))
              .mapInArrow(follow, "text_id string, chunk long, g_in long, g_out long"))
    return (known.join(states, ["text_id", "chunk"]).select("key", *cols, "source", "g_in", "g_out")
            .mapInArrow(trace, "key long, text_id string, chunk long, ids binary, cut string"))


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", giant: int = GIANT,
                  chunk: int = CHUNK) -> DataFrame:
    """``(key, text_id, chunk, ids, cut)``: ids (little-endian uint32) of every whole text and the text they stand for.

    A text of ``giant`` characters or more has a row per chunk and a ``text_id``;
    another has one row and a null ``text_id``.  Null text: empty, no ids."""
    return _encode_ordinary(docs, path, key, text, giant).union(_encode_giants(_chunks(docs, path, key, text, giant, chunk), path))


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``(key, text_id, chunk, n_tokens, weighted, total, exact, decoded, same)`` of every row: the text its ids
    stand for; ``exact`` if that is the normalised text they were made from, ``same`` if it is the source
    text itself (one that holds U+2581 comes back with spaces); sums of ids (and of id times place)
    modulo 2^31 - 1, which add up over chunks.  The texts of a chunked row join in order of ``chunk``."""
    def run(batches: Iterator[pa.RecordBatch]):
        vocab, p = vocabulary(path), (1 << 31) - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for k, tid, c, raw, cut in zip(*(x.to_pylist() for x in whole.slice(at, 256).columns)):
                    ids = np.frombuffer(raw, "<u4").astype(np.int64)
                    place = (ids * (np.arange(len(ids)) % p)) % p
                    text = vocab.decode(ids).replace("▁", " ")
                    text = text if c else text[1:]
                    out.append((k, tid, c, len(ids), int(place.sum() % p), int(ids.sum() % p), text == cut.replace("▁", " "), text, text == cut))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                      names=["key", "text_id", "chunk", "n_tokens", "weighted", "total", "exact", "decoded", "same"])

    return encoded.select("key", "text_id", "chunk", "ids", "cut").mapInArrow(
        run, "key long, text_id string, chunk long, n_tokens long, weighted long, total long, exact boolean, decoded string, same boolean")


def digest(decoded: DataFrame) -> DataFrame:
    """``(key, n_tokens, ids_hash, exact)`` per text: number of ids, sum of id * place modulo 2^31 - 1 over the whole text."""
    p = (1 << 31) - 1
    decoded = written(decoded.drop("decoded", "same"), "decoded")  # both parts below read it
    whole = decoded.where("text_id IS NULL").select("key", "n_tokens", F.col("weighted").alias("ids_hash"), "exact")
    before = F.sum("n_tokens").over(Window.partitionBy("text_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    parts = decoded.where("text_id IS NOT NULL").withColumn("_o", F.coalesce(before, F.lit(0)))
    giants = (parts.groupBy("key", "text_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum((F.col("weighted") + (F.col("_o") % p) * F.col("total")) % p) % p).alias("ids_hash"), F.bool_and("exact").alias("exact"))
        .drop("text_id"))
    return whole.unionByName(giants)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with the 32k pieces, decode the ids, report both."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(decode_pieces(encode_pieces(docs, path), path)).select(F.col("key").alias("doc_id"), "n_tokens", "ids_hash", "exact")
