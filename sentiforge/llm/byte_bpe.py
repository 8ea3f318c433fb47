"""Byte-level BPE from a rank file, run by a sentencepiece model made of it (operator 12).

``model_bytes`` writes the ranks as a sentencepiece BPE model: each token's
bytes become characters (byte b is U+0100 + b), its score is the negative rank,
normalisation is the identity and white space is left as it is.  Merging the
pair of best score, leftmost first, is then the merge by lowest rank.  Texts
are cut into pre-tokens by the pattern, each pre-token is encoded by itself
(one that is a token already has that id, as the rank file's own library has
it); decoding maps ids to pieces and characters back to bytes.

Each row of a table is encoded by itself; null and empty texts have no ids.
Repeated keys and null keys keep their rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm.encode import Encoder
from sentiforge.llm.token_codes import binary_column
from sentiforge.llm.words import slices

_SHIFT = 0x100                 # byte b is the character U+0100 + b
_PART = 4096                   # pre-tokens of one call of the library
_MEMO_TOKENS = 100_000
_DECODED = 1 << 18             # ids that are decoded at a time
_MEMO_UNITS = 700_000
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} are not 0 to {len(pairs) - 1}")
    return [tokens[i] for i in range(len(tokens))]


def to_chars(raw: bytes) -> str:
    return (np.frombuffer(raw, np.uint8).astype("<u4") + _SHIFT).tobytes().decode("utf-32-le")


def to_bytes(piece: str) -> bytes:
    return (np.frombuffer(piece.encode("utf-32-le"), "<u4") - _SHIFT).astype(np.uint8).tobytes()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of the tokens; the unknown piece has the id after the last."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    n = len(tokens)
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _number(3, _BPE) + _number(4, n + 1) + _number(40, n) + b"".join(_number(f, none) for f in (41, 42, 43))
    normalizer = _message(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return (b"".join(piece(to_chars(t), -float(i), _NORMAL) for i, t in enumerate(tokens))
            + piece("<unk>", 0.0, _UNKNOWN) + _message(2, trainer) + _message(3, normalizer))


class ByteBpe(Encoder):
    """``encode(texts)`` -> (ids, offsets) and ``decode(ids, offsets)`` -> (bytes, offsets).

    Texts are cut into units at places where the pattern always cuts (see
    ``Encoder``), and each distinct unit is split and encoded once; the memos start
    afresh when they are full, which changes the speed only."""

    def __init__(self, path: str, pattern: str, memo_units: int = _MEMO_UNITS):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.pattern = regex.compile(pattern)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.keeps_space, self.memo_units, self.dtype = True, memo_units, "<u4"
        self.tok = SimpleNamespace(encode=lambda text, add_special_tokens: SimpleNamespace(ids=self._ids([text])[0]))
        self.memo: dict[str, list[int]] = {}
        raw = [to_bytes(self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self._clear()

    def _ids(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, through the ids of its pre-tokens."""
        split = [self.pattern.findall(u) for u in units]
        if len(self.memo) > _MEMO_TOKENS:
            self.memo = {}
        new = list({t: None for s in split for t in s if t not in self.memo})
        rest = []
        for t in new:
            i = self.whole.get(t.encode())
            if i is None:
                rest.append(t)
            else:
                self.memo[t] = [i]
        for k in range(0, len(rest), _PART):
            part = rest[k:k + _PART]
            self.memo.update(zip(part, self.model.encode([to_chars(t.encode()) for t in part], num_threads=1)))
        return [[i for t in s for i in self.memo[t]] for s in split]

    def _library(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        got = self._ids(units)
        return (list(range(len(units))), np.array([len(x) for x in got], np.int64),
                np.array([i for x in got for i in x], np.uint32))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        ends = np.concatenate(([0], np.cumsum((self.raw_at[1:] - self.raw_at[:-1])[ids])))
        out = np.empty(int(ends[-1]), np.uint8)
        for k in range(0, len(ids), _DECODED):
            part = ids[k:k + _DECODED].astype(np.int64)
            size = self.raw_at[part + 1] - self.raw_at[part]
            at = ends[k:k + len(part)] - ends[k]
            out[ends[k]:ends[k + len(part)]] = self.raw[np.arange(int(size.sum())) + np.repeat(self.raw_at[part] - at, size)]
        return out, ends[offsets]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One coder per Python worker, rank file and pattern."""
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids)``: the ids of each whole text, little-endian unsigned 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]):
        coder = byte_bpe(ranks, pattern)
        for b in slices(batches, "_text"):
            ids, off = coder.encode(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(np.diff(off)), binary_column(ids.astype("<u4"), off)],
                                  names=["key", "n_tokens", "ids"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    return src.mapInArrow(run, "key long, n_tokens long, ids binary")


def decode_ids(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(key, n_tokens, ids, decoded)``: the bytes of the ids of each row (null ids: none).

    An id beyond the vocabulary raises; bytes need not be whole characters."""
    def run(batches: Iterator[pa.RecordBatch]):
        coder = byte_bpe(ranks, pattern)
        for whole in batches:
            col = whole.column(2).cast(pa.large_binary()).fill_null(b"")
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
            data = np.frombuffer(col.buffers()[2], np.uint8) if off[-1] else np.zeros(0, np.uint8)
            i = 0
            while i < whole.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + 8 * _DECODED, side="right")) - 1)
                ids = np.frombuffer(data[off[i]:off[j]].tobytes(), "<u4")
                raw, ends = coder.decode(ids, (off[i:j + 1] - off[i]) // 4)
                b = whole.slice(i, j - i)
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), binary_column(raw, ends)],
                                      names=["key", "n_tokens", "ids", "decoded"])
                i = j

    return coded.select("key", "n_tokens", "ids").mapInArrow(run, "key long, n_tokens long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode ``documents`` by the multilingual rank file, decode the ids and digest both."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode_ids(encode_texts(docs, ranks, pattern), ranks, pattern).select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
