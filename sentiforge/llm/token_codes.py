"""Token ids of a corpus as directly addressable codes (operator 8).

Every id is split into byte-wide chunks.  Level 0 holds the low byte of every
id and one continuation bit each; level 1 holds the next byte of the ids whose
bit is set, with its own bits, and so on.  A rank directory per level (set bits
before every 512-bit block) makes the place of a chunk on the next level a
table look-up and a popcount, so any token is read on its own, without decoding
a block.

File format: a Parquet table, one row per segment of whole texts (about
``segment_tokens`` ids, or one longer text), in ascending order of the key:
``part, seg`` (place in the order), ``local_start`` (ids before it in its part),
``n_tokens``, ``keys`` and ``ends`` (key and running end of each text), ``codes``.

``codes`` is little-endian: ``b"DAC1"``, uint32 number of ids, uint32 number of
levels, then per level uint32 number of chunks, the chunks (1 byte each), the
bitmap (little bit order, padded to 64 bytes) and the directory (uint32 per
block).  The last level has an all-zero bitmap.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm.encode import encoder
from sentiforge.llm.shared import shared_path
from sentiforge.llm.words import slices

SEGMENT_TOKENS = 1 << 19
_BLOCK_BYTES = 64
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


# ---- the code of one segment -----------------------------------------------

def pack_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % _BLOCK_BYTES, np.uint8)))
        ones = _POPCOUNT[bits].reshape(-1, _BLOCK_BYTES).sum(axis=1, dtype=np.uint32)
        directory = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes()
                      + directory.tobytes())
        rest = rest[more] >> np.uint32(8)
    return b"DAC1" + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """Reader of ``pack_codes``: ``codes[i]`` is one id, ``all()`` every id."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        self.n, n_levels = struct.unpack_from("<II", data, 4)
        at, self.levels = 12, []
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, m, at)
            at += m
            size = -(-m // 8)
            size += -size % _BLOCK_BYTES
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            directory = np.frombuffer(data, "<u4", size // _BLOCK_BYTES, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = i >> 3, i & 7
            if not (int(bits[byte]) >> bit) & 1:
                break
            block = byte // _BLOCK_BYTES
            rank = int(directory[block]) + int(_POPCOUNT[bits[block * _BLOCK_BYTES:byte]].sum())
            i = rank + int(_POPCOUNT[int(bits[byte]) & ((1 << bit) - 1)])
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.uint32)
        at, shift = slice(None), 0
        for chunks, bits, _ in self.levels:
            out[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = more if isinstance(at, slice) else at[more]
            shift += 8
        return out


# ---- Spark -----------------------------------------------------------------

def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array whose row i is ``values[offsets[i]:offsets[i+1]]``."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())


def encode_texts(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text",
                 end_id: int | None = 0) -> DataFrame:
    """``(key, n_tokens, ids)``: ids of each whole text (null: empty) and the end
    id, little-endian, ``n_tokens`` equal-width numbers (uint16 if the vocabulary fits, else uint32)."""
    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(vocab)
        for b in slices(batches, "_text"):
            ids, off = enc.encode(b.column(1))
            if end_id is not None:
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = off + np.arange(len(off))
            yield pa.record_batch([b.column(0), pa.array(np.diff(off)),
                                   binary_column(ids.astype(enc.dtype), off)], names=["key", "n_tokens", "ids"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    return src.mapInArrow(run, "key long, n_tokens long, ids binary")


def write_codes(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                path: str | None = None, parts: int | None = None,
                segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Encode ``docs`` and write the coded files in ascending key order; returns the path.

    The key range is cut at quantiles of the key (one number per part, found
    from the key column alone), so texts are encoded once and their ids are
    shuffled once.  Repeated keys keep one row each (ordered by their ids); a
    null key sorts first."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-codes")
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / parts for i in range(1, parts)], 100_000)).first()[0]
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:  # number of cuts below the key, by binary search inside the expression
        arr = F.array(*[F.lit(c).cast("long") for c in cuts])
        place = F.coalesce(F.size(F.filter(arr, lambda c: c < F.col("key"))), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        seg, done = 0, 0
        keys, ids, held = [], [], 0

        def segment():
            nonlocal seg, done, keys, ids, held
            all_ids = np.concatenate(ids)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([np.cumsum([len(x) for x in ids])], pa.list_(pa.int64())),
                 pa.array([pack_codes(all_ids)], pa.binary())],
                names=["part", "seg", "local_start", "n_tokens", "keys", "ends", "codes"])
            seg, done, keys, ids, held = seg + 1, done + held, [], [], 0
            return row

        for b in batches:
            for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = x.as_buffer()
                keys.append(k)
                ids.append(np.frombuffer(raw, dtype="<u2" if raw.size == 2 * n else "<u4"))
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield segment()
        if keys:
            yield segment()

    (encode_texts(docs, vocab, key, text, end_id)
     .repartitionById(len(cuts) + 1, place.cast("int"))
     .sortWithinPartitions("key", "ids")
     .mapInArrow(run, "part int, seg int, local_start long, n_tokens long, keys array<long>, ends array<long>, codes binary")
     .write.parquet(path))
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all texts before the segment.

    Offsets of parts come from one total per part (their number is a setting, not the data's size)."""
    seg = spark.read.parquet(path)
    totals = {r["part"]: r["n"] for r in seg.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, done = [], 0
    for p in sorted(totals):
        starts.append((p, done))
        done += totals[p]
    off = spark.createDataFrame(starts, "part int, part_start long")
    return (seg.join(F.broadcast(off), "part")
            .withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start"))


def read_texts(segments: DataFrame) -> DataFrame:
    """``(key, start, n_tokens, ids)`` of every text, decoded from the files."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                ids = Codes(b.column(3)[i].as_py()).all().astype("<u4")
                ends = np.asarray(b.column(2)[i].values, dtype=np.int64)
                off = np.concatenate(([0], ends))
                yield pa.record_batch([b.column(1)[i].values, pa.array(off[:-1] + b.column(0)[i].as_py()),
                                       pa.array(np.diff(off)), binary_column(ids, off)],
                                      names=["key", "start", "n_tokens", "ids"])

    return (segments.select("start", "keys", "ends", "codes")
            .mapInArrow(run, "key long, start long, n_tokens long, ids binary"))


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as coded token files and report each text as read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_codes(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_texts(read_segments(spark, path)).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
