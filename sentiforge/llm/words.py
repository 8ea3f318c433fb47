"""Words, lines and rolling hashes of whole Arrow text columns, in numpy.

Texts are handled as UTF-8 bytes.  A word is a run of bytes other than
0x20 and 0x09-0x0D (never part of a multi-byte character), so byte work is
exact.  Hashes are 64 bit: a random value per byte, summed with powers of an
odd base, then mixed.  Work goes on in slices of a few MB, so memory is
bounded by the slice, or by one text where a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 20
_U = np.uint64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: first byte of a character (not a UTF-8 continuation byte)
IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def _tables(seed: int = 20240229):
    rng = np.random.default_rng(seed)
    byte = rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    base = int(rng.integers(2**61, 2**62)) | 1
    inv = pow(base, -1, 1 << 64)
    powers = np.empty(_CHUNK + 1, dtype=_U)
    inverse = np.empty(_CHUNK + 1, dtype=_U)
    with np.errstate(over="ignore"):
        for arr, b in ((powers, base), (inverse, inv)):
            arr[0] = 1
            n = 1
            while n < len(arr):
                m = min(n, len(arr) - n)
                arr[n:n + m] = arr[:m] * _U(pow(b, n, 1 << 64))
                n += m
    return byte, powers, inverse


_BYTE, _POW, _INV = _tables()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``buf[start:end]`` per span; spans ascend and may not overlap."""
    out = np.zeros(len(start), dtype=_U)
    if not len(start):
        return out
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + _CHUNK, side="right")))
            hi = int(end[j - 1])
            if hi - lo <= _CHUNK:
                acc = np.empty(hi - lo + 1, dtype=_U)
                acc[0] = 0
                np.cumsum(_BYTE[buf[lo:hi]] * _POW[:hi - lo], out=acc[1:])
                s, e = start[i:j] - lo, end[i:j] - lo
                out[i:j] = (acc[e] - acc[s]) * _INV[s]
            else:  # one span longer than a chunk: folded piece by piece
                h = _U(0)
                for p in range(lo, hi, _CHUNK):
                    piece = _BYTE[buf[p:min(p + _CHUNK, hi)]]
                    h = mix(np.array([h + (piece * _POW[:len(piece)]).sum(dtype=_U)]))[0]
                out[i] = h
            i = j
        return mix(out + (end - start).astype(_U))


@dataclass
class Words:
    buf: np.ndarray      #: all texts' bytes, end to end
    offsets: np.ndarray  #: text i is buf[offsets[i]:offsets[i+1]]
    doc: np.ndarray      #: text number of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    first: np.ndarray    #: text i's words are first[i]:first[i+1]

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    arr = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def find_words(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """All words of all texts, in order."""
    buf, off = text_bytes(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    space = IS_SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= space[1:] | edge[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    doc = np.searchsorted(off, s, side="right") - 1
    first = np.searchsorted(s, off)
    return Words(buf, off, doc, s, e, span_hashes(buf, s, e) if hashes else None, first)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` hashes in a row (``len(h) - n + 1`` of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        acc = h[:m].copy()
        for k in range(1, n):
            acc = acc * _U(0x9E3779B97F4A7C15 | 1) + h[k:k + m]
            acc ^= acc >> _U(29)
        return mix(acc)


def doc_windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index of the window's first word, hash) of all n-word windows inside one text."""
    h = windows(w.hash, n)
    pos = np.arange(len(h))
    ok = w.doc[:len(h)] == w.doc[n - 1:n - 1 + len(h)] if len(h) else np.zeros(0, bool)
    return pos[ok], h[ok]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each holds about ``limit`` bytes."""
    for b in batches:
        if b.num_rows == 0:
            continue
        arr = b.column(b.schema.get_field_index(column)).cast(pa.large_string())
        off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
