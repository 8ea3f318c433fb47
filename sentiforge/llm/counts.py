"""Per-text counts over a slice of texts (numpy), shared by the quality operators."""

from __future__ import annotations

import numpy as np

from sentiforge.llm.words import IS_LEAD, IS_SPACE, Words, doc_windows, mix, span_hashes

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True  # fixed value: the symbols that are counted


def per_text(w: Words, flags: np.ndarray) -> np.ndarray:
    """Number of set flags (one per byte) in each text."""
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[w.offsets[1:]] - c[w.offsets[:-1]]


def n_words(w: Words) -> np.ndarray:
    return np.diff(w.first)


def word_chars(w: Words) -> np.ndarray:
    """Code points inside words."""
    return per_text(w, IS_LEAD[w.buf] & ~IS_SPACE[w.buf])


def n_symbols(w: Words) -> np.ndarray:
    return per_text(w, SYMBOL[w.buf])


def _keys(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number per (text, hash)."""
    with np.errstate(over="ignore"):
        return mix(h + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def n_dup_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word equal to an earlier such line, lines with a word) per text."""
    n = w.n_texts
    brk = np.flatnonzero(w.buf == 10)
    starts = np.unique(np.concatenate((w.offsets[:-1], brk + 1)))
    starts = starts[starts < len(w.buf)]
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.append(starts[1:], len(w.buf))
    last = w.buf[ends - 1] == 10
    ends = ends - last                       # without the line break
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    key = _keys(doc, span_hashes(w.buf, starts, ends))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(doc, minlength=n)
    return lines - np.bincount(doc[first], minlength=n), lines


def n_repeat_words(w: Words, n: int = 8) -> np.ndarray:
    """Words inside ``n``-word windows that occur twice or more in their text."""
    pos, h = doc_windows(w, n)
    key = _keys(w.doc[pos], h)
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(w.n_texts, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = pos[twice[at] == key]
    cover = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + n, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(w.doc[inside], minlength=w.n_texts)


def same_as_before(w: Words) -> np.ndarray:
    """Per word: equal to the word before it in the same text."""
    out = np.zeros(len(w.start), dtype=bool)
    out[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i+1]]`` per segment, each summed on its own."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out
