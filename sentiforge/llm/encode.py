"""Token ids of whole texts by the tokenizers library, each distinct word once.

A text is cut into units at places where the tokenizer's own pre-tokenizer
always cuts, so the ids of a text are the ids of its units end to end.  Units
are hashed in numpy, only units not yet seen by this Python worker go to the
library, and the ids of all texts are gathered from the memo.  The memo is
started afresh beyond ``memo_units``; that changes the speed only.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sentiforge.llm.words import IS_SPACE, LOWER, find_words, span_hashes, text_bytes

MEMO_UNITS = 1_500_000
_JOIN = 512
# plain units: printable ASCII and the Latin-1 letters, whose pre-tokens a simple pattern counts
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PRE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+", re.IGNORECASE)


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings inside a text are ordinary text
    try:
        t.model._resize_cache(0)    # units are distinct: the library's own word cache would only cost time
    except AttributeError:
        pass
    return t


def _odd_texts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts holding white space other than 0x20 and 0x09-0x0D (they go to the library whole)."""
    odd = (buf >= 0x1C) & (buf <= 0x1F)
    hi = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    if len(hi):
        b0 = buf[hi]
        b1 = buf[np.minimum(hi + 1, len(buf) - 1)]
        b2 = buf[np.minimum(hi + 2, len(buf) - 1)]
        hit = (((b0 == 0xC2) & ((b1 == 0xA0) | (b1 == 0x85)))
               | ((b0 == 0xE1) & ((b1 == 0x9A) | (b1 == 0xA0)))
               | ((b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8F) | ((b2 >= 0xA8) & (b2 <= 0xAF))))
               | ((b0 == 0xE2) & (b1 == 0x81) & ((b2 == 0x9F) | (b2 >= 0xA0)))
               | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)))
        odd[hi[hit]] = True
    at = np.flatnonzero(odd)
    out = np.zeros(len(off) - 1, dtype=bool)
    out[np.searchsorted(off, at, side="right") - 1] = True
    return out


class Encoder:
    """``encode(texts)`` -> (ids, offsets): text i has ids[offsets[i]:offsets[i+1]]."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        self.tok = _load(path)
        self.memo_units = memo_units
        # byte-level vocabularies keep white space in their ids; word-end ones drop it
        self.keeps_space = len(self.tok.encode("a  b", add_special_tokens=False).ids) != \
            len(self.tok.encode("a b", add_special_tokens=False).ids)
        vocab = self.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"  # the narrowest type for an id
        self.mark = np.zeros(size, dtype=bool)
        for piece, i in vocab.items():
            self.mark[i] = piece.startswith("Ġ") if self.keeps_space else piece.endswith("</w>")
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)    # sorted unit hashes
        self.slot = np.zeros(0, np.int64)     # their places in start
        self.start = np.zeros(1, np.int64)    # CSR over ids
        self.ids = np.zeros(0, np.uint32)

    # ---- units -------------------------------------------------------------
    def _units(self, texts: pa.Array):
        if not self.keeps_space:
            w = find_words(texts, hashes=False)
            buf = w.buf
            # an ASCII word has the same ids in lower case; others keep their case
            high = np.concatenate(([0], np.cumsum(buf >= 0x80)))
            ascii_word = high[w.end] == high[w.start]
            low = LOWER[buf]
            if not ascii_word.all():
                keep = np.flatnonzero(~ascii_word)
                for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist()):
                    low[a:b] = buf[a:b]
            return low, w.offsets, w.doc, w.start, w.end
        buf, off = text_bytes(texts)
        n = len(buf)
        if n == 0:
            z = np.zeros(0, np.int64)
            return buf, off, z, z, z
        space = IS_SPACE[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        cut = edge[:n].copy()
        nxt = np.ones(n, dtype=bool)           # followed by a non-space byte of the same text
        nxt[:-1] = ~space[1:] & ~edge[1:n]
        nxt[-1] = False
        last = space & nxt                     # last space of a run that a word follows
        cut |= last
        run = space.copy()
        run[1:] &= ~space[:-1] | edge[1:n]
        cut |= run                             # first space of a run
        after = np.flatnonzero(last & (buf != 0x20)) + 1
        cut[after] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        doc = np.searchsorted(off, s, side="right") - 1
        return buf, off, doc, s, e

    # ---- library -----------------------------------------------------------
    def _library(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, lengths, ids): unit ``order[k]`` has the k-th run of ids, ``lengths[k]`` long."""
        joined, rest = [], []
        if self.keeps_space:
            for i, u in enumerate(units):
                (joined if len(u) > 1 and u[0] == " " and not u[1].isspace() else rest).append(i)
        else:
            for i, u in enumerate(units):
                (joined if _PLAIN.match(u) else rest).append(i)
        glue = "" if self.keeps_space else " "
        groups = [joined[i:i + _JOIN] for i in range(0, len(joined), _JOIN)]
        order: list[int] = []
        lens, runs = [], []
        for k in range(0, len(groups), 16):
            part = groups[k:k + 16]
            encs = self.tok.encode_batch_fast([glue.join([units[i] for i in g]) for g in part],
                                              add_special_tokens=False)
            for g, enc in zip(part, encs):
                ids = np.asarray(enc.ids, dtype=np.uint32)
                if self.keeps_space:
                    begin = np.flatnonzero(self.mark[ids])
                else:  # ends of pre-tokens -> ends of units, by each unit's number of pre-tokens
                    ends = np.flatnonzero(self.mark[ids]) + 1
                    per = np.cumsum([len(_PRE.findall(units[i])) for i in g])
                    begin = np.concatenate(([0], ends[per[:-1] - 1])) if len(ends) == per[-1] else ()
                if len(begin) != len(g):
                    rest.extend(g)
                    continue
                order += g
                lens.append(np.diff(begin, append=len(ids)))
                runs.append(ids)
        for k in range(0, len(rest), 256):
            part = rest[k:k + 256]
            got = [e.ids for e in self.tok.encode_batch([units[i] for i in part], add_special_tokens=False)]
            order += part
            lens.append(np.array([len(x) for x in got], dtype=np.int64))
            runs.append(np.array([y for x in got for y in x], dtype=np.uint32))
        return order, np.concatenate(lens).astype(np.int64), np.concatenate(runs)

    def _learn(self, buf, hashes, s, e):
        """Add the units (distinct, unseen, hashes ascending) to the memo."""
        raw = buf.tobytes()
        units = [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist())]
        order, lens, ids = self._library(units)
        base = len(self.start) - 1
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(lens)))
        self.ids = np.concatenate((self.ids, ids))
        slot = np.empty(len(units), dtype=np.int64)
        slot[order] = np.arange(base, base + len(units))
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.slot = np.insert(self.slot, at, slot)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        buf, off, doc, s, e = self._units(texts)
        odd = _odd_texts(buf, off) if self.keeps_space else np.zeros(n, dtype=bool)
        if odd.any():
            keep = ~odd[doc]
            doc, s, e = doc[keep], s[keep], e[keep]
        h = span_hashes(buf, s, e)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > self.memo_units:
            self._clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(buf, uniq[new], s[first[new]], e[first[new]])
            at = np.searchsorted(self.keys, uniq)
        slot = self.slot[at][inv] if len(uniq) else np.zeros(0, np.int64)
        lens = self.start[slot + 1] - self.start[slot]
        total = int(lens.sum())
        begin = np.cumsum(lens) - lens
        ids = self.ids[np.arange(total) + np.repeat(self.start[slot] - begin, lens)] if total else np.zeros(0, np.uint32)
        counts = np.bincount(doc, weights=lens, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if odd.any():
            parts, py = [], texts.to_pylist()
            for i in range(n):
                if odd[i]:
                    x = np.asarray(self.tok.encode(py[i], add_special_tokens=False).ids, dtype=np.uint32)
                    counts[i] = len(x)
                    parts.append(x)
                else:
                    parts.append(ids[offsets[i]:offsets[i + 1]])
            ids = np.concatenate(parts)
            offsets = np.concatenate(([0], np.cumsum(counts)))
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)
