"""Codes: exact round trips, random access, order and digests against the library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentiforge.llm.encode import Encoder
from sentiforge.llm.token_codes import Codes, pack_codes, read_segments, read_texts, write_codes

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000))
def test_codes_round_trip(ids):
    c = Codes(pack_codes(np.array(ids, dtype=np.uint32)))
    assert c.all().tolist() == ids
    for i in range(0, len(ids), 37):
        assert c[i] == ids[i]


def test_random_access_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 60000, 50000).astype(np.uint32)
    c = Codes(pack_codes(ids))
    assert all(c[int(i)] == ids[i] for i in np.random.default_rng(2).integers(0, 50000, 2000))
    with pytest.raises(IndexError):
        c[50000]


PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "　", "\u0085", "a", "The", "'s",
                          "'LL", "don't", "é", "É", "ẖ", "H̱", "日本", "12", "3", "!!", "***", "<|endoftext|>",
                          "K", "İ", "ſ", "×", "😀", "_", "\x00", "​", "x" * 40])


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=6))
def test_ids_equal_the_library(path, texts):
    enc = Encoder(path)
    ids, off = enc.encode(pa.array(texts))
    for i, r in enumerate(enc.tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i]:off[i + 1]].tolist() == r.ids, texts[i]


def test_memo_overflow_changes_nothing():
    texts = ["alpha beta gamma", "beta delta", "gamma epsilon zeta eta"] * 3
    small, big = Encoder(BYTE, memo_units=3), Encoder(BYTE)
    for t in texts:
        assert small.encode(pa.array([t]))[0].tolist() == big.encode(pa.array([t]))[0].tolist()


def test_files_read_back(spark):
    rows = [(5, "five five", 1), (1, None, 2), (3, "three words here", 3), (3, "again", 4), (2, "", 5), (9, "z " * 5000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    path = write_codes(docs, BYTE, parts=3, segment_tokens=20)
    got = read_texts(read_segments(spark, path)).orderBy("start").collect()
    tok = Tokenizer.from_file(BYTE)
    texts = {}
    for k, t, _ in rows:
        texts.setdefault(k, []).append(np.array(tok.encode(t or "").ids + [0], dtype="<u4").tobytes())
    assert [r["key"] for r in got] == sorted(r[0] for r in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        assert bytes(r["ids"]) in texts[r["key"]]
        at += r["n_tokens"]
    assert {zlib.crc32(bytes(r["ids"])) for r in got} == {zlib.crc32(x) for v in texts.values() for x in v}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_texts(read_segments(spark, write_codes(docs, BYTE))).count() == 0
