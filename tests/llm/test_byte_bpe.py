"""Ids equal tiktoken's, decoding gives back the bytes, odd rows have a defined result."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from sentiforge.llm.byte_bpe import ByteBpe, byte_bpe, decode_ids, encode_texts, model_bytes, op12_byte_bpe, read_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(coder, library, texts):
    ids, off = coder.encode(pa.array(texts, pa.string()))
    raw, ends = coder.decode(ids, off)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == library.encode_ordinary(t or ""), t
        assert raw[ends[i]:ends[i + 1]].tobytes() == (t or "").encode()


PIECES = st.one_of(
    st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "　", "\u0085", "a", "The",
                     "'s", "'LL", "don't", "é", "日本", "12", "٣", "!!", "***", "<|endoftext|>",
                     "İ", "\U0001f600", "_", "\x00", "​", "x" * 40, "▁", "ĀĠ"]),
    st.text(max_size=6))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=6))
def test_ids_equal_the_library(library, texts):
    check(byte_bpe(RANKS, PATTERN), library, texts)


def test_every_token_has_its_id(library):
    """A pre-token that is a token gets that id, whether or not merges lead to it."""
    coder = byte_bpe(RANKS, PATTERN)
    texts = []
    for t in read_ranks(RANKS):
        try:
            texts.append(t.decode())
        except UnicodeDecodeError:
            pass
    check(coder, library, texts)


def test_every_character(library):
    chars = [chr(i) for i in range(1, 0x3000)] + [chr(i) for i in range(0x3000, 0x110000, 97) if not 0xD800 <= i < 0xE000]
    check(byte_bpe(RANKS, PATTERN), library, ["".join(chars[i:i + 7]) for i in range(0, len(chars), 7)])


def test_long_texts_and_small_memo(library):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta-7", "Gamma's", "мир", "x\ny"]
    texts = ["a" * 100_000, " " * 50_000, "naïve " * 20_000, " ".join(rng.choice(words, 30_000))]
    check(byte_bpe(RANKS, PATTERN), library, texts)
    check(ByteBpe(RANKS, PATTERN, memo_units=3), library, ["alpha beta gamma", "beta delta", "alpha zeta"])


def test_model_is_a_sentencepiece_model():
    import sentencepiece
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b" ab"]
    m = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
    assert m.get_piece_size() == 261 and m.unk_id() == 260 and m.bos_id() == m.eos_id() == -1
    assert m.get_score(257) == -257


def test_table(spark, library):
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (2, None), (3, ""), (4, "z " * 40_000), (5, "\u0000日")]
    docs = spark.createDataFrame([(a, b, "x", 7) for a, b in rows], "doc_id long, text string, ids string, n_tokens int")
    got = decode_ids(encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = [(k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows]
    have = [(r["key"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decode_ids(encode_texts(none, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, 0, None)], "key long, n_tokens long, ids binary")
    assert bytes(decode_ids(nulls, RANKS, PATTERN).first()["decoded"]) == b""


def test_unknown_id_raises():
    coder = byte_bpe(RANKS, PATTERN)
    with pytest.raises(ValueError):
        coder.decode(np.array([len(coder.tokens)]), np.array([0, 1]))


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op12_byte_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
