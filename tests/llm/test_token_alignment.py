"""Alignment against a plain version that encodes whole texts with the two libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentiforge.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """Groups of a text as lists of ids, from the boundaries both have; none if bytes differ."""
    tok, sp = libraries
    if not text:
        return []
    letters = T.byte_letters()
    a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
         for i in sp.encode(text)]
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, ia, ib = [], 0, 0
    for c in cuts:
        ja, jb = ends[0].index(c, ia) + 1, ends[1].index(c, ib) + 1
        out.append(([i for i, _ in a[ia:ja]], [i for i, _ in b[ib:jb]]))
        ia, ib = ja, jb
    return out


def as_text(gs):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)


def plain(libraries, rows):
    every = [(k, plain_groups(libraries, t)) for k, t in rows]
    counts = Counter(p for _, gs in every for p in {(x, y) for a, b in gs for x in a for y in b})
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for k, gs in every:
        links = [(x, y) for a, b in gs for x in a for y in b]
        out.append((k, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
                    sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(as_text(gs).encode()).hexdigest() if gs else ""))
    return out, counts


COLS = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PIECES = st.one_of(
    st.sampled_from([" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\r", "\x0b", "\x1c", " ", " ", "　", "a", "The",
                     "'s", "don't", "é", "日本語", "12", "2024", "!!", "***", "<|endoftext|>", "<s>", "</s>", "<0x41>",
                     "\U0001f600", "_", "\x00", "▁", "Ġ", "x" * 30, "{\r", ");\r\n", "internationalization"]),
    st.text(max_size=5))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_groups_equal_whole_texts(libraries, texts):
    got = T.aligner(A, B).align(pa.array(texts))[0]
    assert [g.decode() for g in got] == [as_text(plain_groups(libraries, t)) for t in texts]


def test_coalesce():
    start, end = np.array([0, 2, 4, 0, 3, 4, 6]), np.array([2, 4, 7, 3, 4, 6, 7])
    assert T.coalesce(start, end).tolist() == [0, 0, 1, 0, 0, 1, 1]


def test_small_memo_changes_nothing(libraries):
    al = T.Aligner(A, B, memo_units=4)
    for t in ("alpha beta gamma", "beta  gamma\ndelta", "alpha alpha"):
        assert al.align(pa.array([t]))[0][0].decode() == as_text(plain_groups(libraries, t))


def table(spark, rows, **more):
    return spark.createDataFrame([(a, b, *more.values()) for a, b in rows],
                                 "doc_id long, text string" + "".join(f", {c} string" for c in more))


def test_odd_rows(spark, libraries, monkeypatch):
    rows = [(1, "the cat sat on internationalization"), (1, "the cat sat on internationalization"), (None, "the cat"), (2, None),
            (3, ""), (4, " "), (5, "▁the cat"), (6, "nbsp  here"), (7, "word " * 20_000 + "end"), (8, "日本語 텍스트 ok"),
            (9, "a" * 5000), (10, "the cat the cat"), (11, "\x00\x01 <s> {\r\n}")]
    docs = table(spark, rows, chunk="c", pairs="p", n="n").repartition(3)
    for size in (6 << 20, 40):
        monkeypatch.setattr(T, "CHUNK_BYTES", size)
        chunks = T.write_chunks(docs, A, B)
        width = T.load_pieces(B).get_piece_size()
        want, counts = plain(libraries, rows)
        got = [tuple(r[c] for c in COLS) for r in T.documents(chunks, width).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in T.pair_counts(chunks, width).collect()} == dict(counts)
    said = {r["key"]: r["groups"] for r in T.groups(docs, A, B).collect() if r["key"] != 1}
    assert said == {k: as_text(plain_groups(libraries, t)) for k, t in rows if k != 1}


def test_empty_table(spark):
    assert T.documents(T.write_chunks(table(spark, []), A, B), 32000).count() == 0


def test_query(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = T.op11_token_alignment(spark, SF_SMALL)
    assert got.columns == ["doc_id", *COLS[1:]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(libraries, docs)[0])
