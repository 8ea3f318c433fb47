"""Cuts are the best ones: equal in score to the library's unigram search, and the same however a text is divided."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from conftest import SF_SMALL
from sentiforge.llm import pieces as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = pc.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The same pieces and scores, searched by the library's own unigram mode."""
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in m.pieces:
        if p.score <= pc._BARRED:
            p.type = pb.ModelProto.SentencePiece.UNUSED
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def score(ids):
    """Sum of file scores; a run of byte pieces that is one unknown character counts once."""
    total, raw = 0, bytearray()
    low = min(s for _, s in VOCAB.ids.values())
    for i in [*ids, None]:
        if i in VOCAB.byte_of:
            raw.append(VOCAB.byte_of[i])
            continue
        total += (low - 10) * len(raw.decode())
        raw.clear()
        if i is not None:
            total += VOCAB.ids[VOCAB.pieces[i]][1]
    return total


def texts():
    rng = random.Random(1)
    atoms = ["hello", "World", " ", "  ", "the ", "ing", "é", "ü", "漢", "😀", "\n", "\t", "123", "<s>", "▁", "~", "Straße ", "a"]
    return ["", "a", " ", "   x", "Hello wörld\n x 漢"] + ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 20))) for _ in range(400)]


def test_scores_equal_the_library(library):
    for t in texts():
        norm = pc.normalise(t)
        assert norm == library.normalize(t)
        mine, theirs = VOCAB.trace(norm, len(norm)), library.encode(t)
        assert score(mine) == score(theirs), t
        assert VOCAB.decode(mine) == norm and pc.plain_text(norm) == t.replace("▁", " ")


def test_scan_gives_the_same_ids():
    rng = random.Random(7)
    for t in texts()[::4]:
        norm = pc.normalise(t * 3)
        if not norm:
            continue
        size = rng.randrange(1, 9)
        cuts = [(norm[a:a + min(size, len(norm) - a) + VOCAB.longest - 1], min(size, len(norm) - a)) for a in range(0, len(norm), size)]
        v = [np.array([0] + [pc._NEVER] * (VOCAB.longest - 1))]
        for x, n in cuts:
            v.append(pc._after(v[-1], VOCAB.transfer(x, n)))
        state, ids = 0, []
        for (x, n), before in zip(reversed(cuts), reversed(v[:-1])):
            ids = VOCAB.trace(x, n, before.tolist(), state) + ids
            state = VOCAB.entries(x, n, before.tolist())[state]
        assert state == 0 and ids == VOCAB.trace(norm, len(norm))


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((16, 16)) < 0.3, pc._NEVER, rng.integers(-10**9, 0, (16, 16))) for _ in range(3))
    assert (pc.product(pc.product(a, b), c) == pc.product(a, pc.product(b, c))).all()


def test_giants_equal_ordinary_texts(spark, monkeypatch):
    monkeypatch.setattr(pc, "BLOCK", 4)
    rows = [(i, t * 9) for i, t in enumerate(texts()[:60])] + [(100, None), (None, "x y " * 50), (7, "again " * 40), (7, "again " * 40)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, chunk string")
    plain = sorted(map(tuple, pc.digest(pc.decode_pieces(pc.encode_pieces(docs, PATH), PATH)).collect()), key=repr)
    chunked = sorted(map(tuple, pc.digest(pc.decode_pieces(pc.encode_pieces(docs, PATH, giant=30, chunk=11), PATH)).collect()), key=repr)
    assert plain == chunked and all(r[3] for r in plain) and len(plain) == len(rows)
    assert pc.encode_pieces(docs.limit(0), PATH).count() == 0


def test_query(spark):
    got = pc.op9_pieces(spark, SF_SMALL).collect()
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got[:40]:
        norm = pc.normalise(want[r["doc_id"]] or "")
        ids = VOCAB.trace(norm, len(norm))
        assert r["exact"] and r["n_tokens"] == len(ids)
        assert r["ids_hash"] == sum(i * p for p, i in enumerate(ids)) % ((1 << 31) - 1)


def test_units_and_divided_chunks_change_nothing():
    """Solving units between divisions, and rank-one matrices, give what the plain search gives."""
    import pyarrow as pa

    rng = random.Random(7)
    atoms = ["one", "two.", "3.14", "a,b", "(x)", "\n", "\t", " ", "  ", "é", "漢", "42", "--", "'s", "…", "word", "https://a.b/c?d=e", "▁"]
    all_texts = [pc.normalise(t) for t in texts()] + [
        pc.normalise("".join(rng.choice(atoms) for _ in range(rng.randrange(1, 60)))) for _ in range(200)]
    ids, off = pc._Words(PATH).encode(pa.array(all_texts, pa.large_string()))
    for t, a, z in zip(all_texts, off[:-1], off[1:]):
        assert ids[a:z].tolist() == VOCAB.trace(t, len(t)), t
    divided = 0
    for t in all_texts:
        for size in (len(t) // 2, len(t)):
            if size:
                divided += VOCAB.first_division(t, size) is not None
                assert (VOCAB.transfer(t, size) == VOCAB.full_transfer(t, size)).all(), (t, size)
    assert divided > 100


def test_decoded_texts_are_the_source_texts(spark):
    """Joined over chunks, the decoded text is the text itself (with U+2581 read as a space)."""
    rows = list(enumerate([t * 7 for t in texts()[:50]] + ["", " ", "  a  b ", "a▁b c", "x y " * 400]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"giant": 30, "chunk": 11}):
        parts = {}
        for r in pc.decode_pieces(pc.encode_pieces(docs, PATH, **more), PATH).collect():
            parts.setdefault(r["key"], []).append((r["chunk"], r["decoded"], r["same"], r["exact"]))
        for k, t in rows:
            got = sorted(parts[k])
            assert "".join(x[1] for x in got) == t.replace("▁", " ") and all(x[3] for x in got)
            assert all(x[2] for x in got) == ("▁" not in t)
