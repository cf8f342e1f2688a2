"""The codec against the library on random texts and ids, and on odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import frame

from pagewright.llm import piece_codec

MODEL = piece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encode_as_the_library(library):
    r, c = random.Random(5), piece_codec.Codec(MODEL)
    pieces = list(c.ids)
    alphabets = ["ab", "▁ \t\n x", "aeioutnrsl ", "東京大学の人 é🙂\x00", "-=*#/ ", "0123456789 .", "".join(pieces), "<s>/unk0xAF"]
    for k in range(6000):
        text = "".join(r.choices(pieces, k=r.randint(1, 6))) if k % 5 == 0 else "".join(r.choices(r.choice(alphabets), k=r.randint(0, 30)))
        assert ids(c.encode(text)) == library.encode(text, add_bos=True, add_eos=True), text


def test_decode_as_the_library(library):
    r, c = random.Random(6), piece_codec.Codec(MODEL)
    for k in range(4000):
        some = [r.randrange(262 if k % 2 else 32000) for _ in range(r.randint(0, 9))]
        some = [259, 260, r.choice((1, 2, 0)), 3 + 0xE2] * (k % 7 == 0) + some
        assert c.decode(np.array(some, "<u4").tobytes()) == library.decode(some), some


def test_memory_bounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "WORDS", 3)
    monkeypatch.setattr(piece_codec, "PAIRS", 5)
    monkeypatch.setattr(piece_codec, "PART", 7)
    c = piece_codec.Codec(MODEL)
    text = "the cat and the hat  sat on the mat; internationalisation of 東京 " * 5
    assert ids(c.encode(text)) == library.encode(text, add_bos=True, add_eos=True)
    assert c.decode(c.encode(text)) == text


def test_frames_of_odd_rows(spark, library):
    rows = [(i, t, "en", "s", 1, 7, "x", 1, None, 2) for i, t in enumerate([None, "", " ", "  two  ", "x" * 60_000, "ab cd " * 40_000, "東" * 5000, "same", "same", "a\x00b"])] + [(None, "same", None, None, None, 7, "x", 1, None, 2)]
    docs = frame(spark, rows)
    coded = piece_codec.encoded(docs, MODEL)
    out = piece_codec.decoded(coded, MODEL, keep=("doc_id", "ids")).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert ids(bytes(r.ids)) == want and r.text == library.decode(want)
    assert piece_codec.decoded(piece_codec.encoded(docs.limit(0), MODEL), MODEL).count() == 0
