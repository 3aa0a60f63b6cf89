import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import sentencepiece_codec as C

MODEL = P.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_model_fields():
    m = C.read_model(MODEL)
    assert (len(m.pieces), m.kind, m.byte_fallback, m.add_dummy_prefix, m.remove_extra_whitespaces) == (32000, C.BPE, True, True, False)
    assert [p for p, _, k in m.pieces if k == C.CONTROL] == ["<s>", "</s>"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parity_with_the_library(text):
    if "\x00" in text or any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = C.encode_texts(MODEL, [text])[0]
    assert ids == SP.encode(text) == C.tokenizer(MODEL).encode(text, add_special_tokens=False).ids
    e = C.codec(MODEL, pa.array([text]), parity=True)
    assert e.same.all() and e.back.tolist() == [C.decode_ids(MODEL, [ids])[0] == text]
    if "▁" not in text:
        assert C.decode_ids(MODEL, [ids])[0] == text


@pytest.mark.parametrize("sequence", [3, 512])
def test_whole_texts_against_both_libraries(monkeypatch, sequence):
    """Texts of one slice, by words and with literal marks, against each library on every whole text."""
    monkeypatch.setattr(C, "SEQUENCE", sequence)
    r = np.random.default_rng(3)
    pool = ["the", "a", "Straße", "日本語", "\n", "\n\n", " ", "   ", "\t", "x" * 40, "<s>", "</s>", "<0x0A>", "\U0001f600", "é", ".", "e\u0301", "▁", "▁▁b", "\r\n", "\u00a0"]
    texts = ["", None, "\n", " ", "  ", "▁", " \n ", "word"] + [" ".join(r.choice(pool[: 17 if i % 3 else len(pool)], r.integers(1, 60))) + " " * int(r.integers(0, 3)) for i in range(200)]
    e = C.codec(MODEL, pa.array(texts), parity=True)
    plain = [t or "" for t in texts]
    assert e.lists() == SP.encode(plain) == [x.ids for x in C.tokenizer(MODEL).encode_batch(plain, add_special_tokens=False)]
    assert e.same.all() and e.back.tolist() == [a == b for a, b in zip(C.decode_ids(MODEL, e.lists()), plain, strict=True)]
    assert not e.back.all() and e.back.sum() > 100


def test_a_difference_is_reported_for_its_text(monkeypatch):
    class Other:
        def encode(self, texts, num_threads=1):
            return [[7 if i == SP.piece_to_id("▁odd") else i for i in x] for x in SP.encode(texts)]

    monkeypatch.setattr(C, "_reference", lambda path: Other())
    e = C.codec(MODEL, pa.array(["all even", "an odd one", "", "odd", "odds ▁ odd", "even"]), parity=True)
    assert e.same.tolist() == [True, False, True, False, False, True]


def test_frames(spark):
    texts = [(1, "Hello  wörld\n", "x"), (2, None, "y"), (3, "", "z"), (4, "word " * 20000, "q"), (4, "word " * 20000, "q")]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    enc = C.encode(df, MODEL, parity=True)
    rows = enc.collect()
    assert len(rows) == 5 and all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in C.decode(enc, MODEL).collect()}
    assert back == {i: t or "" for i, t, _ in texts}
    assert C.encode(df.limit(0), MODEL).count() == 0


def test_unigram_rebuild():
    """A small unigram model: the best sum of scores wins and unknown characters fall back to bytes."""
    pieces = [("<unk>", 0.0, C.UNKNOWN)] + [(f"<0x{b:02X}>", -10.0, C.BYTE) for b in range(256)]
    pieces += [(C.MARK + "ab", -1.0, C.NORMAL), (C.MARK, -2.0, C.NORMAL), ("a", -2.0, C.NORMAL), ("b", -2.0, C.NORMAL), ("bc", -1.5, C.NORMAL), ("c", -4.0, C.NORMAL)]
    t = C.build(C.Model(pieces=pieces, kind=C.UNIGRAM, byte_fallback=True))
    assert t.encode("ab", add_special_tokens=False).tokens == [C.MARK + "ab"]
    assert t.encode("  abc ab ", add_special_tokens=False).tokens == [C.MARK + "ab", "c", C.MARK + "ab"]
    assert t.encode("é", add_special_tokens=False).tokens == [C.MARK, "<0xC3>", "<0xA9>"]
