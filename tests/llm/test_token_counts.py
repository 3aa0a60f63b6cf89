import random

import public_tokenizers as P
import pytest

from recordloom.llm import token_counts as T

MODEL = P.path("piece_bpe_32k.model")


def test_pieces_prove_the_cut():
    assert T.cuts_before_space(MODEL)
    assert not T.cuts_before_space(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("seed", range(40))
def test_chunked_equals_whole(seed):
    r = random.Random(seed)
    alphabet = ["a", "b", "the", "tion", " ", " ", "  ", "\n", "é", "漢", "🙂", "▁", "\t", "<s>", "1", "."]
    text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 3000)))
    whole = T.count_whole(MODEL, [text])[0]
    assert T.count_chunked(MODEL, text, chunk=r.choice([1, 7, 64, 500]), overlap=r.choice([1, 4, 50])) == whole


def test_no_boundary_widens_to_the_whole_text():
    for text in ("x" * 5000, " " * 5000, "漢" * 3000):
        assert T.count_chunked(MODEL, text, chunk=50, overlap=2) == T.count_whole(MODEL, [text])[0]


def test_query_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z"), (4, "word " * 9000, "q")], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df, MODEL).collect()}
    n = T.count_whole(MODEL, ["word " * 9000])[0]
    assert got == {(1, 11, T.count_whole(MODEL, ["hello world"])[0], False), (2, 0, 0, False), (3, 0, 0, False), (4, 45000, n, True)}
    assert T.token_counts(df.limit(0), MODEL).count() == 0
