import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from recordloom.llm import queries, token_files, token_ids
from recordloom.llm.wavelet import Wavelet, build

WORDS = P.path("word_bpe_49k.json")
SIGNS = "a|B|é|É|Ÿ|ß|ẞ|'s|'|'T|re|don't|<||<|endoftext|>|<|startoftext|>|<|x| |  |\n|\t|\x0b|\x1c|\x85|\xa0|　|漢字|🙂|é|́|İ|Σ|1|٣|½|²|ª|º|µ|×|÷|À|ÿ|_|-|...|%|\x00|\x7f|​|ﬁ|Å|K|the|ing".split("|")


@pytest.mark.parametrize("seed", range(6))
def test_wavelet(seed):
    r = np.random.default_rng(seed)
    ids = [r.integers(0, 49_408, 3_000), r.zipf(1.5, 5_000) % 1_000, np.zeros(70), r.integers(0, 2, 64), np.array([]), np.array([65_535])][seed].astype(np.uint16 if seed < 3 else np.uint32)
    w = Wavelet(build(ids, block=512))
    assert w.ids().dtype == ids.dtype and np.array_equal(w.ids(), ids) and len(w) == len(ids)
    for i in r.integers(0, len(ids), 40) if len(ids) else ():
        c = int(ids[i])
        at = np.flatnonzero(ids == c)
        assert w.access(int(i)) == c and w.rank(c, int(i)) == (ids[:i] == c).sum() and w.count(c) == len(at)
        k = int(r.integers(0, len(at)))
        assert w.select(c, k) == at[k] and np.array_equal(w.occurrences(c), at) and w.count(c, k, len(ids)) == (ids[k:] == c).sum()
    assert w.count(70_000) == 0 and len(w.occurrences(70_000)) == 0
    for wrong in (lambda: w.access(len(ids)), lambda: w.select(70_000, 0), lambda: w.rank(1, len(ids) + 1)):
        with pytest.raises(IndexError):
            wrong()
    with pytest.raises(ValueError):
        Wavelet(b"x" * 100)


@pytest.mark.parametrize("seed", range(60))
def test_pieces_equal_the_library(seed):
    r = random.Random(seed)
    assert token_ids.by_pieces(WORDS) and not token_ids.by_pieces(P.path("byte_bpe_50k.json"))
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(0, 50))) for _ in range(30)] + [None, ""]
    for path in (WORDS, P.path("byte_bpe_50k.json")) if seed < 5 else (WORDS,):
        ids, at = token_ids.ids_of(path, pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [token_ids.tokenizer(path).encode(x or "", add_special_tokens=False).ids for x in texts]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(token_ids, "MEMORY", 20)
    r = random.Random(9)
    for _ in range(5):
        texts = [" ".join("".join(r.choice("abc'é1") for _ in range(4)) for _ in range(30)) for _ in range(5)]
        ids, at = token_ids.ids_of(WORDS, pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [token_ids.tokenizer(WORDS).encode(x, add_special_tokens=False).ids for x in texts]


def _want(rows):
    """Brute force; equal ids in any order, so each row with its place among rows of smaller ids left out."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*token_ids.tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("tokens", "part"), [(7, 60), (50, 1_000), (4_000_000, 8_000_000)])
def test_files(spark, tmp_path, tokens, part):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["one", "Two", "drei", "été", "x1"]) for _ in range(r.randrange(0, 30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "long " * 3_000), (None, "of no id"), (-5, "smallest")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, part string, ids int").repartition(3)
    folder = str(tmp_path / "files")
    token_files.write_token_files(df, WORDS, folder, 2, shard_tokens=tokens, part_bytes=part)
    got = token_files.documents(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == _want(rows)
    files = token_files.open_files(spark, folder).collect()
    assert max(f.n for f in files) <= tokens and len(files) == spark.read.parquet(folder).inputFiles().__len__()
    flat = [k for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)) for k in [*token_ids.tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids, 2]]
    two = token_ids.tokenizer(WORDS).encode("two").ids[0]
    assert sum(x.hits for x in token_files.count_token(spark, folder, two).collect()) == flat.count(two)
    found = token_files.occurrences(spark, folder, two).collect()
    assert sorted(x.place for x in found) == [i for i, k in enumerate(flat) if k == two]
    at = {w[0]: w for w in _want(rows)}
    assert all(at[x.doc_id][1] <= x.place < at[x.doc_id][1] + at[x.doc_id][2] for x in found)
    assert [x.token for x in token_files.tokens_at(spark, folder, 40, 75).orderBy("place").collect()] == flat[40:75]


def test_repeated_rows_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "same text")] * 500 + [(1, "another")] * 3 + [(0, "first")], "doc_id long, text string").repartition(5)
    token_files.write_token_files(df, WORDS, str(tmp_path / "a"), 2, part_bytes=500)
    got = sorted(token_files.documents(spark, str(tmp_path / "a")).collect(), key=lambda x: x.start)
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:i]) for i in range(len(got))] and got[0].doc_id == 0
    assert sorted(x.ids_crc32 for x in got) == sorted(w[3] for w in _want([(1, "same text")] * 500 + [(1, "another")] * 3 + [(0, "first")]))
    assert token_files.open_files(spark, str(tmp_path / "a")).select("part").distinct().count() > 3
    token_files.write_token_files(df.limit(0), WORDS, str(tmp_path / "b"), 2)
    assert token_files.documents(spark, str(tmp_path / "b")).count() == 0


def test_query(spark, tmp_path):
    rows = [(3, "a b"), (1, None), (2, "C")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_token_files(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == _want(rows)
