import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import fill_in_middle as M
from recordloom.llm import queries

#: Bracketed spans as units: three states, in none of which a byte sets the state alone.
NESTED = M.Automaton(tuple({ord("["): 1, ord("]"): 2, ord("x"): 3}.get(b, 0) for b in range(256)), ((0, 1, 0, 1), (1, 2, 0, 2), (2, 2, 1, 0)), ((False, True, False, True), (False, False, True, False), (True, False, False, False)))


def _walk(automaton, data, state):
    begins = []
    for i, b in enumerate(data):
        k = automaton.kinds[b]
        if automaton.starts[state][k]:
            begins.append(i)
        state = automaton.step[state][k]
    return state, begins


@pytest.mark.parametrize("seed", range(60))
def test_scan_against_a_walk(seed):
    r = random.Random(seed)
    automaton, signs = ((M.LINES, "ab\n\n"), (NESTED, "[]x.."))[seed % 2]
    parts = ["".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 30]))).encode() for _ in range(r.randrange(1, 9))]
    at = np.append(0, np.cumsum([len(p) for p in parts]))
    scan = M.Scan(automaton, np.frombuffer(b"".join(parts), np.uint8), at)
    whole, state = M.Summary(tuple(range(len(automaton.step))), (0,) * len(automaton.step)), 0
    for i, p in enumerate(parts):
        for s in range(len(automaton.step)):
            end, begins = _walk(automaton, p, s)
            assert (scan.summary(i).to[s], scan.summary(i).units[s]) == (end, len(begins))
            if begins:
                k = np.arange(len(begins))
                got = scan.begin_of(np.full(len(k), s), np.full(len(k), i), k) - at[i]
                assert got.tolist() == begins
        whole = whole.then(scan.summary(i))
    end, begins = _walk(automaton, b"".join(parts), state)
    assert (whole.to[0], whole.units[0]) == (end, len(begins))


def test_then_is_associative():
    r = random.Random(1)
    f, g, h = (M.Summary(tuple(r.randrange(3) for _ in range(3)), tuple(r.randrange(9) for _ in range(3))) for _ in range(3))
    assert f.then(g).then(h) == f.then(g.then(h))


def _want(i, t):
    t = t or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in M.MARKS):
        return (i, n, "plain", None, None, t)
    if h4 % 100 < 50:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [5, 64, M.CHUNK])
def test_documents(spark, chunk):
    r = random.Random(chunk)
    signs = ["a", "é", "漢", "🙂", "\n", "\n", "\r", " ", "<", "P>", "<P", "S", ">"]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no\nid\n"), (202, "\n"), (203, "\n\n\n"), (204, "one line"), (7, "again\n" * 9), (7, "again\n" * 9), *[(205 + k, x * (20 * chunk // len(x))) for k, x in enumerate(["long line ", "line\n", "a<M>b\n"])]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    out = M.fill_in_middle(df, chunk=chunk)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[5])
    assert sorted(map(tuple, got), key=key) == sorted((_want(i, t) for i, t in rows), key=key)
    assert out.filter(~M.restore(out["output"], out["form"]).eqNullSafe(out["text"])).count() == 0
    assert M.fill_in_middle(df.limit(0), chunk=chunk).count() == 0


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(i, "line\n" * (i % 5) + "ende é" * (i % 3)) for i in range(40)] + [(50, None), (51, "<P>\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TABLE documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duckdb.sql(queries.ORACLES["op12_fill_in_middle"]).fetchall()
    got = queries.op12_fill_in_middle(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == len(rows)
    duckdb.sql("DROP TABLE documents")


def test_bytes_of_a_slice():
    data, at = M._bytes(pa.array(["aa", "b", "", "ccc"]).slice(1, 3))
    assert bytes(data) == b"bccc" and at.tolist() == [0, 1, 1, 4]
