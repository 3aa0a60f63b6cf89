import math

import numpy as np
import pytest

from recordloom.llm import queries
from recordloom.llm import whitening as W


@pytest.mark.parametrize("d", [1, 2, 5, 40, 100])
def test_lobpcg(d):
    r = np.random.default_rng(d)
    a = r.standard_normal((d, 3 * d))
    a = a @ a.T
    asked = []
    values, vectors, residuals, steps = W.lobpcg(lambda b: asked.append(b.shape[1]) or a @ b, d, min(4, d), tolerance=1e-12)
    want, of = np.linalg.eigh(a)
    k = min(4, d)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12) and np.allclose(np.abs((vectors * of[:, ::-1][:, :k]).sum(0)), 1, atol=1e-10)
    assert residuals.max() <= 1e-9 * want[-1] and max(asked) <= 3 * (k + 8) and len(asked) == steps


def test_lobpcg_repeated_and_no_eigenvalues():
    values, vectors, _, _ = W.lobpcg(lambda b: np.diag([3.0] * 6 + [1.0] * 54) @ b, 60, 4)
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert np.allclose(W.lobpcg(lambda b: 0 * b, 30, 4)[0], 0)
    with pytest.raises(RuntimeError):
        W.lobpcg(lambda b: np.diag(np.linspace(1, 1.001, 400)) @ b, 400, 4, steps=2)


def _want(rows, components=4):
    """Brute force by a dense decomposition; signs as they come."""
    kept = [(i, v) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k)) if kept else 0
    kept = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in kept if len(v) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    if n < 2 or not d:
        return [], n
    sums = [sum(col) for col in zip(*fit)]
    x = np.array(fit, float)
    centred = x - x.mean(0)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = []
    for i, row in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        for k in range(len(e)):
            if e[k] > 1e-12 * e[0]:
                out.append((i, k + 1, n, deviation if deviation < 2**63 else None, float((np.array(row, float) - x.mean(0)) @ q[:, k] / np.sqrt(e[k])), e[k] / np.trace(v)))
    return out, n


def _compare(spark, rows, schema="vec_id long, embedding array<float>, component string, x int"):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], schema).repartition(3)
    got = W.whiten(df).collect()
    want, _ = _want(rows)
    assert len(got) == len(want)
    key = lambda x: (x[1], x[0] is not None, x[0] or 0, abs(round(x[4], 5)))
    g, w = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [x[:4] for x in g] == [x[:4] for x in w]
    for c in {x[1] for x in w}:
        a, b = np.array([x[4] for x in g if x[1] == c]), np.array([x[4] for x in w if x[1] == c])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)
    assert all(abs(x[5] - y[5]) <= 1e-9 * y[5] for x, y in zip(g, w)) and all(x[6] < 1e-9 for x in g)
    return g


def test_rows(spark):
    r = np.random.default_rng(2)
    spread = np.linspace(1, 0.2, 20)
    rows = [(i, np.float32(r.standard_normal(20) * spread).tolist()) for i in range(300)]
    bad = [(400, None), (401, [None] * 20), (402, [float("nan")] * 20), (403, [1.0] * 19 + [float("inf")]), (404, [1.0, 2.0]), (405, [])]
    _compare(spark, rows + bad + [(k, rows[0][1]) for k in range(500, 900)] + [(None, rows[1][1]), (7, rows[2][1])])


def test_few_dimensions_and_little_variance(spark):
    r = np.random.default_rng(3)
    _compare(spark, [(i, [float(x)]) for i, x in enumerate(r.standard_normal(20))])
    flat = [(i, [float(a), float(b), 2.0, float(a)]) for i, (a, b) in enumerate(r.integers(-5, 9, (40, 2)))]
    assert {x[1] for x in _compare(spark, flat)} == {1, 2}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]):
        assert _compare(spark, rows) == []


def test_large_entries(spark):
    rows = [(i, [1e9 * (i % 7), 3e8 * (i % 5) + 1, 2.0 * i]) for i in range(30)]
    assert any(x[3] is None for x in _compare(spark, rows, "vec_id long, embedding array<double>, component string, x int"))
    spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>").createOrReplaceTempView("huge")
    assert sorted(x.x[0] for x in W.integer_vectors(spark.table("huge")).collect()) == [-(2**63), 2**63 - 1]


def test_query(spark, tmp_path):
    rows = [(i, [math.sin(i * j + i) for j in range(6)]) for i in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op13_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 200
