"""Whitening of embeddings by the leading components of their covariance, found by LOBPCG.

1. Entries become whole numbers, x = floor(scale * c).  Each distinct vector counts once in the fit (repeats meet in the
   partial aggregation, so a vector that many rows hold is no hot key).  The fit list is written once, as packed blocks.
2. Sums per dimension are exact.  The covariance is never built: each step asks for its product with a few columns, for which
   every task centres its rows and sends back one small block; blocks are added by dimension.
3. LOBPCG: Rayleigh-Ritz on the orthonormal basis of iterate, residual and previous direction, whose product is made anew
   from the rows in each step, so nothing drifts.  `guard` columns beyond those asked for speed it up.  It ends when the
   residuals of the components asked for, which bound the error of their eigenvalues, are below `tolerance` times the
   largest eigenvalue, or can fall no further in double precision; else, after `steps`, it is an error.
4. Each row is centred, projected and scaled where it is read.

The driver holds blocks of dimension x columns only.

Defined cases: rows whose vector is null or holds null or non-finite entries go, as do those of another length than the most
rows have (the longer on a tie); entries beyond a long are cut to its range; repeated rows give repeated results; an empty
table, no dimension or no variance gives no rows, fewer components with variance than asked for give those; a null id stays;
other columns of the input are ignored; a deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import scratch_path

BLOCK_ROWS = 4_096
#: Share of the largest eigenvalue below which there is no variance but rounding.
NOTHING = 1e-12


@dataclass
class Fit:
    """n and sums of the fit list; eigenvalues, components (dimension x k) and residual norms; trace; steps taken."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    trace: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums.astype(np.float64) / max(1, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers -> rows of k whitened figures."""
        return (x.astype(np.float64) - self.mean) @ self.components / np.sqrt(self.values)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x (array of longs) of the rows that stay."""
    vector = F.col("v")
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = 2.0**63
    whole = F.transform(vector, lambda c: F.when(c * scale >= most, F.lit(2**63 - 1)).when(c * scale <= -most, F.lit(-(2**63))).otherwise(F.floor(c * scale)))
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & sound)
    return kept.select("vec_id", whole.alias("x"))


def _of_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the commonest length, and that."""
    most = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return vectors.filter(F.size("x") == d if d else F.lit(False)), d


def _stack(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def write_fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """Each distinct vector once, as blocks of up to BLOCK_ROWS vectors: a written table with a column `block`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(0), d)
            for i in range(0, len(x), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + BLOCK_ROWS].tobytes()], pa.binary())], ["block"])

    path = scratch_path(vectors.sparkSession, "fit-list")
    vectors.select("x").distinct().mapInArrow(pack, "block binary").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _added(blocks: DataFrame, d: int, of, kind: str, width: int) -> np.ndarray:
    """Sum over all blocks of of(x), a d x width or shorter array of `kind` (long or double), added by place in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for block in b.column(0):
                part = of(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["place", "value"])

    sums = blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max([r.place for r in sums], default=-1) + 1, np.int64 if kind == "bigint" else np.float64)
    for r in sums:
        out[r.place] = r.value
    return out.reshape(-1, width)


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what `block` has beside `against` (orthonormal); columns with nothing of their own go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more, for what rounding left
        if against is not None and block.size:
            block = block - against @ (against.T @ block)
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    return u if against is None else np.linalg.qr(u - against @ (against.T @ u))[0]


def lobpcg(product, d: int, k: int, guard: int = 8, tolerance: float = 1e-13, steps: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), eigenvectors, residual norms and steps for the k largest of a symmetric operator on R^d, given as block -> its product with the block."""
    m = min(d, k + guard)
    x = _orthonormal(np.random.default_rng(seed).standard_normal((d, m)))
    basis, best, waited = x, np.inf, 0
    for step in range(1, steps + 1):
        image = product(basis)
        small = basis.T @ image
        values, c = np.linalg.eigh((small + small.T) / 2)
        values, c = values[::-1][:m], c[:, ::-1][:, :m]
        x, ax = basis @ c, image @ c
        residual = ax - x * values
        norms = np.linalg.norm(residual, axis=0)
        worst, top = norms[:k].max(initial=0), max(abs(values[0]), np.finfo(float).tiny) if len(values) else 0
        waited = 0 if worst < best / 2 else waited + 1
        best = min(best, worst)
        if worst <= tolerance * top or basis.shape[1] == d or (waited >= 5 and worst <= 1e3 * tolerance * top):
            return values[:k], x[:, :k], norms[:k], step
        x = np.linalg.qr(x)[0]
        p = _orthonormal(basis[:, m:] @ c[m:], x) if basis.shape[1] > m else None
        held = x if p is None or not p.size else np.concatenate([x, p], 1)
        w = _orthonormal(residual, held)
        basis = np.concatenate([held, w], 1)[:, :d]
    raise RuntimeError(f"residuals {norms[:k]} after {steps} steps, tolerance {tolerance * top}")


def fit(vectors: DataFrame, d: int, components: int = 4, guard: int = 8, tolerance: float = 1e-13, steps: int = 300) -> tuple[Fit, DataFrame]:
    """The fit of integer vectors of length d, and the fit list."""
    blocks = write_fit_list(vectors, d)
    total = _added(blocks, d, lambda x: np.append(x.sum(0), len(x)), "bigint", 1).ravel() if d else np.zeros(0, np.int64)
    nothing = Fit(0, np.zeros(d, np.int64), np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    if not len(total):
        return nothing, blocks
    n, sums = int(total[-1]), total[:-1]
    mean = sums.astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x.astype(np.float64) - mean
            return centred.T @ (centred @ block)

        return _added(blocks, d, of, "double", block.shape[1]) / n

    trace = float(_added(blocks, d, lambda x: ((x.astype(np.float64) - mean) ** 2).sum(0), "double", 1).sum()) / n
    if trace <= 0:
        return Fit(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0), trace, 0), blocks
    values, vectors_, residuals, taken = lobpcg(product, d, min(components, d), guard, tolerance, steps)
    some = values > NOTHING * values[0]
    return Fit(n, sums, values[some], vectors_[:, some], residuals[some], trace, taken), blocks


def identity_error(f: Fit, blocks: DataFrame) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity, from the whitened rows."""
    k, d = len(f.values), len(f.sums)
    if not k:
        return 0.0

    def of(x: np.ndarray) -> np.ndarray:
        y = np.concatenate([f.whiten(x), np.ones((len(x), 1))], 1)
        return y.T @ y

    moments = _added(blocks, d, of, "double", k + 1) / f.n
    mean = moments[:k, k]
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, tolerance: float = 1e-13) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row that stays and component."""
    vectors, d = _of_length(integer_vectors(rows, id_col, vector_col, scale))
    f, blocks = fit(vectors, d, components, tolerance=tolerance)
    error, k = identity_error(f, blocks), len(f.values)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    floats, wrapped = f.sums.astype(np.float64), f.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(1), d) if d else np.zeros((len(b), 0), np.int64)
            # Longs wrap around, which is exact when the result is a long; whether it is, doubles tell.
            deviation = ((x * np.int64(f.n) - wrapped) ** 2).sum(1)
            near = ((x.astype(np.float64) * f.n - floats) ** 2).sum(1)
            whole = pa.array(deviation, pa.int64(), mask=near >= 2.0**63)
            of = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), whole.take(pa.array(of)), pa.array(f.whiten(x).ravel())], ["vec_id", "component", "deviation", "whitened"]
            )

    out = vectors.mapInArrow(run, f"vec_id {kind}, component int, deviation bigint, whitened double")
    explained = F.get(F.lit((f.values / f.trace).tolist()) if k else F.array(F.lit(0.0)), F.col("component") - 1)
    return out.select("vec_id", "component", F.lit(f.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
