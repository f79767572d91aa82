"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation over centred rows.

The rows X to fit stay in blocks of a table. Every step multiplies the centred rows by a vector and
their transpose by the result in one distributed pass: u = Xq, z = X'u. The left vectors u_j are long
as the table, but each is X w_j for a short w_j, so the driver keeps the w_j, their z_j = X'X w_j and
the right vectors v_j, all as long as an embedding, and left inner products are w_i . z. Both sides
are reorthogonalised in full, twice. The small bidiagonal matrix's singular value decomposition gives
components and deviations; steps end when those asked for have converged or the rank is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch

#: Steps of the whole numbers and their offset (fixed values).
SCALE, OFFSET = 64, 1_000_000
_BLOCK = 4096


@dataclass
class Whitening:
    """What `fit` found: `n` distinct rows with sums `total`, components as rows, their variances,
    the trace of the covariance, and the largest error of the whitened covariance."""

    n: int
    total: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def dims(self) -> int:
        return len(self.total)


def whole(embedding: str = "embedding"):
    """floor(64 c) + 1000000 of each entry as long; null where an entry has none."""
    scaled = lambda c: F.floor(c.cast("double") * SCALE)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**56)
    x = F.col(embedding)
    ok = x.isNotNull() & F.forall(x, lambda c: F.coalesce(fits(c), F.lit(False)))
    return F.when(ok, F.transform(x, lambda c: scaled(c).cast("long") + F.lit(OFFSET)))


def usable(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector and entries are neither null nor non-finite (nor, as 64 c,
    beyond 2^62, where no long can tell neighbours apart)."""
    return rows.select(F.col(key), whole(embedding).alias("x")).where("x is not null and size(x) > 0")


def _matrix(column) -> np.ndarray:
    """Arrow lists of one length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches):
    for batch in batches:
        x = _matrix(batch.column(0))
        for at in range(0, len(x), _BLOCK):
            part = np.ascontiguousarray(x[at : at + _BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["block"])


def _centred(block: bytes, n: int, total: np.ndarray) -> np.ndarray:
    """Rows minus the mean; n x - S is exact before it is divided."""
    x = np.frombuffer(block, np.int64).reshape(-1, len(total))
    return (n * x - total).astype(np.float64) / n


def _summed(blocks: DataFrame, size: int, per_block) -> np.ndarray:
    """Sum of `per_block(block)` (a vector of `size` doubles) over all blocks.

    A task adds up its blocks; Spark adds up the tasks, entry by entry, so the driver gets one vector.
    """

    def run(batches):
        out = np.zeros(size)
        for batch in batches:
            for block in batch.column(0):
                out += per_block(block.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["i", "v"])

    parts = blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    got = parts.toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _totals(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension. Sums are kept in two halves, so none overflows."""

    def run(batches):
        n, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_py(), np.int64).reshape(-1, dims)
                n += len(x)
                low += (x & 0xFFFF).sum(0)
                high += (x >> 16).sum(0)
        at = np.arange(dims, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(dims, n)), pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])

    parts = blocks.mapInArrow(run, "i int, n long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    rows = {r["i"]: r for r in parts.collect()}
    n = rows[0]["n"] if rows else 0
    return n, [(rows[i]["high"] << 16) + rows[i]["low"] for i in range(dims)] if rows else []


def bidiagonalise(multiply, dims: int, wanted: int, tolerance: float = 1e-14, seed: int = 7):
    """(V, singular values, steps): right singular vectors as rows, by falling singular value.

    `multiply(q)` gives X'(Xq) and the squared length of Xq. Steps go on until the `wanted` largest
    have residuals below `tolerance` of the largest, or no direction is left. Where the Krylov space
    is exhausted early (repeated singular values), it goes on with a new direction.
    """
    rng = np.random.default_rng(seed)
    vs, ws, zs = np.zeros((0, dims)), np.zeros((0, dims)), np.zeros((0, dims))
    alphas: list[float] = []
    betas: list[float] = []

    def fresh():
        """A unit vector at right angles to all right vectors, if there is one."""
        for _ in range(3):
            v = rng.standard_normal(dims)
            for _ in range(3):
                v -= vs.T @ (vs @ v)
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)
        return None

    v, beta, scale = fresh(), 0.0, 0.0
    while v is not None and len(vs) < dims:
        q = v - beta * ws[-1] if len(ws) and beta else v.copy()
        z, square = multiply(q)  # u = Xv - beta u_before, and X'u
        for _ in range(2):  # u at right angles to every u before
            c = ws @ z
            q, z = q - ws.T @ c, z - zs.T @ c
            square -= float(c @ c)
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        vs = np.vstack([vs, v])
        if alpha <= tolerance * max(scale, beta):
            alphas.append(0.0)
            ws, zs = np.vstack([ws, np.zeros(dims)]), np.vstack([zs, np.zeros(dims)])
            beta, v = 0.0, fresh()
        else:
            alphas.append(alpha)
            ws, zs = np.vstack([ws, q / alpha]), np.vstack([zs, z / alpha])
            r = zs[-1] - alpha * v  # X'u - alpha v
            for _ in range(2):  # v at right angles to every v before
                r -= vs.T @ (vs @ r)
            beta = float(np.linalg.norm(r))
            scale = max(scale, beta)
            v = r / beta if beta > tolerance * scale else None
            if v is None:
                beta, v = 0.0, fresh()
        betas.append(beta)
        small = np.diag(alphas) + np.diag(betas[:-1], 1)
        left, singular, right = np.linalg.svd(small)
        residual = np.abs(beta * left[-1, : min(wanted, len(singular))])
        if beta and len(singular) >= wanted and (residual <= tolerance * singular[0]).all():
            break
    if not alphas:
        return np.zeros((0, dims)), np.zeros(0), 0
    return right @ vs, singular, len(vs)


def fit(x: DataFrame, scratch: Scratch, components: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors of `x` (x: array of long, one length), or None without rows.

    Components are those of the covariance with divisor n; at most `components`, none whose variance
    is zero to double precision. ValueError if vectors differ in length.
    """
    lengths = x.groupBy(F.size("x").alias("d")).count().limit(2).collect()
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError("embeddings differ in length")
    dims = lengths[0]["d"]
    blocks, path = scratch.write(x.select("x").distinct().mapInArrow(_blocks, "block binary"), "blocks")
    n, total = _totals(blocks, dims)
    sums = np.array(total, np.int64)

    def products(q):
        def one(block):
            rows = _centred(block, n, sums)
            u = rows @ q
            return np.append(rows.T @ u, u @ u)

        out = _summed(blocks, dims + 1, one)
        return out[:-1], float(out[-1])

    squares = _summed(blocks, dims, lambda b: np.square(_centred(b, n, sums)).sum(0))
    trace = float(squares.sum()) / n
    right, singular, steps = bidiagonalise(products, dims, min(components, dims))
    keep = [i for i in range(min(components, len(singular))) if singular[i] > 1e-12 * singular[0] and singular[i] > 0]
    right = right[keep] / np.linalg.norm(right[keep], axis=1, keepdims=True) if keep else np.zeros((0, dims))
    variances = singular[keep] ** 2 / n
    m, error = len(keep), 0.0
    if m:
        scaled = (right / np.sqrt(variances)[:, None]).T

        def gram(block):
            y = _centred(block, n, sums) @ scaled
            return np.append((y.T @ y).ravel(), y.sum(0))

        out = _summed(blocks, m * m + m, gram)
        mean = out[m * m :] / n
        error = float(np.abs(out[: m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    scratch.drop(path)
    return Whitening(n, total, right, variances, trace, error, steps)


def whiten(x: DataFrame, found: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row of
    `x` (key, x) and component. `deviation`, the sum of (n x - S)^2, is exact; null where it
    exceeds a long."""
    n, sums, m = found.n, np.array(found.total, np.int64), len(found.variances)
    scaled = (found.components / np.sqrt(found.variances)[:, None]).T if m else np.zeros((found.dims, 0))
    explained = found.variances / found.trace if m else found.variances
    error = found.identity_error

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            shifted = n * x - sums
            most = int(np.abs(shifted).max(initial=0))
            if most * most * found.dims < 2**63:
                square = pa.array(np.square(shifted).sum(1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in shifted]
                square = pa.array([s if s < 2**63 else None for s in exact], pa.int64())
            y = (shifted.astype(np.float64) / n) @ scaled
            rows = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n, np.int64)),
                    square.take(pa.array(rows)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = x.schema[key].dataType.simpleString()
    out = x.select(F.col(key).alias("key"), "x").mapInArrow(
        run, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return out.withColumnRenamed("key", key)


def whitened(rows: DataFrame, scratch: Scratch, components: int = 16, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`fit` and `whiten` of a table's usable rows.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out; repeated
    vectors count once in the fit and each has its rows. One distinct vector has no components and
    gives no rows, nor does an empty table. Extra columns are not read.
    """
    x, _ = scratch.write(usable(rows, key, embedding), "vectors")
    found = fit(x.select("x"), scratch, components)
    if found is None:
        found = Whitening(1, [0], np.zeros((0, 1)), np.zeros(0), 0.0, 0.0, 0)
    return whiten(x, found, key)
