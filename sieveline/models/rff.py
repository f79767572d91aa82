"""RBF-kernel SVM on random Fourier features, solved to a certified gap, with sigmoid-calibrated
probabilities (M2).

The features, sqrt(2/D) cos(Wx + b) with W ~ N(0, 2 gamma) (Rahimi and Recht 2007), are drawn anew
in every pass and never stored: what is kept are the rows' few inputs. Each pass gives loss, gradient
and Gram matrix of the hinge loss with a rounded corner; the driver takes Newton steps and narrows
the corner. The slopes of the rounded loss are feasible multipliers of the SVM's dual, so each
solution carries its duality gap, and narrowing ends once that is a small share of the objective.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.models.newton import fit_many
from sieveline.session import ship_package, written

_BLOCK = 2048
#: Tasks whose sums the driver adds itself; more are added by Spark first.
_FEW_TASKS = 16


class Lift:
    """The map from inputs to Fourier features and a constant; drawn once a task."""

    def __init__(self, d: int, width: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.width = width
        self.w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, width))
        self.b = rng.uniform(0.0, 2.0 * np.pi, size=width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), self.width + 1))
        out[:, :-1] = np.sqrt(2.0 / self.width) * np.cos(x @ self.w + self.b)
        return out


def _packs(d: int):
    """Map rows (x, y, s, part) to blocks of them."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)]
            columns += [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3)]
            for at in range(0, len(columns[1]), _BLOCK):
                cells = [np.ascontiguousarray(c[at : at + _BLOCK]).tobytes() for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["x", "y", "s", "part"])

    return run


def _blocks(batch, lift: Lift, d: int, left_out: int, c: float):
    """(features, label, C x weight) of each block's rows outside part `left_out`."""
    for i in range(batch.num_rows):
        x, y, s, part = (np.frombuffer(batch.column(k)[i].as_py(), np.float64) for k in range(4))
        kept = part != left_out
        yield lift(x.reshape(-1, d)[kept]), y[kept], c * s[kept]


class Solver:
    """Hinge-loss fits over one table of blocks; labels are -1 and 1."""

    def __init__(self, blocks: DataFrame, d: int, width: int, gamma: float, seed: int, c: float):
        self.blocks, self.lift, self.size, self.c = blocks, (d, width, gamma, seed), width + 1, c
        self.tasks, self.left_out = blocks.rdd.getNumPartitions(), -1

    def _sum(self, size: int, per_block) -> np.ndarray:
        """Sum over blocks of the vectors that `per_block(features, label, cost)` gives."""
        settings, left_out, c = self.lift, self.left_out, self.c

        def run(batches):
            lift, out = Lift(*settings), np.zeros(size)
            for batch in batches:
                for block in _blocks(batch, lift, settings[0], left_out, c):
                    out += per_block(*block)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

        def added(batches):
            out = np.zeros(size)
            for batch in batches:
                for v in batch.column(0):
                    out += np.frombuffer(v.as_py(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

        parts, tasks = self.blocks.mapInArrow(run, "v binary"), self.tasks
        while tasks > _FEW_TASKS:
            tasks = -(-tasks // _FEW_TASKS)
            parts = parts.repartition(tasks).mapInArrow(added, "v binary")
        return sum((np.frombuffer(v.as_py(), np.float64) for v in parts.toArrow().column(0)), np.zeros(size))

    def _at(self, w: np.ndarray, corner: float) -> tuple[float, np.ndarray, np.ndarray, float, float]:
        """Rounded loss, gradient and Gram matrix at `w`, the objective, and its gap over the dual."""
        m = self.size
        upper = np.triu_indices(m)

        def one(z, y, cost):
            t = 1.0 - y * (z @ w)
            slope = np.clip(t / corner, 0.0, 1.0)
            alpha = cost * slope
            bent = (t > 0) & (t < corner)
            rounded = np.where(bent, t * t / (2.0 * corner), np.where(t > 0, t - corner / 2.0, 0.0))
            zb = z[bent] * np.sqrt(cost[bent] / corner)[:, None]
            return np.concatenate(
                [[cost @ rounded, cost @ np.maximum(t, 0.0), cost.sum()], alpha[y > 0] @ z[y > 0], alpha[y < 0] @ z[y < 0], (zb.T @ zb)[upper]]
            )

        got = self._sum(3 + 2 * m + len(upper[0]), one)
        loss, hinge, costs = got[:3]
        above, below = got[3 : 3 + m], got[3 + m : 3 + 2 * m]
        half = 0.5 * float(w[:-1] @ w[:-1])
        gram = np.zeros((m, m))
        gram[upper] = got[3 + 2 * m :]
        gram = gram + np.triu(gram, 1).T + np.diag(np.append(np.ones(m - 1), 0.0))
        # the intercept is free: where hardly a row lies in the corner, its step is held back
        gram[-1, -1] = max(gram[-1, -1], 1e-3 * costs)
        gradient = np.append(w[:-1], 0.0) - (above - below)
        # multipliers are feasible if they balance the labels: the heavier side is scaled down
        even = min(above[-1], below[-1])
        v = above * (even / above[-1] if above[-1] else 0.0) - below * (even / below[-1] if below[-1] else 0.0)
        dual = 2.0 * even - 0.5 * float(v[:-1] @ v[:-1])
        return loss + half, gradient, gram, hinge + half, hinge + half - dual

    def _along(self, w: np.ndarray, step: np.ndarray, corner: float) -> float:
        """The share of `step` with the least rounded loss, of powers of two; one pass for all."""
        sizes = 2.0 ** np.arange(1, -12, -1)

        def one(z, y, cost):
            t = 1.0 - y[:, None] * ((z @ w)[:, None] + (z @ step)[:, None] * sizes)
            return cost @ np.where(t >= corner, t - corner / 2.0, np.square(np.maximum(t, 0.0)) / (2.0 * corner))

        tried = w[:-1, None] + step[:-1, None] * sizes
        return float(sizes[(self._sum(len(sizes), one) + 0.5 * np.square(tried).sum(axis=0)).argmin()])

    def fit(self, left_out: int = -1, start: np.ndarray | None = None, gap: float = 1e-2, max_iter: int = 200) -> tuple[np.ndarray, float, int]:
        """(weights with the intercept last, gap as a share of the objective, passes), without the
        rows of part `left_out`."""
        self.left_out = left_out
        w = np.zeros(self.size) if start is None else start.copy()
        corner, passes, share = 2.0, 0, np.inf
        while passes < max_iter:
            loss, gradient, gram, objective, over = self._at(w, corner)
            passes += 1
            share = over / max(objective, 1e-300)
            if share <= gap:
                break
            step = -np.linalg.solve(gram, gradient)
            if float(-gradient @ step) <= min(0.05 * gap, 5e-5) * objective:  # converged for this corner
                corner /= 4.0
                continue
            w, passes = w + self._along(w, step, corner) * step, passes + 1
        return w, float(share), passes


class RffSvmModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Margin over regenerated features, probability 1 / (1 + exp(-(slope * margin + offset))), and
    the certified gap of the fit."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "one per Fourier feature, then the intercept", TypeConverters.toListFloat)
    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "offset", TypeConverters.toFloat)
    gap = Param(Params._dummy(), "gap", "duality gap as a share of the objective", TypeConverters.toFloat)

    def _transform(self, df):
        get = self.getOrDefault
        w, gamma, seed = np.array(get("weights")), get("gamma"), get("seed")
        ship_package(df.sparkSession)

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lift = None
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=float)
                    continue
                x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
                lift = lift or Lift(x.shape[1], len(w) - 1, gamma, seed)
                yield pd.Series(lift(x) @ w)

        m = F.col("__m")
        p = 1.0 / (1.0 + F.exp(-(get("slope") * m + get("offset"))))
        return (
            df.withColumn("__m", margin(vector_to_array(get("featuresCol"))))
            .withColumn("rawPrediction", array_to_vector(F.array(-m, m)))
            .withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
            .withColumn("prediction", F.when(m > 0, 1.0).otherwise(0.0))
            .drop("__m")
        )


class RffSvm(Estimator):
    """Weighted hinge loss on Fourier features; the sigmoid is fitted on out-of-fold margins."""

    C = Param(Params._dummy(), "C", "inverse regularisation", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "Fourier features", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "most passes of a fit", TypeConverters.toInt)
    gap = Param(Params._dummy(), "gap", "duality gap, as a share of the objective, that ends a fit", TypeConverters.toFloat)
    calibrationFolds = Param(Params._dummy(), "calibrationFolds", "folds for margins", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, gamma=0.1, numFeatures=512, maxIter=200, gap=1e-2, calibrationFolds=3, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(C=1.0, gamma=0.1, numFeatures=512, maxIter=200, gap=1e-2, calibrationFolds=3, seed=42)

    def _fit(self, df):
        get = self.getOrDefault
        gamma, width, seed, k = get("gamma"), get("numFeatures"), get("seed"), get("calibrationFolds")
        ship_package(df.sparkSession)
        x = vector_to_array(F.col("features"))
        # fold by the feature values: the same row lands in the same fold whenever it is recomputed
        part = F.pmod(F.xxhash64(F.lit(seed), x), F.lit(k)).cast("double")
        y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
        rows = df.select(x.alias("x"), y.alias("y"), F.col("weight").cast("double").alias("s"), part.alias("part"))
        first = rows.select(F.size("x").alias("d")).first()
        if first is None:
            raise ValueError("no rows to fit")
        d = first["d"]
        blocks = written(rows.mapInArrow(_packs(d), "x binary, y binary, s binary, part binary"), "svm-blocks")
        solver = Solver(blocks, d, width, gamma, seed, get("C"))
        stop = {"gap": get("gap"), "max_iter": get("maxIter")}
        final, share, _ = solver.fit(**stop)
        held = [solver.fit(left_out=i, start=final, **stop)[0] for i in range(k)]

        def margins(batches):
            lift = Lift(d, width, gamma, seed)
            for batch in batches:
                for i in range(batch.num_rows):
                    x, y, _, part = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in range(4))
                    z = lift(x.reshape(-1, d))
                    m = np.choose(part.astype(int), [z @ w for w in held])
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array((y > 0).astype(np.float64))], names=["m", "label"])

        found = written(blocks.mapInArrow(margins, "m double, label double"), "svm-margins")
        found = found.select(array_to_vector(F.array("m")).alias("features"), "label", F.lit(1.0).alias("weight"))
        slope, offset = fit_many(found, [1e9])[0].tolist()  # as good as no penalty
        return RffSvmModel()._set(
            featuresCol="features", gamma=gamma, seed=seed, weights=final.tolist(), slope=slope, offset=offset, gap=share
        )
