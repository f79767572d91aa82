"""Weighted logistic regression with an L2 penalty, by Newton's method in plain aggregates (M1).

One aggregate over the rows per step carries loss, gradient and Gram matrix; the driver solves a
system as large as the features. Steps are quadratic near the optimum, so a fit takes a handful of
passes over the rows, whatever `C`. Many values of C share the passes (`fit_many`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of one aggregate: candidates are fitted in groups of at most this many sums.
_MOST_SUMS = 400


def _linear(x: Sequence[Column], weights: np.ndarray) -> Column:
    z = F.lit(float(weights[-1]))
    for column, w in zip(x, weights):
        z = z + F.lit(float(w)) * column
    return z


def _sums(name: str, x: Sequence[Column], z: Column, y: Column, s: Column) -> list[Column]:
    """Loss, gradient and upper triangle of the Gram matrix, without the penalty."""
    p = 1.0 / (1.0 + F.exp(-z))
    r, h = s * (p - y), s * p * (1.0 - p)
    one = [*x, F.lit(1.0)]
    out = [F.sum(s * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)).alias(f"{name}_l")]
    out += [F.sum(r * c).alias(f"{name}_g{i}") for i, c in enumerate(one)]
    out += [F.sum(h * one[i] * one[j]).alias(f"{name}_h{i}_{j}") for i in range(len(one)) for j in range(i, len(one))]
    return out


class _Candidate:
    """One value of C on its way to the optimum; steps that raise the loss are halved."""

    def __init__(self, c: float, d: int):
        self.penalty = np.append(np.full(d, 1.0 / c), 0.0)
        self.at, self.step, self.loss = np.zeros(d + 1), np.zeros(d + 1), np.inf
        self.done, self.steps = False, 0

    @property
    def tried(self) -> np.ndarray:
        return self.at + self.step

    def take(self, row, name: str, c: float, tol: float) -> None:
        """Accept or halve the step that was tried, and set the next one."""
        d, w = len(self.penalty), self.tried
        loss = c * float(row[f"{name}_l"]) + 0.5 * float(c * self.penalty @ (w * w))
        self.steps += 1
        if not loss <= self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2.0
            self.done = float(np.abs(self.step).max()) <= tol
            return
        self.at, self.loss = w, loss
        g = np.array([row[f"{name}_g{i}"] for i in range(d)]) + self.penalty * w
        h = np.diag(self.penalty)
        for i in range(d):
            for j in range(i, d):
                h[i, j] += row[f"{name}_h{i}_{j}"]
                h[j, i] = h[i, j]
        self.step = -np.linalg.lstsq(h, g, rcond=1e-14)[0]
        self.done = float(np.abs(self.step).max()) <= tol * max(1.0, float(np.abs(w).max()))
        if self.done:
            self.at = self.at + self.step


def fit_many(
    df: DataFrame,
    cs: Sequence[float],
    *,
    features: str = "features",
    label: str = "label",
    weight: str = "weight",
    tol: float = 1e-8,
    max_iter: int = 5000,
) -> list[np.ndarray]:
    """For each C the minimiser of |w|^2 / 2 + C sum weight log-loss: coefficients, then intercept.

    Every pass over `df` advances all values of C that have not converged.
    """
    row = df.select(F.size(vector_to_array(features)).alias("d")).first()
    if row is None:
        raise ValueError("no rows to fit")
    d, vector = row["d"], vector_to_array(F.col(features))
    rows = df.select(vector.alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("s"))
    rows = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)], "y", "s")
    x, y, s = [F.col(f"x{i}") for i in range(d)], F.col("y"), F.col("s")
    runs = [_Candidate(float(c), d) for c in cs]
    group = max(1, _MOST_SUMS // ((d + 1) * (d + 4) // 2 + 1))
    for _ in range(max_iter):
        going = [i for i, run in enumerate(runs) if not run.done][:group]
        if not going:
            break
        exprs = [e for i in going for e in _sums(f"c{i}", x, F.col(f"z{i}"), y, s)]
        zs = [_linear(x, runs[i].tried).alias(f"z{i}") for i in going]
        found = rows.select("*", *zs).agg(*exprs).first()
        for i in going:
            runs[i].take(found, f"c{i}", float(cs[i]), tol)
    return [run.at for run in runs]


class NewtonLogisticModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Margin, probabilities and prediction as expressions over the vector's entries."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "coefficients, then the intercept", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features")

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.getOrDefault("weights")[:-1])

    @property
    def intercept(self) -> float:
        return float(self.getOrDefault("weights")[-1])

    def _transform(self, df):
        x, w = vector_to_array(self.getOrDefault("featuresCol")), np.array(self.getOrDefault("weights"))
        z = _linear([x[i] for i in range(len(w) - 1)], w)
        p = 1.0 / (1.0 + F.exp(-F.col("__z")))
        out = df.withColumn("__z", z).withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-F.col("__z"), F.col("__z"))),
                "probability": array_to_vector(F.array(1.0 - p, p)),
                "prediction": F.when(F.col("__z") > 0, 1.0).otherwise(0.0),
            }
        )
        return out.drop("__z")


class NewtonLogistic(Estimator):
    """Logistic regression for labels 0 and 1; the intercept is not penalised."""

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "most passes over the rows", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "largest entry of the last step", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=1.0, featuresCol="features", labelCol="label", weightCol="weight", maxIter=5000, tol=1e-8):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(C=1.0, featuresCol="features", labelCol="label", weightCol="weight", maxIter=5000, tol=1e-8)

    def _fit(self, df):
        get = self.getOrDefault
        found = fit_many(
            df, [get("C")], features=get("featuresCol"), label=get("labelCol"), weight=get("weightCol"),
            tol=get("tol"), max_iter=get("maxIter"),
        )
        return NewtonLogisticModel()._set(featuresCol=get("featuresCol"), weights=found[0].tolist())
