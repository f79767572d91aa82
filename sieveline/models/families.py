"""The five model families with their search spaces (M1-M4, M6, M7, M9, K6, D3)."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import SEED
from sieveline.models.boosting import HistBoosting
from sieveline.models.knn import KnnClassifier
from sieveline.models.newton import NewtonLogistic
from sieveline.models.rff import RffSvm

FEATURES, LABEL, WEIGHT, ROW_ID = "features", "label", "weight", "row_id"

Sampler = Callable[[random.Random], object]


def log_uniform(low: float, high: float) -> Sampler:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def integers(low: int, high: int) -> Sampler:
    """low <= x < high."""
    return lambda rng: rng.randrange(low, high)


def one_of(*values) -> Sampler:
    return lambda rng: rng.choice(values)


@dataclass(frozen=True)
class ModelSpec:
    """How to build one family: `build(params, total weight)` gives an estimator."""

    build: Callable[[Mapping, float], object]
    space: Mapping[str, Sampler] = field(default_factory=dict)
    scaled: bool = True
    weighted: bool = True


def _logistic(p, total):
    return NewtonLogistic(
        C=float(p["C"]), featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=int(p.get("max_iter", 5000))
    )


def _rbf_svm(seed):
    def build(p, total):
        return RffSvm(
            C=float(p["C"]), gamma=float(p["gamma"]), numFeatures=int(p.get("num_features", 512)),
            maxIter=int(p.get("max_iter", 200)), seed=seed,
        )

    return build


def _knn(p, total):
    return KnnClassifier(k=int(p["n_neighbors"]), weights=p["weights"], idCol=ROW_ID, mode=p.get("mode", "exact"))


def _forest(seed):
    def build(p, total):
        depth = p["max_depth"]
        return RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=int(p["n_estimators"]),
            maxDepth=30 if depth is None else int(depth), featureSubsetStrategy="sqrt", seed=seed,
        )

    return build


def _boosting(p, total):
    return HistBoosting(
        featuresCol=FEATURES, labelCol=LABEL, learningRate=float(p["learning_rate"]),
        maxLeafNodes=int(p["max_leaf_nodes"]), maxIter=int(p.get("max_iter", 100)),
    )


def default_specs(seed: int = SEED) -> dict[str, ModelSpec]:
    """Search registry: logistic, RBF SVM, k-NN, forest, boosting (M7)."""
    return {
        "logreg": ModelSpec(_logistic, {"C": log_uniform(1e-3, 1e2)}),
        "svc_rbf": ModelSpec(_rbf_svm(seed), {"C": log_uniform(1e-2, 1e2), "gamma": log_uniform(1e-4, 1e-1)}),
        "knn": ModelSpec(
            _knn, {"n_neighbors": integers(3, 41), "weights": one_of("uniform", "distance")}, weighted=False
        ),
        "rf": ModelSpec(
            _forest(seed),
            {"n_estimators": integers(200, 800), "max_depth": one_of(None, 5, 10, 20)},
            scaled=False,
        ),
        "hgb": ModelSpec(
            _boosting,
            {"learning_rate": log_uniform(1e-3, 1e-1), "max_leaf_nodes": integers(15, 63)},
            scaled=False,
            weighted=False,
        ),
    }


def draw_candidates(specs: Mapping[str, ModelSpec], *, n_iter: int = 25, seed: int = SEED) -> list[tuple[str, int, dict]]:
    """(model, candidate id, parameters), drawn per model from the same seed (K6)."""
    out = []
    for name, spec in specs.items():
        rng = random.Random(seed)
        for i in range(n_iter):
            out.append((name, i, {k: draw(rng) for k, draw in spec.space.items()}))
    return out


def positive_score(model, frame: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of class 1, or the margin where a model has no probabilities (M9)."""
    scored = model.transform(frame)
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(out, vector_to_array(F.col(source))[1])


def with_class_weights(df: DataFrame, *, label: str = LABEL, out: str = WEIGHT) -> tuple[DataFrame, float]:
    """Balanced weights n / (2 n_c) and their total, which equals n."""
    y = F.col(label)
    row = df.agg(*[F.count_if(c).alias(n) for n, c in (("zero", y == 0), ("one", y == 1), ("other", ~y.isin(0, 1) | y.isNull()))]).first()
    if row["other"] or not row["zero"] or not row["one"]:
        raise ValueError(f"expected labels 0 and 1 alone and both, got {row.asDict()}")
    n, counts = row["zero"] + row["one"], {0: row["zero"], 1: row["one"]}
    w = F.when(F.col(label) == 1, F.lit(n / (2.0 * counts[1]))).otherwise(F.lit(n / (2.0 * counts[0])))
    return df.withColumn(out, w), float(n)


def by_name(names: Sequence[str], specs: Mapping[str, ModelSpec] | None = None) -> dict[str, ModelSpec]:
    specs = specs or default_specs()
    return {n: specs[n] for n in names}
