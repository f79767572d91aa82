"""Validated, thresholded scoring by a deployed model (V5, V6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.models.families import positive_score
from sieveline.operators.thresholds import decide, label_pair
from sieveline.operators.validate import require_valid, validate_rows


def deployment(deployments: Mapping[str, Mapping], deploy_id: str) -> Mapping:
    try:
        return deployments[deploy_id]
    except KeyError:
        raise KeyError(f"{deploy_id} is not among the deployments {sorted(deployments)}") from None


def predict(
    df: DataFrame,
    deployments: Mapping[str, Mapping],
    *,
    deploy_id: str,
    key: str,
    features: Sequence[str] = C.MODEL_FEATURES,
    intervals: Mapping[str, tuple] | None = None,
    validate: bool = True,
    classes: Sequence = (0, 1),
) -> DataFrame:
    """Probabilities of both classes and the inclusive thresholded decision per row (V5).

    With `validate`, an invalid row fails the job with its messages; screen such rows out
    first with `validate_rows` and `split_valid` where they are expected.
    """
    spec = deployment(deployments, deploy_id)
    positive, negative = label_pair(classes)
    rows = df.select(key, *features)
    if validate:
        rows = require_valid(validate_rows(rows, features=features, intervals=intervals))
    rows = rows.withColumnRenamed(key, "row_id") if key != "row_id" else rows
    scored = positive_score(_keeping(spec["model"], ["row_id"]), rows)
    s = F.col("score")
    threshold = float(spec["threshold"])
    return scored.select(
        F.col("row_id").alias(key),
        F.lit(deploy_id).alias("deploy_id"),
        F.lit(spec["model_name"]).alias("model_name"),
        F.lit(spec["profile"]).alias("profile"),
        F.lit(threshold).alias("threshold"),
        s.alias("probability_positive"),
        (1.0 - s).alias("probability_negative"),
        (s - threshold).alias("margin"),
        decide(s, threshold, positive, negative).alias("prediction"),
        F.lit(positive).alias("positive_label"),
        F.lit(negative).alias("negative_label"),
    )


def _keeping(model, keep: Sequence[str]):
    """The fitted pipeline, its selector passing on the columns in `keep`."""
    from pyspark.ml import PipelineModel

    from sieveline.models.stages import FeatureSelector

    stages = [
        FeatureSelector(columns=s.get("columns"), keep=list(keep), strict=s.get("strict"))
        if isinstance(s, FeatureSelector)
        else s
        for s in model.stages
    ]
    return PipelineModel(stages=stages)


def scoring_function(model, features: Sequence[str]):
    """Frame -> frame with a `score` column, for a fitted pipeline over raw features."""

    def score(frame: DataFrame) -> DataFrame:
        others = [c for c in frame.columns if c not in features]
        return positive_score(_keeping(model, others), frame).select(*others, "score")

    return score


def rank_candidates(scored: DataFrame, *, key: str, top: int | None = None) -> DataFrame:
    """Scored candidates, most likely first; `top` keeps the first ones (V6)."""
    ordered = scored.orderBy(F.desc("probability_positive"), key)
    return ordered.limit(top) if top else ordered
