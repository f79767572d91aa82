"""ROC and precision-recall curves, average precision and ROC AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.exprs import ratio
from sieveline.operators.ordering import running_totals
from sieveline.operators.thresholds import known_score


def cumulative_counts(
    scored: DataFrame, *, keys: Sequence[str] = (), score: str = "score", label: str = "label",
    digits: int | None = None,
) -> DataFrame:
    """Positives and negatives at every distinct score, at or above it, and in total, over the
    rows that have a score (NaN is none).

    `digits` first rounds scores to cells, which bounds the number of points.
    """
    s = known_score(F.col(score))
    rows = scored.where(s.isNotNull())
    s = F.round(s, digits) if digits is not None else s
    rows = rows.select(*keys, s.alias(score), F.col(label).alias("__y"))
    counts = {"pos": F.count_if(F.col("__y") == 1), "neg": F.count_if(F.col("__y") == 0)}
    return running_totals(rows, keys=keys, order=score, sums=counts, descending=True)


def ranking_metrics(
    scored: DataFrame, *, keys: Sequence[str] = (), score: str = "score", label: str = "label",
    digits: int | None = None,
) -> DataFrame:
    """Average precision (step sum) and ROC AUC (ties count half) per key, from one prefix pass.

    Average precision is missing where a key has no positives, AUC where it lacks a class.
    """
    keys = list(keys)
    run = cumulative_counts(scored, keys=keys, score=score, label=label, digits=digits)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ahead = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    sums = run.groupBy(*keys).agg(
        F.sum(step).alias("step"),
        F.sum(ahead).alias("ahead"),
        F.max("all_pos").alias("p"),
        F.max("all_neg").alias("n"),
    )
    p, n = F.col("p"), F.col("n")
    return sums.select(
        *keys,
        F.when(p > 0, F.col("step") / p).alias("average_precision"),
        F.when((p > 0) & (n > 0), F.col("ahead") / (p.cast("double") * n)).alias("roc_auc"),
    )


def roc_points(scored: DataFrame, **kw) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the origin at +inf."""
    keys = list(kw.get("keys", ()))
    score = kw.get("score", "score")
    run = cumulative_counts(scored, **kw)
    points = run.select(
        *keys,
        F.col(score).alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    start = scored.select(*keys).distinct() if keys else scored.limit(1).select()
    origin = start.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_points(scored: DataFrame, **kw) -> DataFrame:
    """(threshold, precision, recall, prevalence) at every distinct score."""
    keys = list(kw.get("keys", ()))
    score = kw.get("score", "score")
    run = cumulative_counts(scored, **kw)
    return run.select(
        *keys,
        F.col(score).alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
        ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg")).alias("prevalence"),
    )
