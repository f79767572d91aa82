"""Metrics per model, profile and dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline import config as C
from sieveline.functions import metrics as M
from sieveline.functions.exprs import lookup
from sieveline.operators.curves import ranking_metrics
from sieveline.operators.thresholds import decide
from sieveline.session import small

def confusion(scored: DataFrame, *, keys: Sequence[str], label: str = "label", predicted: str = "prediction"):
    """tn, fp, fn, tp per key in one aggregate (A1)."""
    return scored.groupBy(*keys).agg(*M.confusion_aggs(F.col(label), F.col(predicted)))


def with_metrics(counts: DataFrame) -> DataFrame:
    c = M.Counts.named()
    return counts.select(
        "*",
        M.accuracy(c).alias("accuracy"),
        M.recall(c).alias("recall"),
        M.precision(c).alias("precision"),
        M.f2(c).alias("f2"),
    )


def confusion_table(counts: DataFrame, *, keys: Sequence[str], normalize: str | None = None) -> DataFrame:
    """Long 2x2 table; shares over all rows, the true class or the predicted class."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    long = counts.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(y).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
                    for c, (y, p) in cells.items()
                ]
            )
        ),
    )
    scope = {"all": [], "true": ["actual"], "pred": ["predicted"]}
    if normalize is None:
        return long.withColumn("share", F.col("n").cast("double"))
    if normalize not in scope:
        raise ValueError(f"normalize must be one of {sorted(scope)} or None, got {normalize!r}")
    total = F.sum("n").over(Window.partitionBy(*keys, *scope[normalize]))
    return long.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def evaluation_grid(
    scored: DataFrame,
    thresholds: DataFrame,
    *,
    combined: str | None = C.SET_AB,
    score: str = "score",
    label: str = "label",
    digits: int | None = None,
) -> DataFrame:
    """models x profiles x datasets.

    `scored` holds (model, dataset, score, label) with each row scored once per model.
    `thresholds` holds (model, profile, best_threshold). Counts of the combined set come from
    grouping sets; its PR-AUC needs the union's own ranking and is computed on it.
    """
    cut = small(
        thresholds.select(
            "model",
            F.coalesce(lookup(F.col("profile"), C.PROFILE_DISPLAY), F.col("profile")).alias("profile"),
            F.col("best_threshold").alias("threshold"),
        )
    )
    decided = scored.join(cut, "model").withColumn("prediction", decide(F.col(score), F.col("threshold")))
    base = ["model", "profile", "threshold"]
    aggs = M.confusion_aggs(F.col(label), F.col("prediction"))
    if combined:
        sets = [[F.col(c) for c in [*base, "dataset"]], [F.col(c) for c in base]]
        counts = decided.groupingSets(sets, *[F.col(c) for c in [*base, "dataset"]]).agg(
            F.grouping("dataset").alias("is_all"), *aggs
        )
        name = F.when(F.col("is_all") == 1, F.lit(combined)).otherwise(F.col("dataset"))
        counts = counts.select(*base, *M.COUNTS, name.alias("dataset"))
        ranked = scored.withColumn("dataset", F.explode(F.array("dataset", F.lit(combined))))
    else:
        counts = decided.groupBy(*base, "dataset").agg(*aggs)
        ranked = scored
    areas = ranking_metrics(ranked, keys=["model", "dataset"], score=score, label=label, digits=digits)
    table = with_metrics(counts).join(areas, ["model", "dataset"], "left")
    return table.withColumnRenamed("average_precision", "pr_auc").select(*C.COMPARISON_COLUMNS)


def comparison_table(grid: DataFrame) -> DataFrame:
    """The 12 display columns by dataset, profile and falling F2."""
    return grid.select(*C.COMPARISON_COLUMNS).orderBy("dataset", "profile", F.desc("f2"), "model")


def diagnostics(
    scored: DataFrame,
    registry: DataFrame,
    *,
    run_tag: str = "v1",
    score: str = "score",
    label: str = "label",
    positive: int = 1,
    negative: int = 0,
) -> DataFrame:
    """Accuracy to average precision per deployment and dataset, in one plan.

    `registry` holds (deploy_id, model_name, profile, threshold).
    """
    spec = small(registry)
    decided = scored.withColumnRenamed("model", "model_name").join(spec, "model_name")
    decided = decided.withColumn("prediction", decide(F.col(score), F.col("threshold"), positive, negative))
    keys = ["deploy_id", "model_name", "profile", "threshold", "dataset"]
    counts = with_metrics(confusion(decided, keys=keys, label=label))
    areas = ranking_metrics(scored, keys=["model", "dataset"], score=score, label=label)
    areas = areas.withColumnRenamed("model", "model_name")
    return (
        counts.join(areas, ["model_name", "dataset"], "left")
        .withColumns({"run_tag": F.lit(run_tag), "positive_label": F.lit(positive), "negative_label": F.lit(negative)})
        .select(*C.DIAGNOSTICS_COLUMNS)
        .orderBy("deploy_id", "dataset")
    )
