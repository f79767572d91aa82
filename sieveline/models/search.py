"""Randomised search with group-disjoint folds, its summary and out-of-fold scores."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import metrics as M
from sieveline.models import families
from sieveline.models.stages import Standardizer, fit_preprocessing
from sieveline.operators.curves import ranking_metrics
from sieveline.operators.evaluate import confusion
from sieveline.session import local_frame, scratch_path, written


@dataclass
class SearchResult:
    """`cv_results` is long (model, candidate_id, params, fold, metric, value); `scores` keeps the
    validation scores of every candidate, so out-of-fold scores need no second fit."""

    cv_results: DataFrame
    scores: DataFrame
    best: dict[str, tuple[int, dict]]
    models: dict[str, PipelineModel]

    def out_of_fold(self) -> DataFrame:
        """(model, fold, row_id, score, label) of each model's best candidate."""
        chosen = local_frame(
            self.scores.sparkSession, [(m, c) for m, (c, _) in self.best.items()], "model string, candidate_id int"
        )
        return self.scores.join(F.broadcast(chosen), ["model", "candidate_id"]).select(
            "model", "fold", families.ROW_ID, "score", "label"
        )


def _prepared(train: DataFrame, spec: C.FeatureSpec, *, keep: Sequence[str], scaled: bool, mode: str) -> PipelineModel:
    return fit_preprocessing(train, dataclasses.replace(spec, scale=scaled), keep=keep, mode=mode)


def _add_scaling(unscaled: PipelineModel, train: DataFrame, spec: C.FeatureSpec) -> PipelineModel:
    """The scaled variant shares every fitted stage with the unscaled one."""
    stages = list(unscaled.stages)
    body, assemble = stages[:-1], stages[-1]
    at = PipelineModel(stages=body).transform(train)
    return PipelineModel(stages=[*body, Standardizer(columns=list(spec.features)).fit(at), assemble])


def run_search(
    df: DataFrame,
    *,
    spec: C.FeatureSpec | None = None,
    specs: Mapping[str, families.ModelSpec] | None = None,
    fold: str = "fold",
    n_splits: int = C.N_SPLITS,
    n_iter: int = 25,
    seed: int = C.SEED,
    refit_metric: str = "f2",
    scorers: Mapping[str, M.Scorer] | None = None,
    parallelism: int = 4,
    mode: str = "exact",
    refit: bool = True,
) -> SearchResult:
    """Fit every candidate on every fold, rank by mean `refit_metric`, refit the best on all rows.

    `df` holds row_id, label, a group-disjoint `fold` column and the raw features. Preprocessing
    is fitted once per fold on its training part. Validation scores go to one table; all metrics
    of all candidates come from a single pass over it.
    """
    spark = df.sparkSession
    spec = spec or C.FeatureSpec()
    specs = dict(specs) if specs is not None else families.default_specs(seed)
    candidates = families.draw_candidates(specs, n_iter=n_iter, seed=seed)
    keep = [families.ROW_ID, families.LABEL, fold]
    path = scratch_path(spark, "search-scores")
    df = written(df.select(*keep, *spec.features), "search-input")  # read once per fold and fit

    for f in range(n_splits):
        train, held = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        plain = _prepared(train, spec, keep=keep, scaled=False, mode=mode)
        variants = {False: plain}
        if any(specs[m].scaled for m in specs):
            variants[True] = _add_scaling(plain, train, spec)
        frames = {}
        try:
            for scaled, model in variants.items():
                fit_rows, total = families.with_class_weights(model.transform(train))
                columns = [families.ROW_ID, families.LABEL, families.WEIGHT, families.FEATURES]
                frames[scaled] = (
                    fit_rows.select(*columns).persist(StorageLevel.MEMORY_AND_DISK),
                    model.transform(held).select(families.ROW_ID, families.LABEL, families.FEATURES)
                    .persist(StorageLevel.MEMORY_AND_DISK),
                    total,
                )

            def one(candidate, f=f, frames=frames):
                name, number, params = candidate
                family = specs[name]
                fit_rows, valid, total = frames[family.scaled]
                fitted = family.build(params, total).fit(fit_rows)
                scored = families.positive_score(fitted, valid)
                # one folder per fit: a retried fit replaces its own scores
                scored.select(
                    families.ROW_ID, "score", F.col(families.LABEL).cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("prediction"),
                ).write.mode("overwrite").parquet(f"{path}/fold={f}/model={name}/candidate_id={number}")

            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                list(pool.map(inheritable_thread_target(one), candidates))
        finally:
            for fit_rows, valid, _ in frames.values():
                fit_rows.unpersist()
                valid.unpersist()

    scores = spark.read.parquet(path)
    scores = scores.select(
        F.col("model").cast("string").alias("model"), F.col("candidate_id").cast("int").alias("candidate_id"),
        F.col("fold").cast("int").alias("fold"), families.ROW_ID, "score", "label", "prediction",
    )
    cv_results = candidate_metrics(scores, candidates, scorers or M.SEARCH_SCORERS)
    mean = _means(cv_results).where(F.col("metric") == refit_metric)
    top = mean.groupBy("model").agg(F.max_by("candidate_id", F.struct(F.round("value", 12), -F.col("candidate_id"))))
    params_of = {(m, i): p for m, i, p in candidates}
    best = {r[0]: (r[1], params_of[r[0], r[1]]) for r in top.collect()}  # one row per model
    models = {}
    if refit:
        for name, (_, params) in best.items():
            models[name] = fit_model(df, specs[name], params, spec=spec, mode=mode)
    return SearchResult(cv_results, scores, best, models)


def fit_model(
    df: DataFrame, family: families.ModelSpec, params: Mapping, *, spec: C.FeatureSpec | None = None, mode: str = "exact"
) -> PipelineModel:
    """Preprocessing and classifier fitted on all rows, as one saved-and-loaded model."""
    spec = spec or C.FeatureSpec()
    keep = [c for c in (families.ROW_ID, families.LABEL) if c in df.columns]
    prepare = _prepared(df, spec, keep=keep, scaled=family.scaled, mode=mode)
    ready = prepare.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, total = families.with_class_weights(ready)
        classifier = family.build(params, total).fit(rows)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*prepare.stages, classifier])


def candidate_metrics(scores: DataFrame, candidates, scorers: Mapping[str, M.Scorer]) -> DataFrame:
    """Long table of each candidate's metrics by fold, the area under precision and recall among them."""
    keys = ["model", "candidate_id", "fold"]
    counts = confusion(scores, keys=keys)
    areas = ranking_metrics(scores, keys=keys).select(*keys, F.col("average_precision").alias("pr_auc"))
    wide = counts.select(*keys, *[fn(M.Counts.named()).alias(n) for n, fn in scorers.items()]).join(areas, keys)
    names = [*scorers, "pr_auc"]
    long = wide.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    )
    table = local_frame(
        scores.sparkSession,
        [(m, i, [(k, json.dumps(v)) for k, v in p.items()]) for m, i, p in candidates],
        "model string, candidate_id int, params map<string,string>",
    )
    return long.join(F.broadcast(table), ["model", "candidate_id"]).select(
        "model", "candidate_id", "params", "fold", "metric", "value"
    )


def _means(cv_results: DataFrame) -> DataFrame:
    return cv_results.groupBy("model", "candidate_id", "metric").agg(
        F.avg("value").alias("value"), F.first("params").alias("params")
    )


def search_summary(cv_results: DataFrame, *, refit_metric: str = "f2", metrics=("recall", "precision", "f2", "pr_auc")):
    """One row per model: mean metrics of its best candidate, best model first."""
    wide = (
        _means(cv_results)
        .groupBy("model", "candidate_id")
        .agg(F.first("params").alias("params"), *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    )
    best = wide.groupBy("model").agg(
        F.max_by(F.struct("params", *metrics), F.struct(F.round(refit_metric, 12), -F.col("candidate_id"))).alias("b")
    )
    return best.select(
        "model",
        F.col(f"b.{refit_metric}").alias(f"best_score_refit_{refit_metric}"),
        *[F.col(f"b.{m}").alias(f"best_mean_test_{m}") for m in metrics],
        F.col("b.params").alias("best_params"),
    ).orderBy(F.desc(f"best_score_refit_{refit_metric}"), "model")
