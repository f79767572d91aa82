"""Search, tuning and evaluation that are done once for what they are asked.

A run's identity is its settings and the fingerprint of its rows, so changed rows rebuild it and
rows in another order, or dealt otherwise over partitions, do not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.models import families
from sieveline.models.search import run_search, search_summary
from sieveline.operators.evaluate import evaluation_grid
from sieveline.operators.thresholds import tune_thresholds
from sieveline.sources.artifacts import fingerprint, materialize_or_reuse


def search_run(
    spark: SparkSession,
    root: str,
    df: DataFrame,
    *,
    run_tag: str = "v1",
    spec: C.FeatureSpec | None = None,
    specs: Mapping[str, families.ModelSpec] | None = None,
    n_iter: int = 25,
    seed: int = C.SEED,
    force: bool = False,
    check: bool = True,
    **settings,
) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel], bool]:
    """(summary, out-of-fold scores, best models by name, reused) of `run_search`.

    Models and scores are written before the summary, whose record is written last, so what is
    reused is whole. With `check=False` any finished run of the tag is reused, as with `force` none.
    """
    specs = dict(specs) if specs is not None else families.default_specs(seed)
    base = f"{root}/search/{run_tag}"
    asked = {
        "rows": fingerprint(df),
        "candidates": families.draw_candidates(specs, n_iter=n_iter, seed=seed),
        "spec": spec or C.FeatureSpec(),
        "settings": settings,
    }

    def build():
        found = run_search(df, spec=spec, specs=specs, n_iter=n_iter, seed=seed, **settings)
        for name, model in found.models.items():
            model.write().overwrite().save(f"{base}/models/{name}")
        found.out_of_fold().write.mode("overwrite").parquet(f"{base}/out_of_fold")
        return search_summary(found.cv_results)

    summary, reused = materialize_or_reuse(spark, root, f"search/{run_tag}", asked, build, force=force, check=check)
    names = [r["model"] for r in summary.select("model").collect()] if settings.get("refit", True) else []
    models = {name: PipelineModel.load(f"{base}/models/{name}") for name in names}
    return summary, spark.read.parquet(f"{base}/out_of_fold"), models, reused


def tuning_run(
    spark: SparkSession,
    root: str,
    out_of_fold: DataFrame,
    *,
    run_tag: str = "v1",
    candidates: Sequence[str] | None = None,
    thresholds: int | Sequence[float] = 100,
    force: bool = False,
    check: bool = True,
) -> tuple[DataFrame, bool]:
    """(tuned thresholds, reused); `candidates` names the models to tune, None all of them."""
    scores = out_of_fold
    if candidates is not None:
        known = {r["model"] for r in out_of_fold.select("model").distinct().collect()}  # a row per model
        if absent := sorted(set(candidates) - known):
            raise ValueError(f"no scores of the models {absent}; there are {sorted(known)}")
        scores = out_of_fold.where(F.col("model").isin(list(candidates)))
    asked = {"rows": fingerprint(scores), "thresholds": thresholds}
    build = lambda: tune_thresholds(scores, thresholds=thresholds)
    return materialize_or_reuse(spark, root, f"thresholds/{run_tag}", asked, build, force=force, check=check)


def evaluation_run(
    spark: SparkSession,
    root: str,
    scored: DataFrame,
    tuned: DataFrame,
    *,
    run_tag: str = "v1",
    combined: str | None = C.SET_AB,
    force: bool = False,
    check: bool = True,
) -> tuple[DataFrame, bool]:
    """(models x profiles x datasets, reused)."""
    asked = {"rows": fingerprint(scored), "thresholds": fingerprint(tuned), "combined": combined}
    build = lambda: evaluation_grid(scored, tuned, combined=combined)
    return materialize_or_reuse(spark, root, f"evaluation/{run_tag}", asked, build, force=force, check=check)
