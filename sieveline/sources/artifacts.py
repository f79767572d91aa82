"""Run-tagged tables, model bundles and reuse of results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import PROFILE_METRIC
from sieveline.functions.metrics import display_profile
from sieveline.operators import deploy
from sieveline.operators.importance import permutation_importance
from sieveline.operators.score import scoring_function


def read_optional(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at `path`, or an empty one with the schema where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_artifact(df: DataFrame, root: str, table: str, *, run_tag: str = "v1") -> str:
    """Replace one run's partition of an artifact table, leaving other runs alone."""
    path = f"{root}/{table}"
    df.drop("run_tag").withColumn("run_tag", F.lit(run_tag)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_tag").parquet(path)
    return path


def read_artifact(spark: SparkSession, root: str, table: str, *, run_tag: str = "v1", schema=None) -> DataFrame:
    """One run of an artifact table; partition pruning reads only its folder."""
    path = f"{root}/{table}"
    if schema is not None:
        found = read_optional(spark, path, schema)
        if "run_tag" not in found.columns:
            return spark.createDataFrame([], schema)
    else:
        found = spark.read.parquet(path)
    return found.where(F.col("run_tag") == run_tag)


#: Parameters that say where a fitted model keeps its data, not what it is.
LOCATIONS = frozenset({"indexPath"})


def facts(config, at: str = "") -> list[str]:
    """What a configuration says, one `path type=value` line per leaf, in order of the lines.

    Lists count their places; sets do not. An object that is neither is its type and `repr`.
    """
    if isinstance(config, Mapping):
        lines = [line for key in config for line in facts(config[key], f"{at}/{key}")]
        lines.append(f"{at} {len(config)} keys")
    elif isinstance(config, (list, tuple)):
        lines = [line for i, item in enumerate(config) for line in facts(item, f"{at}/{i}")]
        lines.append(f"{at} {len(config)} items")
    elif isinstance(config, (set, frozenset)):
        members = sorted(signature(item) for item in config)
        lines = [f"{at} set of {m}" for m in members]
        lines.append(f"{at} {len(members)} members")
    else:
        lines = [f"{at} {type(config).__name__}={config!r}"]
    return sorted(lines)


def signature(config) -> str:
    """SHA-256 over the facts of a configuration."""
    digest = hashlib.sha256()
    for line in facts(config):
        digest.update(f"{line}\n".encode())
    return digest.hexdigest()


def fingerprint(df: DataFrame) -> dict:
    """Identity of a table's rows, whatever their order and partitions: columns with their types, the
    number of rows, and the sum and exclusive or of two hashes of each row. Columns go by name; a null
    differs from any value, and columns that are maps are read as sorted entries."""
    cells = []
    for name, kind in sorted(df.dtypes):
        column = F.col(f"`{name}`")
        value = F.array_sort(F.map_entries(column)) if kind.startswith("map<") else column
        cells += [value, column.isNull()]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)
    row = df.agg(
        F.count("*").alias("rows"), F.sum(one.cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(two).alias("xor"), F.sum(two.cast("decimal(38,0)")).alias("sum_two"),
    ).first()
    return {"columns": sorted(df.dtypes), **{k: str(v) for k, v in row.asDict().items()}}


def model_facts(model) -> list:
    """Class and parameters of each stage of a fitted model, without uids and locations."""
    return [
        (type(stage).__name__, {p.name: v for p, v in stage.extractParamMap().items() if p.name not in LOCATIONS})
        for stage in getattr(model, "stages", [model])
    ]


def deployments_signature(deployments: Mapping[str, Mapping]) -> str:
    """Signature of what the deployments decide by.

    A deployment that brings a `score` function instead of a model must state its `version`, since
    a function cannot be compared; a `version` counts for models as well.
    """
    told = {}
    for deploy_id, spec in deployments.items():
        model, version = spec.get("model"), spec.get("version")
        if model is None and version is None:
            raise ValueError(f"deployment {deploy_id} needs a model or a version to be told apart")
        told[deploy_id] = {
            "decides": (spec["profile"], float(spec["threshold"])),
            "by": (spec["model_name"], version, None if model is None else model_facts(model)),
        }
    return signature(told)


META_SCHEMA = "name string, signature string, config string, created_at timestamp, n_rows long"


def materialize_or_reuse(
    spark: SparkSession, root: str, name: str, config, build: Callable[[], DataFrame], *, force: bool = False,
    check: bool = True,
) -> tuple[DataFrame, bool]:
    """(table, reused). Rebuild unless a table with the same configuration signature is there.

    With `check=False` any table written before is reused (S15). The table is written first and
    its metadata row last, so a build that failed half-way is never taken for a finished one.
    """
    data, meta = f"{root}/{name}/data", f"{root}/{name}/meta"
    want = signature(config)
    if not force:
        held = read_optional(spark, meta, META_SCHEMA).collect()
        if held and (not check or held[0]["signature"] == want):
            return spark.read.parquet(data), True
    built = build()
    spark.createDataFrame([], META_SCHEMA).write.mode("overwrite").parquet(meta)
    built.write.mode("overwrite").parquet(data)
    stored = spark.read.parquet(data)
    row = spark.range(1).select(
        F.lit(name).alias("name"), F.lit(want).alias("signature"),
        F.lit(json.dumps(config, sort_keys=True, default=repr)).alias("config"),
        F.current_timestamp().alias("created_at"), F.lit(stored.count()).alias("n_rows"),
    )
    row.write.mode("overwrite").parquet(meta)
    return stored, False


def importance_run(
    spark: SparkSession,
    root: str,
    sets: DataFrame,
    deployments: Mapping[str, Mapping],
    *,
    key: str,
    features,
    run_tag: str = "v1",
    n_repeats: int = 20,
    seed: int = 42,
    scorer=None,
    scoring_name: str = "f2",
    force: bool = False,
) -> tuple[DataFrame, DataFrame, bool]:
    """(importance table, its metadata row, reused) for one run tag.

    Reused if the run asks for the same as the one before: tag, metric, repeats, seed, datasets
    with their rows, and what the deployments decide by. Deployments without a `score` are scored by their `model`.
    """
    names = sets.select("dataset").distinct().toArrow().column(0).to_pylist()  # a few
    config = {
        "run_tag": run_tag,
        "metric": scoring_name if scorer is not None else json.dumps(dict(PROFILE_METRIC), sort_keys=True),
        "n_repeats": n_repeats,
        "seed": seed,
        "datasets": sorted(names),
        "rows": fingerprint(sets.select("dataset", key, "label", *features)),
        "n_deployments": len(deployments),
        "deployments": deployments_signature(deployments),
    }

    def build():
        specs = {
            d: {**s, "score": s.get("score") or scoring_function(s["model"], features)} for d, s in deployments.items()
        }
        return permutation_importance(
            sets, specs, key=key, features=features, n_repeats=n_repeats, seed=seed, scorer=scorer, scoring_name=scoring_name
        )

    name = f"permutation_importance/{run_tag}"
    table, reused = materialize_or_reuse(spark, root, name, config, build, force=force)
    meta = spark.read.schema(META_SCHEMA).parquet(f"{root}/{name}/meta")
    shape = (
        "run_tag string, metric string, n_repeats int, seed int, datasets array<string>, n_deployments int,"
        " deployments string"
    )
    asked = F.from_json("config", shape).alias("asked")
    return table, meta.select(asked, "created_at", "n_rows").select("asked.*", "created_at", "n_rows"), reused


def save_bundle(
    models: Mapping[str, PipelineModel], manifest: DataFrame, path: str, *, comparison: DataFrame | None = None
) -> str:
    """Models by name, the manifest of the deployments that use them, and, from `comparison` (model,
    profile, dataset, metrics), each deployment's metrics by dataset (S12)."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    if comparison is not None:
        chosen = manifest.select("deploy_id", "model", "profile")
        rows = comparison.join(F.broadcast(chosen), ["model", "profile"])  # a row per deployment
        rows.select("deploy_id", "dataset", *BUNDLE_METRICS).write.mode("overwrite").parquet(f"{path}/metrics")
    return path


#: Metrics of a deployment that a bundle keeps by dataset (fixed values).
BUNDLE_METRICS = ("recall", "precision", "f2", "pr_auc", "tn", "fp", "fn", "tp")
_METRIC_ROWS = "deploy_id string, dataset string, recall double, precision double, f2 double, pr_auc double, tn long, fp long, fn long, tp long"


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, dict], DataFrame]:
    """({deploy_id: model, model_name, profile, threshold, metrics by dataset}, registry table by id)."""
    registry = deploy.registry(spark.read.parquet(f"{path}/manifest"))
    rows = registry.collect()  # one row per deployment
    models = {n: PipelineModel.load(f"{path}/models/{n}") for n in {r["model_name"] for r in rows}}
    metrics: dict[str, dict] = {}
    for r in read_optional(spark, f"{path}/metrics", _METRIC_ROWS).collect():  # deployments x datasets
        metrics.setdefault(r["deploy_id"], {})[r["dataset"]] = {m: r[m] for m in BUNDLE_METRICS}
    deployed = {
        r["deploy_id"]: {
            "model": models[r["model_name"]], "model_name": r["model_name"],
            "profile": display_profile(r["profile"]), "threshold": float(r["threshold"]),
            "metrics": metrics.get(r["deploy_id"], {}),
        }
        for r in rows
    }
    return deployed, registry
