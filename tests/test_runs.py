"""Runs that are reused for the same rows and settings, and bundles with metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.models import families
from sieveline.operators import deploy, splits
from sieveline.sources import artifacts, runs

SPEC = C.FeatureSpec(features=("a", "b"), right_skewed=("a",), left_skewed=("b",), intervals={"a": (0.0, None)})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(f"r{i}", f"g{i // 3}", int(y), float(rng.lognormal(0.6 * y, 0.5)), float(rng.normal(-0.8 * y))) for i, y in enumerate(rng.random(300) < 0.4)]
    return splits.with_folds(spark.createDataFrame(data, "row_id string, group_id string, label int, a double, b double")).persist()


def test_fingerprints_see_rows_and_not_their_order(spark):
    schema = "a string, b string, c array<int>, d map<string,int>"
    data = [("x", None, [1, 2], {"k": 1, "l": 2}), (None, "x", None, None), ("x", "y", [], {}), ("x", "y", [], {})]
    one = artifacts.fingerprint(spark.createDataFrame(data, schema))
    assert one == artifacts.fingerprint(spark.createDataFrame(data[::-1], schema).repartition(3).select("d", "c", "b", "a"))
    others = [data[:3], data + data[:1], data[:2] + data[2:3] * 3, [("x", None, [2, 1], {"k": 1, "l": 2}), *data[1:]], [(None, "x", *data[0][2:]), *data[1:]], []]
    prints = [str(artifacts.fingerprint(spark.createDataFrame(d, schema))) for d in others]
    assert len({str(one), *prints}) == 7
    assert artifacts.fingerprint(spark.createDataFrame([(1,)], "a int")) != artifacts.fingerprint(spark.createDataFrame([(1,)], "a long"))


def test_search_tuning_and_evaluation_are_reused(spark, rows, tmp_path):
    specs = families.by_name(["logreg"])
    root = str(tmp_path / "runs")
    search = lambda df, **how: runs.search_run(spark, root, df, spec=SPEC, specs=specs, n_iter=how.pop("n_iter", 2), n_splits=5, **how)
    summary, scores, models, reused = search(rows)
    first = [r.asDict() for r in summary.collect()]
    assert not reused and list(models) == ["logreg"] and scores.count() == 300
    again = search(rows.orderBy(F.desc("row_id")))
    assert again[3] and [r.asDict() for r in again[0].collect()] == first and again[2].keys() == models.keys()
    assert not search(rows, n_iter=1)[3]
    assert search(rows, n_iter=3, check=False)[3] and not search(rows, force=True)[3]

    scores = spark.read.parquet(f"{root}/search/v1/out_of_fold")
    tuned, reused = runs.tuning_run(spark, root, scores, candidates=["logreg"], thresholds=20)
    assert not reused and tuned.count() == 3
    assert runs.tuning_run(spark, root, scores, thresholds=20)[1] and not runs.tuning_run(spark, root, scores, thresholds=30)[1]
    with pytest.raises(ValueError, match="svc"):
        runs.tuning_run(spark, root, scores, candidates=["svc"])
    tuned = runs.tuning_run(spark, root, scores, thresholds=20)[0]  # the other settings have replaced it
    sets = scores.select("model", F.when(F.col("fold") == 0, C.SET_A).otherwise(C.SET_B).alias("dataset"), "score", "label")
    grid, reused = runs.evaluation_run(spark, root, sets, tuned)
    assert not reused and runs.evaluation_run(spark, root, sets, tuned)[1]
    assert not runs.evaluation_run(spark, root, sets.where("score > 0.2"), tuned)[1]
    grid = runs.evaluation_run(spark, root, sets, tuned)[0]
    manifest = deploy.deploy_manifest(tuned, grid, [{"deploy_id": "deploy_f2", "model": "logreg", "profile": "f2"}])
    path = artifacts.save_bundle(models, manifest, str(tmp_path / "bundle"), comparison=grid)
    deployed, _ = artifacts.load_bundle(spark, path)
    told = deployed["deploy_f2"]["metrics"]
    assert set(told) == {C.SET_A, C.SET_B, C.SET_AB}
    want = grid.where((F.col("profile") == "f2") & (F.col("dataset") == C.SET_A)).first()
    assert told[C.SET_A] == {m: want[m] for m in artifacts.BUNDLE_METRICS}
    bare = artifacts.save_bundle(models, manifest, str(tmp_path / "bare"))
    assert artifacts.load_bundle(spark, bare)[0]["deploy_f2"]["metrics"] == {}
