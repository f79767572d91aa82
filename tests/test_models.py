import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import metrics as M
from sieveline.models import families
from sieveline.models.rff import RffSvm
from sieveline.models.search import fit_model, run_search, search_summary
from sieveline.operators import deploy, evaluate, explain, importance, neighbors, score, splits, thresholds
from sieveline.sources import artifacts
from sieveline.streaming import flows

SPEC = C.FeatureSpec(features=("a", "b"), right_skewed=("a",), left_skewed=("b",), intervals={"a": (0.0, None)})


@pytest.fixture(scope="module")
def rows(spark):
    """Two informative features, grouped rows, a third positive."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.35)
        data.append((f"r{i}", f"g{i // 3}", y, float(rng.lognormal(0.6 * y, 0.5)), float(rng.normal(-0.8 * y, 1.0))))
    df = spark.createDataFrame(data, "row_id string, group_id string, label int, a double, b double")
    df = splits.with_folds(df).persist()
    df.count()
    return df


PARAMS = {
    "logreg": {"C": 1.0},
    "svc_rbf": {"C": 1.0, "gamma": 0.1, "num_features": 64, "max_iter": 20},
    "knn": {"n_neighbors": 15, "weights": "distance"},
    "rf": {"n_estimators": 15, "max_depth": 4},
    "hgb": {"learning_rate": 0.1, "max_leaf_nodes": 16, "max_iter": 8},
}


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(PARAMS))
def test_every_family_fits_saves_and_scores(spark, rows, tmp_path, name):
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    model = fit_model(train, families.default_specs()[name], PARAMS[name], spec=SPEC)
    deployed = {"d": {"model": model, "model_name": name, "profile": "f2", "threshold": 0.4}}
    manifest = spark.createDataFrame([("d", name, "f2", 0.4)], "deploy_id string, model string, profile string, threshold double")
    path = artifacts.save_bundle({name: model}, manifest, str(tmp_path / "bundle"))
    loaded, registry = artifacts.load_bundle(spark, path)
    assert registry.first()["model_name"] == name
    got = score.predict(test, deployed, deploy_id="d", key="row_id", features=SPEC.features, intervals={})
    again = score.predict(test, loaded, deploy_id="d", key="row_id", features=SPEC.features, intervals={})
    a = {r["row_id"]: r["probability_positive"] for r in got.collect()}
    b = {r["row_id"]: r["probability_positive"] for r in again.collect()}
    assert len(a) == test.count() and a == pytest.approx(b)
    assert all(0.0 <= p <= 1.0 for p in a.values())
    joined = got.join(test.select("row_id", "label"), "row_id").select(F.col("probability_positive").alias("score"), "label")
    from sieveline.operators.curves import ranking_metrics

    assert ranking_metrics(joined).first()["roc_auc"] > 0.7
    for r in got.collect():
        assert r["prediction"] == int(r["probability_positive"] >= 0.4)
        assert r["margin"] == pytest.approx(r["probability_positive"] - 0.4)
    with pytest.raises(KeyError, match="not among the deployments"):
        score.predict(test, deployed, deploy_id="x", key="row_id", features=SPEC.features)


def test_logistic_regression_solves_the_weighted_ridge_problem(spark, rows):
    """Same optimum as sum_i w_i loss_i * C + |w|^2 / 2, found here by Newton steps."""
    model = fit_model(rows, families.default_specs()["logreg"], {"C": 0.05}, spec=SPEC)
    prepared = PipelineModel(stages=model.stages[:-1]).transform(rows).select("a", "b", "label").toPandas()
    x, y = np.c_[prepared[["a", "b"]].to_numpy(), np.ones(len(prepared))], prepared["label"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = 0.05 * x.T @ (w * (p - y)) + ridge @ beta
        beta -= np.linalg.solve(0.05 * x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, grad)
    fitted = model.stages[-1]
    np.testing.assert_allclose([*fitted.coefficients, fitted.intercept], beta, rtol=1e-3, atol=1e-3)


@pytest.mark.slow
def test_fourier_svm_separates_rings(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(600):
        y = i % 2
        r, t = 1.0 + 1.5 * y + rng.normal(0, 0.1), rng.uniform(0, 2 * math.pi)
        data.append((y, 1.0, r * math.cos(t), r * math.sin(t)))
    df = spark.createDataFrame(data, "label int, weight double, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = RffSvm(C=10.0, gamma=1.0, numFeatures=128, maxIter=30).fit(df)
    out = model.transform(df)
    assert out.where(F.col("prediction") == F.col("label")).count() > 570
    assert families.positive_score(model, df).where("(score >= 0.5) = (label = 1)").count() > 570


@pytest.mark.slow
def test_search_to_deployment(spark, rows, tmp_path):
    specs = families.by_name(["logreg", "rf"])
    import dataclasses

    specs["rf"] = dataclasses.replace(specs["rf"], space={"n_estimators": families.integers(4, 8), "max_depth": families.one_of(3)})
    found = run_search(rows, spec=SPEC, specs=specs, n_iter=2, n_splits=3)
    # rows of folds 3 and 4 always train
    assert found.cv_results.count() == 2 * 2 * 3 * 4
    summary = search_summary(found.cv_results)
    assert summary.count() == 2 and summary.columns[1] == "best_score_refit_f2"
    best = {r["model"]: r["best_score_refit_f2"] for r in summary.collect()}
    assert all(0.4 < v <= 1 for v in best.values())
    tuned = thresholds.tune_thresholds(found.out_of_fold())
    assert tuned.count() == 6
    sets = rows.withColumn("dataset", F.when(F.col("fold") < 3, C.SET_A).otherwise(C.SET_B))
    scored = None
    for name, model in found.models.items():
        part = score.scoring_function(model, SPEC.features)(sets.select("dataset", "row_id", "label", "a", "b"))
        part = part.select("dataset", "label", "score", F.lit(name).alias("model"))
        scored = part if scored is None else scored.unionByName(part)
    grid = evaluate.evaluation_grid(scored, tuned)
    assert grid.count() == 2 * 3 * 3
    pick = [{"deploy_id": "deploy_f2", "model": "rf", "profile": "f2"}]
    manifest = deploy.deploy_manifest(tuned, grid, pick)
    path = artifacts.save_bundle(found.models, manifest, str(tmp_path / "b"))
    deployed, registry = artifacts.load_bundle(spark, path)
    assert list(deployed) == ["deploy_f2"] and registry.count() == 1
    assert artifacts.deployments_signature(deployed) == artifacts.deployments_signature(artifacts.load_bundle(spark, path)[0])

    spec = deployed["deploy_f2"]
    run = lambda n: artifacts.importance_run(
        spark, str(tmp_path / "art"), sets.select("dataset", "row_id", "label", "a", "b"), deployed,
        key="row_id", features=SPEC.features, n_repeats=n,
    )
    table, meta, reused = run(3)
    imp = table.collect()
    assert len(imp) == 4 and {r["scoring"] for r in imp} == {"f2"} and not reused
    row = meta.first()
    assert (row["run_tag"], row["n_repeats"], row["n_rows"]) == ("v1", 3, 4)
    assert list(row["datasets"]) == [C.SET_B, C.SET_A] and len(row["deployments"]) == 64
    assert run(3)[2] and not run(2)[2]

    told = explain.explain_deployment(
        rows.where("row_id = 'r1'"), rows, deployed, deploy_id="deploy_f2", key="row_id", features=SPEC.features,
        classes=("no", "yes"), n_samples=20, max_background=8,
    ).first()
    assert (told["deploy_id"], told["model_name"], told["profile"], told["explainer"]) == ("deploy_f2", "rf", "f2", "tree")
    assert (told["positive_label"], told["negative_label"]) == ("yes", "no") and told["prediction"] in ("yes", "no")
    with pytest.raises(KeyError, match="not among the deployments"):
        explain.explain_deployment(rows, rows, deployed, deploy_id="x", key="row_id", features=SPEC.features)
    parts = explain.explain(
        rows.where("row_id in ('r1', 'r2')"), rows, model=spec["model"], key="row_id", features=SPEC.features,
        threshold=spec["threshold"], n_samples=20, max_background=8,
    ).collect()
    assert len(parts) == 4 and {r["scale"] for r in parts} == {"probability"}
    for rid in ("r1", "r2"):
        mine = [r for r in parts if r["row_id"] == rid]
        assert sum(r["shap_value"] for r in mine) == pytest.approx(mine[0]["probability_positive"] - mine[0]["base_value"])
        assert mine[0]["feature_value_raw"] is not None


def test_linear_explanation_is_in_log_odds(spark, rows):
    model = fit_model(rows, families.default_specs()["logreg"], {"C": 1.0}, spec=SPEC)
    parts = explain.explain(
        rows.where("fold = 0"), rows, model=model, key="row_id", features=SPEC.features, threshold=0.5
    ).collect()
    by_row = {}
    for r in parts:
        by_row.setdefault(r["row_id"], []).append(r)
    for mine in by_row.values():
        margin = mine[0]["base_value"] + sum(r["shap_value"] for r in mine)
        assert 1 / (1 + math.exp(-margin)) == pytest.approx(mine[0]["probability_positive"])
        assert {r["abs_rank"] for r in mine} == {1, 2} and mine[0]["scale"] == "log_odds"


def test_draws_are_repeatable_and_in_range():
    specs = families.default_specs()
    one, two = families.draw_candidates(specs), families.draw_candidates(specs)
    assert one == two and len(one) == 125
    for name, _, p in one:
        if name == "knn":
            assert 3 <= p["n_neighbors"] <= 40
        if name == "rf":
            assert 200 <= p["n_estimators"] <= 799 and p["max_depth"] in (None, 5, 10, 20)
        if name == "hgb":
            assert 1e-3 <= p["learning_rate"] <= 1e-1 and 15 <= p["max_leaf_nodes"] <= 62
        if name == "svc_rbf":
            assert 1e-4 <= p["gamma"] <= 1e-1


@pytest.mark.parametrize("pivots,block", [(1, 4096), (6, 16), (12, 5)])
def test_neighbours_equal_brute_force(spark, pivots, block):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(4, 3)) * 5
    train = np.vstack([centers[i % 4] + rng.normal(size=3) * 0.5 for i in range(150)] + [np.ones(3)] * 80)  # a crowded point
    query = np.vstack([centers[i % 4] + rng.normal(size=3) for i in range(40)] + [np.ones(3)])
    tdf = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(train)], "t long, v array<double>, label int")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)], "q long, v array<double>")
    got = neighbors.nearest(qdf, tdf, k=7, query_id="q", train_id="t", vector="v", payload=["label"], pivots=pivots, block_rows=block)
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["neighbor_id"])
    for i, x in enumerate(query):
        d = np.round(np.sqrt(((train - x) ** 2).sum(axis=1)), 9)
        assert found[i] == [int(j) for j in np.lexsort((np.arange(len(train)), d))[:7]]
    few = neighbors.nearest(qdf, tdf.limit(3), k=7, query_id="q", train_id="t", vector="v")
    assert few.groupBy("q").count().where("count <> 3").count() == 0


def test_vote_prefers_exact_matches(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 0), (1, 2.0, 0), (2, 1.0, 1), (2, 2.0, 0)], "q long, distance double, label int")
    uniform = {r["q"]: r["score"] for r in neighbors.vote(df, query_id="q").collect()}
    weighted = {r["q"]: r["score"] for r in neighbors.vote(df, query_id="q", weights="distance").collect()}
    assert uniform == {1: pytest.approx(1 / 3), 2: 0.5} and weighted == {1: 1.0, 2: pytest.approx(2 / 3)}
    with pytest.raises(ValueError):
        neighbors.vote(df, query_id="q", weights="other")


def test_permuted_column_is_a_permutation(spark):
    df = spark.range(97).select("id", (F.col("id") * 1.5).alias("x"))
    out = importance.permute_column(df, "x", key="id", repeats=4).collect()
    orders = set()
    for r in range(4):
        got = sorted((o["id"], o["x"]) for o in out if o["repeat"] == r)
        assert [g[0] for g in got] == list(range(97)) and sorted(g[1] for g in got) == [1.5 * i for i in range(97)]
        orders.add(tuple(g[1] for g in got))
    assert len(orders) == 4
    n = importance.STEPS[0] * importance.STEPS[1]  # the first steps divide this size
    assert any(n % p for p in importance.step_order(0))


def test_permuted_values_travel_packed_and_come_from_the_known_donors(spark, monkeypatch):
    monkeypatch.setattr(importance, "GIVEN_ROWS", 32)
    monkeypatch.setattr(importance, "MET_ROWS", 10)
    rows = [(f"k{i}" if i % 9 else None, None if i % 5 == 0 else f"v{i}") for i in range(143)]
    df = spark.createDataFrame([r for r in rows if r[0]] + [(None, "alone")], "k string, v string")
    got = importance.permute_column(df, "v", key="k", repeats=3)
    # rows are not multiplied before they are shuffled
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    ids = importance.numbered_rows(df, key="k", seed=42)
    plain = importance.permuted_partners(ids, repeats=3).join(ids.select(F.col("idx").alias("donor"), F.col("v").alias("w")), "donor")
    want = sorted(map(str, plain.select("k", "repeat", F.col("w").alias("v")).collect()))
    assert got.columns == ["k", "repeat", "v"] and sorted(map(str, got.collect())) == want
    assert importance.permute_column(df.limit(0), "v", key="k", repeats=3).collect() == []
    assert importance.permute_column(df.limit(1), "v", key="k", repeats=3).count() == 3


def test_products_beyond_64_bits():
    n = 7_999_999_999_993
    a, b = 7_123_456_789_012, [0, 1, n - 1, 5_000_000_000_001]
    assert importance._times(a, np.array(b), n).tolist() == [a * x % n for x in b]


def test_importance_of_constant_and_unused_features_is_zero(spark, rows):
    sets = rows.select(F.lit("all").alias("dataset"), "row_id", "label", "a", F.lit(1.0).alias("flat"), "b")
    spec = {
        "d": {
            "model_name": "m", "profile": "precision_constrained", "threshold": 0.5,
            "score": lambda f: f.withColumn("score", F.when(F.col("a") + F.col("flat") > 2.2, 1.0).otherwise(0.0)),
        }
    }
    got = {r["feature"]: r for r in importance.permutation_importance(sets, spec, key="row_id", features=["a", "flat", "b"], n_repeats=6).collect()}
    assert got["flat"]["importance_mean"] == 0 == got["b"]["importance_mean"] and got["a"]["importance_mean"] > 0.05
    assert (got["a"]["importance_rank"], got["b"]["importance_rank"], got["flat"]["importance_rank"]) == (1, 2, 2)
    assert got["a"]["scoring"] == "precision" and got["a"]["n_repeats"] == 6
    own = importance.permutation_importance(
        sets, spec, key="row_id", features=["a", "flat"], n_repeats=2, scorer=M.accuracy, scoring_name="accuracy"
    ).first()
    assert own["scoring"] == "accuracy"
    with pytest.raises(KeyError, match="precision"):
        importance.permutation_importance(sets, spec, key="row_id", features=["a", "flat"], n_repeats=1, scorers={"f2": M.f2})


def test_block_pairs_permute_each_block_with_one_shuffle(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, "big").otherwise("small").alias("dataset"), "id", (F.col("id") % 2).alias("label"),
        (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("y"),
    )
    plain, met = importance.block_pairs(df, key="id", features=["x", "y"], label="label", n_repeats=20, block_rows=500)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(dataset") == 2  # rows, and their counts
    rows = met.collect()
    assert plain.count() == 3000 and len(rows) == 60000
    orders = set()
    for r in range(20):
        for d, ids in (("big", range(2500)), ("small", range(2500, 3000))):
            got = sorted((o["idx"], o["x"], o["__d_x"], o["__d_y"]) for o in rows if o["repeat"] == r and o["dataset"] == d)
            assert [g[0] for g in got] == list(ids) and sorted(g[2] for g in got) == [1.5 * i for i in ids]
            assert all(x == 1.5 * i and y == (str(int(dx / 1.5)) if dx / 1.5 % 3 else None) for i, x, dx, y in got)
            orders.add(tuple(g[2] for g in got))
    assert len(orders) == 40
    _, alone = importance.block_pairs(df.drop("dataset"), key="id", features=["x"], label="label", groups=(), n_repeats=2)
    assert alone.count() == 6000
    for frame in (df, df.drop("dataset")):
        groups = [c for c in ("dataset",) if c in frame.columns]
        _, none = importance.block_pairs(frame.limit(0), key="id", features=["x"], label="label", groups=groups)
        assert none.count() == 0


def brute_shapley(fn, x, background):
    d = len(x)
    phi = np.zeros(d)
    for b in background:
        for order in itertools.permutations(range(d)):
            z = np.array(b, dtype=float)
            last = fn(z)
            for f in order:
                z[f] = x[f]
                phi[f] += fn(z) - last
                last = fn(z)
    return phi / (len(background) * math.factorial(d))


def test_sampled_attribution_against_all_orders(spark):
    fn = lambda z: z[0] * z[1] + 2 * z[2] ** 2 - z[0]
    rng = np.random.default_rng(1)
    data, back = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    make = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, x double, y double, z double")
    score_fn = lambda f: f.withColumn("score", F.col("x") * F.col("y") + 2 * F.pow("z", F.lit(2.0)) - F.col("x"))
    got = explain.sampled_attribution(
        make(data), make(back), key="id", features=["x", "y", "z"], score=score_fn, n_samples=20_000
    ).collect()
    for i, row in enumerate(data):
        mine = {r["feature"]: r for r in got if r["id"] == i}
        want = brute_shapley(fn, row, back)
        np.testing.assert_allclose([mine[f]["shap_value"] for f in "xyz"], want, atol=0.12)
        base = np.mean([fn(b) for b in back])
        assert mine["x"]["base_value"] == pytest.approx(base)
        assert sum(r["shap_value"] for r in mine.values()) == pytest.approx(fn(row) - base)
        assert sorted(mine.values(), key=lambda r: r["abs_rank"]) == sorted(mine.values(), key=lambda r: -abs(r["shap_value"]))
    with pytest.raises(ValueError, match="more than 3"):
        explain.sampled_attribution(make(data), make(back), key="id", features=["x"], score=score_fn, max_background=3)


def test_sampling_equals_the_closed_form_for_linear_scores(spark):
    rng = np.random.default_rng(6)
    make = lambda n: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(n, 2)))], "id long, x double, y double")
    df, back = make(5), make(7)
    weights = {"x": 2.0, "y": -1.0}
    linear = {(r["id"], r["feature"]): r for r in explain.linear_attribution(df, back, key="id", weights=weights, intercept=0.5).collect()}
    sampled = explain.sampled_attribution(
        df, back, key="id", features=["x", "y"], n_samples=1, score=lambda f: f.withColumn("score", 2 * F.col("x") - F.col("y") + 0.5)
    ).collect()
    for r in sampled:
        want = linear[r["id"], r["feature"]]
        assert r["shap_value"] == pytest.approx(want["shap_value"]) and r["base_value"] == pytest.approx(want["base_value"])


def test_waterfall_pools_the_small_ones(spark):
    rows_ = [(1, 0.5, f"f{i}", v, r) for r, (i, v) in enumerate([(0, 5.0), (1, -3.0), (2, 2.0), (3, 1.0), (4, -0.5)], 1)]
    df = spark.createDataFrame(rows_, "id long, base_value double, feature string, shap_value double, abs_rank int")
    got = [(r["abs_rank"], r["feature"], r["shap_value"]) for r in explain.waterfall(df, key="id", max_display=3).orderBy("abs_rank").collect()]
    assert got == [(1, "f0", 5.0), (2, "f1", -3.0), (3, "3 other features", 2.5)]
    assert explain.waterfall(df, key="id", max_display=5).count() == 5


def test_artifacts_by_run_and_reuse(spark, tmp_path):
    root, schema = str(tmp_path / "art"), "model string, value double, run_tag string"
    assert artifacts.read_artifact(spark, root, "t", schema=schema).count() == 0
    one = spark.createDataFrame([("a", 1.0)], "model string, value double")
    for tag in ("v1", "v2", "v1"):
        artifacts.write_artifact(one, root, "t", run_tag=tag)
    assert artifacts.read_artifact(spark, root, "t", run_tag="v1").count() == 1
    assert spark.read.parquet(f"{root}/t").count() == 2

    calls = []

    def build():
        calls.append(1)
        return one

    config = {"run_tag": "v1", "scoring": {"mode": "x"}, "n_repeats": 20, "datasets": {"A", "B"}}
    first = artifacts.materialize_or_reuse(spark, root, "imp", config, build)
    again = artifacts.materialize_or_reuse(spark, root, "imp", {**config, "datasets": {"B", "A"}}, build)
    assert (first[1], again[1], len(calls)) == (False, True, 1)
    assert not artifacts.materialize_or_reuse(spark, root, "imp", {**config, "n_repeats": 5}, build)[1]
    assert artifacts.materialize_or_reuse(spark, root, "imp", {"other": 1}, build, check=False)[1]
    assert not artifacts.materialize_or_reuse(spark, root, "imp", {"other": 1}, build, force=True)[1]
    meta = spark.read.parquet(f"{root}/imp/meta").first()
    assert meta["n_rows"] == 1 and meta["signature"] == artifacts.signature({"other": 1})


def test_streams_equal_batch_and_survive_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i, float(i - 2), "x" if i == 4 else str(i)) for i in range(8)], "id long, a double, b string")
    df.repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    stream = flows.file_stream(spark, src, df.schema, per_trigger=1)
    args = dict(valid_path=f"{out}/ok", rejected_path=f"{out}/bad", features=["a", "b"], intervals={"a": (0.0, None)})
    flows.validate_stream(stream, checkpoint=f"{out}/c1", **args).awaitTermination()
    # a fresh checkpoint replays every batch over the same folders
    flows.validate_stream(stream, checkpoint=f"{out}/c2", **args).awaitTermination()
    ok, bad = spark.read.parquet(f"{out}/ok"), spark.read.parquet(f"{out}/bad")
    assert sorted(r["id"] for r in ok.collect()) == [2, 3, 5, 6, 7]
    assert {r["id"]: r["errors"] for r in bad.collect()} == {
        0: "a: -2 is below minimum 0", 1: "a: -1 is below minimum 0", 4: "b: expected numeric value, got 'x'",
    }
    flows.score_stream(stream, lambda s: s.select("id", (F.col("a") * 2).alias("s")), path=f"{out}/s", checkpoint=f"{out}/c3").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/s").collect())) == [(i, 2.0 * (i - 2)) for i in range(8)]
