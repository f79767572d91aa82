import json
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import metrics as M
from sieveline.operators import curves, deploy, evaluate, harmonize, ordering, splits, thresholds

# fixed values: published confusion counts and the metrics printed with them
PUBLISHED = [
    # tn, fp, fn, tp, recall, precision, f2
    (693, 275, 17, 532, 0.9690, 0.6592, 0.8858),
    (30, 220, 225, 355, 0.6121, 0.6174, 0.6131),
    (723, 495, 242, 887, 0.7857, 0.6418, 0.7519),
    (828, 140, 14, 535, 0.9745, 0.7926, 0.9317),
    (122, 128, 53, 527, 0.9086, 0.8046, 0.8857),
    (249, 1, 484, 96, 0.1655, 0.9897, 0.1986),
]


def test_metrics_of_published_counts(spark):
    df = spark.createDataFrame([r[:4] for r in PUBLISHED], "tn long, fp long, fn long, tp long")
    for got, want in zip(evaluate.with_metrics(df).collect(), PUBLISHED):
        assert (round(got["recall"], 4), round(got["precision"], 4), round(got["f2"], 4)) == want[4:]
    assert tuple(a + b for a, b in zip(PUBLISHED[0][:4], PUBLISHED[1][:4])) == PUBLISHED[2][:4]


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    c = M.Counts.named()
    row = evaluate.with_metrics(df).select("*", M.recall_at_precision()(c).alias("a"), M.precision_at_recall(0.0)(c).alias("b")).first()
    assert (row["recall"], row["precision"], row["f2"], row["accuracy"], row["a"], row["b"]) == (0, 0, 0, 1, 0, 0)


def scores(spark, n=600, seed=1, digits=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), digits)
    fold = rng.integers(0, 4, n)
    rows = [("m", int(f), float(v), int(t)) for f, v, t in zip(fold, s, y)]
    return spark.createDataFrame(rows, "model string, fold int, score double, label int"), fold, s, y


def step_ap(y, s):
    out, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        rec, prec = y[hit].sum() / y.sum(), y[hit].mean()
        out, last = out + (rec - last) * prec, rec
    return out


def test_average_precision_and_auc(spark):
    df, _, s, y = scores(spark)
    row = curves.ranking_metrics(df, keys=["model"]).first()
    assert row["average_precision"] == pytest.approx(step_ap(y, s))
    vec = df.select(array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("r"), F.col("label").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="r", metricName="areaUnderROC", numBins=0)
    assert row["roc_auc"] == pytest.approx(ev.evaluate(vec))
    assert curves.ranking_metrics(df).first()["roc_auc"] == pytest.approx(row["roc_auc"])
    three = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert curves.ranking_metrics(three).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("a", 0.2, 0), ("a", 0.3, 0), ("b", 0.4, 1)], "k string, score double, label int")
    got = {r["k"]: r for r in curves.ranking_metrics(df, keys=["k"]).collect()}
    assert got["a"]["average_precision"] is None and got["a"]["roc_auc"] is None
    assert got["b"]["average_precision"] == 1.0 and got["b"]["roc_auc"] is None


def test_curve_points(spark):
    df, _, s, y = scores(spark, 100)
    roc = curves.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert (roc[0]["threshold"], roc[0]["fpr"], roc[0]["tpr"]) == (math.inf, 0.0, 0.0)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0) and len(roc) == len(set(s)) + 1
    pr = {r["threshold"]: r for r in curves.pr_points(df).collect()}
    for t, r in pr.items():
        assert r["precision"] == pytest.approx(y[s >= t].mean()) and r["prevalence"] == pytest.approx(y.mean())


def objective_at(name, y, pred):
    tp, fp, fn = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()), int((~pred & (y == 1)).sum())
    rec, prec = (tp / (tp + fn) if tp + fn else 0.0), (tp / (tp + fp) if tp + fp else 0.0)
    return {
        "best_f2": 5 * tp / (5 * tp + 4 * fn + fp) if 5 * tp + 4 * fn + fp else 0.0,
        "best_recall_constrained": rec if prec >= 0.5 else 0.0,
        "best_precision_constrained": prec if rec >= 0.5 else 0.0,
    }[name]


@pytest.mark.parametrize("grid", [100, 7, (0.2, 0.5, 0.55, 0.8)])
@pytest.mark.parametrize("digits", [2, 9])
def test_threshold_tuning_equals_interpolated_search(spark, grid, digits):
    df, fold, s, y = scores(spark, 500, seed=4, digits=digits)
    got = {r["profile"]: r for r in thresholds.tune_thresholds(df, thresholds=grid if isinstance(grid, int) else list(grid)).collect()}
    for name in ("best_f2", "best_recall_constrained", "best_precision_constrained"):
        per_fold = []
        for f in range(4):
            sf, yf = s[fold == f], y[fold == f]
            ts = np.linspace(sf.min(), sf.max(), grid) if isinstance(grid, int) else np.array(grid)
            per_fold.append((ts, np.array([objective_at(name, yf, sf >= t) for t in ts])))
        common = (
            np.linspace(min(t.min() for t, _ in per_fold), max(t.max() for t, _ in per_fold), grid)
            if isinstance(grid, int) else np.array(grid)
        )
        mean = np.mean([np.interp(common, t, v) for t, v in per_fold], axis=0)
        best = int(np.argmax(np.round(mean, 12)))
        assert got[name]["best_threshold"] == pytest.approx(common[best])
        assert got[name]["best_score"] == pytest.approx(mean[best])


def test_grid_of_unit_scores_is_in_ninetyninths(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 0), ("m", 0, 36 / 99, 1), ("m", 0, 1.0, 1)], "model string, fold int, score double, label int")
    got = {r["profile"]: r["best_threshold"] for r in thresholds.tune_thresholds(df).collect()}
    assert got["best_f2"] == pytest.approx(1 / 99)
    at = thresholds.threshold_counts(df, keys=["model", "fold"]).where("idx = 36").first()
    assert at["threshold"] == pytest.approx(36 / 99) and at["tp"] in (1, 2)


def test_constant_scores_fail(spark):
    df = spark.createDataFrame([("m", 0, 0.5, 0), ("m", 0, 0.5, 1)], "model string, fold int, score double, label int")
    with pytest.raises(Exception, match="constant scores"):
        thresholds.tune_thresholds(df).collect()


def test_decision_is_inclusive_and_labels_resolve(spark):
    df = spark.createDataFrame([(0.7,)], "p double")
    assert df.select(thresholds.decide(F.col("p"), 0.5)).first()[0] == 1
    assert df.select(thresholds.decide(F.col("p"), 0.8)).first()[0] == 0
    assert df.select(thresholds.decide(F.col("p"), 0.7)).first()[0] == 1
    assert thresholds.label_pair([0, 1]) == (1, 0) and thresholds.label_pair(["a", "b"]) == ("b", "a")
    assert thresholds.label_pair([1, 0]) == (1, 0)
    with pytest.raises(ValueError):
        thresholds.label_pair([0, 1, 2])


def test_confusion_shares(spark):
    counts = spark.createDataFrame([("m", 3, 1, 0, 0)], "model string, tn long, fp long, fn long, tp long")
    share = lambda n: {(r["actual"], r["predicted"]): r["share"] for r in evaluate.confusion_table(counts, keys=["model"], normalize=n).collect()}
    assert share("all") == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.0, (1, 1): 0.0}
    assert share("true")[1, 1] == 0.0 and share("pred")[0, 0] == 1.0 and share(None)[0, 0] == 3.0
    with pytest.raises(ValueError):
        share("rows")


def test_evaluation_to_manifest(spark):
    df, _, s, y = scores(spark)
    scored = harmonize.combine_sets({C.SET_A: df.where("fold < 2"), C.SET_B: df.where("fold >= 2")})
    tuned = thresholds.tune_thresholds(df)
    grid = evaluate.evaluation_grid(scored, tuned)
    rows = {(r["profile"], r["dataset"]): r for r in grid.collect()}
    assert len(rows) == 9
    for p in ("f2", "recall_constrained", "precision_constrained"):
        for c in M.COUNTS:
            assert rows[p, C.SET_AB][c] == rows[p, C.SET_A][c] + rows[p, C.SET_B][c]
        assert rows[p, C.SET_AB]["pr_auc"] == pytest.approx(step_ap(y, s))  # on the union, not averaged
    shown = evaluate.comparison_table(grid)
    assert shown.columns == list(C.COMPARISON_COLUMNS)
    keys = [(r["dataset"], r["profile"]) for r in shown.collect()]
    assert keys == sorted(keys)

    pick = [{"deploy_id": "d1", "model": "m", "profile": "f2"}, {"deploy_id": "d0", "model": "m", "profile": "recall_constrained"}]
    manifest = deploy.deploy_manifest(tuned, grid.where(F.col("dataset") != C.SET_B), pick)
    got = manifest.collect()
    assert [r["deploy_id"] for r in got] == ["d0", "d1"]
    assert got[1]["koi_test_f2"] == pytest.approx(rows["f2", C.SET_A]["f2"]) and got[1]["k2p_f2"] is None
    assert deploy.registry(manifest).columns == ["deploy_id", "model_name", "profile", "threshold"]
    diag = evaluate.diagnostics(scored, deploy.registry(manifest)).collect()
    assert len(diag) == 4 and diag[0]["recall"] == pytest.approx(rows["recall_constrained", C.SET_B]["recall"])
    assert deploy.metric_rows(grid, model="m", profile="f2", datasets=[C.SET_A]).count() == 1


def test_old_profile_names(spark):
    old = spark.createDataFrame([("m", "best_recall_pmin_0_5", 0.25)], "model string, profile string, best_threshold double")
    chosen = deploy.resolve_selection(old, [{"deploy_id": "d", "model": "m", "profile": "recall_constrained"}])
    assert chosen == [("d", "m", "recall_constrained", 0.25)]
    with pytest.raises(KeyError, match="best_recall_pmin_0_5"):
        deploy.resolve_selection(old, [{"deploy_id": "d", "model": "m", "profile": "f2"}])
    assert M.importance_metric(" Best_Recall_pmin_0_5 ") == "recall" and M.importance_metric("other") == "f2"


def test_importance_views(spark):
    rows = [("d", "A", f, m) for f, m in (("x", 0.1), ("y", 0.3), ("z", 0.2))]
    imp = spark.createDataFrame(rows, "deploy_id string, dataset string, feature string, importance_mean double")
    matrix = deploy.importance_matrix(imp, deploy_ids=["d", "e"], datasets=["A"], features=["z", "x", "w"])
    assert matrix.columns == ["feature", "d__A", "e__A"]
    assert [tuple(r) for r in matrix.collect()] == [("z", 0.2, None), ("x", 0.1, None), ("w", None, None)]
    assert [r["feature"] for r in deploy.feature_importance(imp, deploy_id="d", dataset="A", top_n=2).collect()] == ["y", "z"]
    assert deploy.feature_importance(imp, deploy_id="d", dataset="A", top_n=0).count() == 3
    assert deploy.feature_importance(imp, deploy_id="d", dataset="Z").count() == 0
    assert [r[0] for r in deploy.distinct_values(imp, "dataset").collect()] == ["A"]


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 5.0)], "k string, v double")
    got = {r["v"]: r["avg_rank"] for r in ordering.average_ranks(df, keys=["k"], value="v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert splits.class_weights(df) == {0: pytest.approx(4 / 6), 1: 2.0}


def test_registered_scores_need_no_python(spark, sf):
    from sieveline.plans import QUERIES

    plan = QUERIES["average_precision"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and json.dumps(plan)
