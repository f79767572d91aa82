"""Histogram boosting against the same growth on one machine."""

import heapq
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from sieveline.models import boosting
from sieveline.operators import trees

NAMES = ["a", "b", "c"]


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double").repartition(4)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, size=(700, 3)).astype(float)
    x[:, 2] = rng.normal(size=700)
    y = (rng.random(700) < 1 / (1 + np.exp(-(np.where(x[:, 0] > 9, 1.5, -1) + (x[:, 1] > 4) * (x[:, 2] > 0) * 2 - 0.5)))).astype(float)
    return frame(spark, x, y), x, y


def plain_boost(x, y, edges, rounds, leaves, rate, min_rows):
    """Scores after each round by best-first growth, one split at a time, on raw rows."""
    codes = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def best(rows):
            top = None
            for f in range(x.shape[1]):
                for cut in range(len(edges[f])):
                    left = codes[rows, f] <= cut
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < min_rows or min(h[a].sum(), h[b].sum()) <= 1e-3:
                        continue
                    gain = round(g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum(), 9)
                    if gain > 0 and (top is None or gain > top[0]):
                        top = (gain, a, b)
            return top

        count, queue, done = 0, [], []

        def push(rows):
            nonlocal count
            found = best(rows)
            if found is None:
                done.append(rows)
            else:
                heapq.heappush(queue, (-found[0], count, found, rows))
                count += 1

        push(np.arange(len(y)))
        while queue and len(done) + len(queue) < leaves:
            _, _, (_, a, b), _ = heapq.heappop(queue)
            push(a)
            push(b)
        for rows in [*done, *(q[3] for q in queue)]:
            score[rows] += -rate * g[rows].sum() / h[rows].sum()
        out.append(score.copy())
    return out


def scores(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()])


@pytest.mark.parametrize("rounds,leaves,min_rows", [(1, 2, 20), (3, 7, 20), (2, 40, 5), (13, 3, 20)])
def test_growth_matches_one_machine(data, rounds, leaves, min_rows):
    df, x, y = data
    model = boosting.HistBoosting(maxIter=rounds, maxLeafNodes=leaves, minRows=min_rows, learningRate=0.3, maxBins=30).fit(df)
    edges, grown = model.parts()
    assert [len(e) for e in edges[:2]] == [19, 19] and len(edges[2]) <= 29
    assert all(sum(f < 0 for f in t.feature) <= leaves for t in grown) and len(grown) == rounds
    assert np.allclose(scores(model, df), plain_boost(x, y, edges, rounds, leaves, 0.3, min_rows)[-1], atol=1e-9)


def test_training_loss_falls(data):
    df, x, y = data
    model = boosting.HistBoosting(maxIter=25, maxLeafNodes=8).fit(df)
    edges, grown = model.parts()
    codes = boosting._codes(x, edges)
    score, before = np.full(len(y), model.getOrDefault("start")), np.inf
    for t in grown:
        t.add(codes, score)
        loss = np.mean(np.logaddexp(0, score) - y * score)
        assert loss < before
        before = loss
    assert np.allclose(score, scores(model, df), atol=1e-9)


def test_models_are_saved_and_attributed(spark, data, tmp_path):
    df, x, _ = data
    model = boosting.HistBoosting(maxIter=5, maxLeafNodes=6).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = boosting.HistBoostingModel.load(str(tmp_path / "m"))
    assert np.array_equal(scores(model, df), scores(back, df))
    leaves, margin = trees.read_leaves(back, spark)
    parts = trees.tree_attribution(df.where("id < 40"), df.where("id < 20"), key="id", features=NAMES, leaves=leaves, margin=margin)
    p = 1 / (1 + np.exp(-scores(model, df)))
    sums = {r["id"]: r["s"] for r in parts.groupBy("id").agg({"shap_value": "sum"}).withColumnRenamed("sum(shap_value)", "s").collect()}
    assert np.allclose([sums[i] for i in range(40)], p[:40] - p[:20].mean(), atol=1e-9)


def test_hopeless_and_odd_inputs(spark):
    x = np.ones((60, 3))
    model = boosting.HistBoosting(maxIter=4).fit(frame(spark, x, np.arange(60) % 2))
    assert model.parts()[1] == [] and set(scores(model, frame(spark, x, np.zeros(60)))) == {0.0}
    for bad in (frame(spark, x, np.ones(60)), frame(spark, x, np.ones(60)).limit(0)):
        with pytest.raises(ValueError):
            boosting.HistBoosting().fit(bad)
    with pytest.raises(ValueError):
        boosting.HistBoosting(maxBins=300).fit(frame(spark, x, np.arange(60) % 2))
    some = frame(spark, np.arange(180).reshape(60, 3) % 7, np.arange(60) % 2)
    assert boosting.HistBoosting(maxIter=1, minRows=5).fit(some).transform(some.limit(0)).count() == 0


def test_sums_of_many_tasks_are_added_by_spark(data, monkeypatch):
    df, _, _ = data
    few = boosting.HistBoosting(maxIter=3, maxLeafNodes=9).fit(df)
    monkeypatch.setattr(boosting, "_FEW_TASKS", 0)
    assert np.allclose(scores(boosting.HistBoosting(maxIter=3, maxLeafNodes=9).fit(df), df), scores(few, df), atol=1e-12)
