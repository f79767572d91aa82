"""Logistic regression by Newton steps against first-order conditions and MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sieveline.models import families, newton


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.5, -0.4, 3.0] + 2)))).astype(float)
    s = np.where(y == 1, 0.8, 1.3)
    rows = [(*map(float, r), float(b), float(w)) for r, b, w in zip(x, y, s)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, weight double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache(), x, y, s


def gradient(w, x, y, s, c):
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    return np.append(w[:-1] + c * x.T @ (s * (p - y)), c * np.sum(s * (p - y)))


@pytest.mark.parametrize("c", [1e-3, 1.0, 100.0])
def test_the_gradient_vanishes_and_mllib_agrees(data, c):
    df, x, y, s = data
    model = newton.NewtonLogistic(C=c).fit(df)
    w = np.append(model.coefficients, model.intercept)
    assert np.abs(gradient(w, x, y, s, c)).max() < 1e-6 * max(1.0, c)
    other = LogisticRegression(weightCol="weight", regParam=1 / (c * s.sum()), standardization=False, maxIter=1000, tol=1e-12).fit(df)
    assert np.allclose(w, [*other.coefficients, other.intercept], atol=2e-4)


def test_many_values_share_the_passes(data, monkeypatch):
    df, x, y, s = data
    monkeypatch.setattr(newton, "_MOST_SUMS", 45)  # three of the five at a time
    cs = [1e-3, 1e-2, 0.1, 1.0, 10.0]
    for c, w in zip(cs, newton.fit_many(df, cs)):
        assert np.abs(gradient(w, x, y, s, c)).max() < 1e-6 * max(1.0, c)


def test_steps_that_overshoot_are_halved(spark):
    rows = [(20.0 * k, float(k > 0), 1.0) for k in (-3, -2, -1, 1, 2, 3)] + [(1.0, 0.0, 1.0), (-1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, label double, weight double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    x, y = np.array([[r[0]] for r in rows]), np.array([r[1] for r in rows])
    w = newton.fit_many(df, [100.0])[0]
    assert np.abs(gradient(w, x, y, np.ones(len(x)), 100.0)).max() < 1e-5
    with pytest.raises(ValueError):
        newton.fit_many(df.limit(0), [1.0])


def test_the_model_scores_in_expressions_and_is_saved(data, tmp_path):
    df, x, _, _ = data
    model = newton.NewtonLogistic(C=2.0).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = newton.NewtonLogisticModel.load(str(tmp_path / "m"))
    want = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    for m in (model, back):
        out = m.transform(df)
        got = out.select(vector_to_array("probability").alias("p"), "prediction", vector_to_array("rawPrediction")[1].alias("z")).collect()
        assert np.allclose([r["p"][1] for r in got], want) and all(r["prediction"] == float(r["z"] > 0) for r in got)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(families.positive_score(model, df).columns) >= {"score", "probability", "prediction"}


def test_other_labels_are_an_error(data):
    df, *_ = data
    for bad in (df.where("label = 1"), df.withColumn("label", F.lit(2.0)), df.withColumn("label", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            families.with_class_weights(bad.drop("weight"))
