"""The Fourier SVM's certificate against values computed whole."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from sieveline.models import rff


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) + rng.normal(size=400) * 0.2 < 1.1).astype(int)
    s = np.where(y == 1, 1.4, 0.8)
    df = spark.createDataFrame([(i, *map(float, r), int(b), float(w)) for i, (r, b, w) in enumerate(zip(x, y, s))], "id long, a double, b double, label int, weight double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.repartition(5)).cache(), x, y, s


def hinge_objective(w, z, y, s, c):
    return 0.5 * w[:-1] @ w[:-1] + c * s @ np.maximum(0.0, 1.0 - np.where(y == 1, 1, -1) * (z @ w))


@pytest.mark.parametrize("c,gap", [(0.05, 1e-3), (1.0, 1e-2), (30.0, 2e-2)])
def test_no_weights_do_better_than_the_gap_allows(data, c, gap):
    df, x, y, s = data
    model = rff.RffSvm(C=c, gamma=0.7, numFeatures=60, gap=gap).fit(df)
    w, share = np.array(model.getOrDefault("weights")), model.getOrDefault("gap")
    assert 0 <= share <= gap
    z = rff.Lift(2, 60, 0.7, 42)(x)
    best = hinge_objective(w, z, y, s, c)
    rng, t = np.random.default_rng(0), w.copy()
    lowest = best
    for i in range(3000):  # subgradient steps from the solution
        side = np.where(y == 1, 1, -1)
        bad = side * (z @ t) < 1
        t = t - 0.02 / (1 + i) ** 0.5 * (np.append(t[:-1], 0.0) - c * (s * side * bad) @ z) / max(1.0, c * 20)
        lowest = min(lowest, hinge_objective(t, z, y, s, c))
    assert lowest >= best * (1 - gap)
    for _ in range(50):
        assert hinge_objective(w + rng.normal(size=61) * 0.02, z, y, s, c) > best * (1 - gap)


def test_models_score_and_are_saved(data, tmp_path):
    df, x, y, _ = data
    model = rff.RffSvm(C=5.0, gamma=1.0, numFeatures=100).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = []
    for m in (model, rff.RffSvmModel.load(str(tmp_path / "m"))):
        rows = m.transform(df).orderBy("id").select(vector_to_array("probability")[1].alias("p"), "prediction").collect()
        out.append([r["p"] for r in rows])
        assert np.mean([r["prediction"] for r in rows] == y) > 0.85
    assert out[0] == out[1] and abs(np.mean(out[0]) - y.mean()) < 0.1
    assert model.transform(df.limit(0)).count() == 0


def test_sums_of_many_tasks(data, monkeypatch):
    df, *_ = data
    few = rff.RffSvm(C=1.0, gamma=0.5, numFeatures=20).fit(df).getOrDefault("weights")
    monkeypatch.setattr(rff, "_FEW_TASKS", 2)
    assert np.allclose(rff.RffSvm(C=1.0, gamma=0.5, numFeatures=20).fit(df).getOrDefault("weights"), few, atol=1e-4)


def test_no_rows(data):
    with pytest.raises(ValueError):
        rff.RffSvm().fit(data[0].limit(0))
