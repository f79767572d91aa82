"""Exact tree attributions against every coalition."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sieveline.operators import trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 4)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.3).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df), x


def plain(score, x, background):
    """Shapley values of `score` over rows, by all coalitions; (rows, features)."""
    d = x.shape[1]
    out = np.zeros(x.shape)
    for f in range(d):
        rest = [g for g in range(d) if g != f]
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for others in combinations(rest, size):
                for z in background:
                    mixed = np.tile(z, (len(x), 1))
                    mixed[:, list(others)] = x[:, list(others)]
                    without = score(mixed)
                    mixed[:, f] = x[:, f]
                    out[:, f] += weight * (score(mixed) - without) / len(background)
    return out


def walk(leaves, x):
    out = np.zeros(len(x))
    for leaf in leaves:
        inside = np.ones(len(x), bool)
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            inside &= (x[:, f] > low) & (x[:, f] <= high)
        out += leaf.value * inside
    return out


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["feature"]] = r["shap_value"]
    return np.array([[out[i][n] for n in NAMES] for i in sorted(out)])


@pytest.mark.parametrize(
    "kind,settings",
    [
        (DecisionTreeClassifier, {"maxDepth": 6}),
        (RandomForestClassifier, {"numTrees": 7, "maxDepth": 5, "seed": 3}),
        (RandomForestClassifier, {"numTrees": 2, "maxDepth": 0}),
    ],
)
def test_probabilities_against_all_coalitions(spark, data, kind, settings):
    df, x = data
    model = kind(**settings).fit(df)
    leaves, margin = trees.read_leaves(model, spark)
    assert not margin
    predicted = [r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(walk(leaves, x), predicted, atol=1e-12)
    background = x[:25]
    got = trees.tree_attribution(df.where("id < 60"), df.where("id < 25"), key="id", features=NAMES, leaves=leaves)
    assert np.allclose(values(got), plain(lambda m: walk(leaves, m), x[:60], background), atol=1e-12)
    base = {r["base_value"] for r in got.collect()}
    assert len(base) == 1 and base.pop() == pytest.approx(walk(leaves, background).mean())


def test_boosted_margins_are_scaled_to_probability(spark, data):
    df, x = data
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(df)
    leaves, margin = trees.read_leaves(model, spark)
    assert margin
    p = lambda m: 1 / (1 + np.exp(-2 * m))
    predicted = [r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(p(walk(leaves, x)), predicted, atol=1e-12)
    got = values(trees.tree_attribution(df.where("id < 30"), df.where("id < 12"), key="id", features=NAMES, leaves=leaves, margin=True))
    want = np.zeros((30, 4))
    for z in x[:12]:
        m, n = walk(leaves, x[:30]), walk(leaves, z[None, :])[0]
        slope = np.where(np.abs(m - n) < 1e-12, 2 * p(m) * (1 - p(m)), (p(m) - p(n)) / np.where(m == n, 1, m - n))
        want += plain(lambda q: walk(leaves, q), x[:30], z[None, :]) * slope[:, None] / 12
    assert np.allclose(got, want, atol=1e-10)
    assert np.allclose(got.sum(1), predicted[:30] - p(walk(leaves, x[:12])).mean(), atol=1e-10)


def test_boxes_of_repeated_features_and_dead_ends():
    nodes = [
        {"id": 0, "feature": 0, "threshold": 5.0, "left": 1, "right": 2},
        {"id": 1, "feature": 0, "threshold": 2.0, "left": 3, "right": 4},
        {"id": 2, "feature": 0, "threshold": 1.0, "left": 5, "right": 6},  # nothing goes left here
        *({"id": i, "value": float(i)} for i in (3, 4, 5, 6)),
    ]
    boxes = {leaf.value: (leaf.low[0], leaf.high[0]) for leaf in trees.leaves_of(nodes)}
    assert boxes == {3.0: (-math.inf, 2.0), 4.0: (2.0, 5.0), 6.0: (5.0, math.inf)}
    assert [leaf.value for leaf in trees.leaves_of([{"id": 0, "value": 0.5}], weight=2.0)] == [1.0]


def test_backgrounds_are_bounded_and_needed(data):
    df, _ = data
    leaf = [trees.Leaf((0,), (0.0,), (math.inf,), 1.0)]
    for rows in (df.limit(0), df):
        with pytest.raises(ValueError):
            trees.tree_attribution(df, rows, key="id", features=NAMES, leaves=leaf)
    none = trees.tree_attribution(df.limit(0), df.limit(3), key="id", features=NAMES, leaves=leaf)
    assert none.count() == 0
    wide = trees.tree_attribution(df.withColumn("mark", F.lit("m")), df.limit(3), key="id", features=NAMES, leaves=leaf, carry=["mark"])
    assert wide.count() == 960 and {r["mark"] for r in wide.collect()} == {"m"}


def test_long_paths_and_missing_values(spark):
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in range(11)]
    x = rng.normal(size=(30, 11))
    x[3, 4] = np.nan
    leaves = [trees.Leaf(tuple(range(11)), (-1.5,) * 11, (math.inf,) * 11, 0.7), trees.Leaf((2, 4), (-math.inf, 0.1), (0.4, math.inf), 0.2)]
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = trees.tree_attribution(df, df.where("id < 3"), key="id", features=names, leaves=leaves).collect()
    above = np.where(np.isnan(x), 99.0, x)
    want = plain(lambda m: walk(leaves, m), above[:6], above[:3])
    mine = {(r["id"], r["feature"]): r["shap_value"] for r in got}
    assert np.allclose([[mine[i, n] for n in names] for i in range(6)], want, atol=1e-12)
