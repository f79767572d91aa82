import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.models import stages
from sieveline.operators import screen


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        x = rng.lognormal(1.0, 1.0, len(C.MODEL_FEATURES)).tolist()
        x[4] = float(90 - abs(rng.normal()))  # inclination
        if i % 9 == 0:
            x[i % 11] = None
        if i % 50 == 0:
            x[1] = 5.0  # above its physical maximum
        rows.append((str(i), int(i % 3 == 0), *x))
    schema = "row_id string, label int, " + ", ".join(f"{f} double" for f in C.MODEL_FEATURES)
    return spark.createDataFrame(rows, schema)


def frame(df, columns):
    return np.array([[r[c] for c in columns] for r in df.orderBy(F.col("row_id").cast("int")).collect()], dtype=float)


def numpy_chain(df, train=None):
    """The seven steps on arrays, fitted on `train`."""
    names = list(C.MODEL_FEATURES)

    def first(x):
        x = x.copy()
        for j, n in enumerate(names):
            lo, hi = C.PHYSICAL_INTERVALS[n]
            bad = np.zeros(len(x), bool)
            if lo is not None:
                bad |= x[:, j] < lo
            if hi is not None:
                bad |= x[:, j] > hi
            x[bad, j] = np.nan
            if n in C.RIGHT_SKEWED:
                x[:, j] = np.log1p(np.clip(x[:, j], 0, None))
        return x

    x, t = first(df), first(df if train is None else train)
    j = names.index("inclination_deg")
    top = np.nanmax(t[:, j]) + 1e-6
    for part in (x, t):
        part[:, j] = np.log1p(np.clip(top - part[:, j], 0, None))
    q1, q3 = np.nanpercentile(t, [25, 75], axis=0)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    x, t = np.clip(x, lo, hi), np.clip(t, lo, hi)
    med = np.nanmedian(t, axis=0)
    x, t = np.where(np.isnan(x), med, x), np.where(np.isnan(t), med, t)
    return (x - t.mean(axis=0)) / t.std(axis=0)


def test_chain_equals_numpy_and_both_fits_agree(spark, catalogue):
    names = list(C.MODEL_FEATURES)
    want = numpy_chain(frame(catalogue, names))
    one = stages.preprocessing_pipeline(keep=["row_id", "label"], vector=None).fit(catalogue)
    fused = stages.fit_preprocessing(catalogue, keep=["row_id", "label"], vector=None)
    for model in (one, fused):
        out = model.transform(catalogue)
        assert out.columns == ["row_id", "label", *names]
        np.testing.assert_allclose(frame(out, names), want, rtol=1e-9, atol=1e-9)


def test_fitted_state_ignores_the_test_part(spark, catalogue):
    names = list(C.MODEL_FEATURES)
    train = catalogue.where(F.col("row_id").cast("int") < 300)
    test = catalogue.where(F.col("row_id").cast("int") >= 300)
    model = stages.fit_preprocessing(train, keep=["row_id"], vector=None)
    want = numpy_chain(frame(test, names), frame(train, names))
    np.testing.assert_allclose(frame(model.transform(test), names), want, rtol=1e-9, atol=1e-9)


def test_save_and_load(spark, catalogue, tmp_path):
    model = stages.fit_preprocessing(catalogue, keep=["row_id"])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a = [r["features"] for r in model.transform(catalogue).orderBy("row_id").collect()]
    b = [r["features"] for r in again.transform(catalogue).orderBy("row_id").collect()]
    assert a == b


def test_exploratory_chain(spark):
    df = spark.createDataFrame([(0.0, 89.0, 1.0), (0.0, 90.0, 2.0), (0.0, 91.0, 3.0)], "eccentricity double, inclination_deg double, transit_depth double")
    model = stages.exploratory_pipeline(right_skewed=["transit_depth"]).fit(df)
    out = model.transform(df)
    assert out.columns == ["inclination_deg", "transit_depth"]
    got = sorted((r["inclination_deg"] is None, r["inclination_deg"]) for r in out.collect())
    assert got[-1] == (True, None)
    assert model.stages[1].summary(df).first()["out_of_range_n"] == 1
    assert set(model.stages[-1].fences) == {"inclination_deg", "transit_depth"}


def test_given_fences_are_used_and_report_zero_counts(spark):
    df = spark.createDataFrame([(1.0,), (100.0,), (None,)], "x double")
    model = stages.IqrClipper(fences={"x": (0.0, 10.0)}).fit(df)
    assert sorted(r[0] for r in model.transform(df).dropna().collect()) == [1.0, 10.0]
    row = model.summary(df).first()
    assert (row["lower_fence"], row["upper_fence"], row["outlier_n"], row["outlier_pct"]) == (0.0, 10.0, 0, 0.0)


def test_partly_given_reflection_maxima_are_completed(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 4.0)], "a double, b double")
    model = stages.LeftSkewReflectLog(columns=["a", "b"], reflectionMax={"a": 10.0}).fit(df)
    assert model.get("state") == {"a": 10.0, "b": 4.0 + 1e-6}


@pytest.mark.parametrize(
    "strategy,want", [("median", 2.5), ("mean", 10 / 3 + 1), ("most_frequent", 2.0), ("constant", -1.0)]
)
def test_imputation_strategies(spark, strategy, want):
    df = spark.createDataFrame([(2.0,), (2.0,), (3.0,), (10.333333333333332,), (None,)], "x double")
    model = stages.MedianImputer(columns=["x"], strategy=strategy, fillValue=-1.0).fit(df)
    assert model.transform(df).collect()[-1][0] == pytest.approx(want)


def test_all_missing_column_cannot_be_imputed(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    with pytest.raises(ValueError, match="x"):
        stages.MedianImputer(columns=["x", "y"]).fit(df)


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in stages.Standardizer(columns=["x"]).fit(df).transform(df).collect()] == [0.0, 0.0]


def test_strictness(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    for stage in (stages.RightSkewLog(columns=["x", "b", "a"]), stages.FeatureSelector(columns=["x", "b", "a"])):
        with pytest.raises(KeyError, match="a, b"):
            stage.transform(df)
    assert stages.ColumnDropper(columns=["x", "gone"]).transform(df.withColumn("y", F.lit(1))).columns == ["y"]
    assert stages.ColumnDropper(columns=["gone"]).absent(df) == ["gone"]
    with pytest.raises(KeyError, match="gone"):
        stages.ColumnDropper(columns=["gone"], strict=True).transform(df)
    with pytest.raises(KeyError, match="q"):
        stages.LeftSkewReflectLog(columns=["q"]).fit(df)


def test_plan_is_one_projection_without_python(spark, catalogue):
    out = stages.fit_preprocessing(catalogue, keep=["row_id"], vector=None).transform(catalogue)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert screen.clip_to_fences(catalogue, {"absent": (0.0, 1.0)}).columns == catalogue.columns
