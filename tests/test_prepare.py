import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import exprs as E
from sieveline.operators import correlation, harmonize, ordering, profile, quantiles, records, screen, splits, validate
from sieveline.sources import catalogs


def values(df, column, order):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def test_unit_conversion_coerces_and_leaves_input_alone(spark):
    df = spark.createDataFrame([(1, "0.1"), (2, "0.25"), (3, "bad"), (4, None)], "i int, transit_depth string")
    out = harmonize.convert_units(df, {"transit_depth": C.PERCENT_TO_PPM})
    assert values(out, "transit_depth", "i") == [1000.0, 2500.0, None, None]
    assert values(df, "transit_depth", "i") == ["0.1", "0.25", "bad", None]


def test_number_rejects_what_is_no_number(spark):
    texts = [" 2 ", "1.5d", "1e3", "NaN", "inf", "", None, ".5", "1_0"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    out = df.select("i", E.number_of(df, "s").alias("x"))
    assert values(out, "x", "i") == [2.0, None, 1000.0, None, math.inf, None, None, 0.5, None]


def test_nan_is_missing_and_never_out_of_range(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 91.0), (4, 90.0), (5, -0.1), (6, 0.0)], "i int, x double")
    once = screen.screen_physical(df, {"x": (0.0, 90.0), "absent": (0.0, None)})
    assert values(once, "x", "i") == [None, None, None, 90.0, None, 0.0]
    twice = screen.screen_physical(once, {"x": (0.0, 90.0)})
    assert values(twice, "x", "i") == values(once, "x", "i")
    assert values(screen.screen_physical(df, {"x": (0.0, 90.0)}, replace_with=-1), "x", "i") == [None, None, -1.0, 90.0, -1.0, 0.0]
    row = screen.screen_summary(df, {"x": (0.0, 90.0)}).first()
    assert (row["out_of_range_n"], row["out_of_range_pct"]) == (2, pytest.approx(2 / 6))
    assert screen.screen_summary(df, {"y": (0.0, 1.0)}).count() == 0


def test_logs_keep_missing(spark):
    df = spark.createDataFrame([(1, None), (2, -5.0), (3, 0.0), (4, math.e - 1)], "i int, x double")
    assert values(screen.right_log(df, ["x", "absent"]), "x", "i") == [None, 0.0, 0.0, pytest.approx(1.0)]
    out, used = screen.left_reflect_log(df, ["x"])
    assert used["x"] == pytest.approx(math.e - 1 + 1e-6)
    got = values(out, "x", "i")
    assert got[0] is None and got[3] == pytest.approx(math.log1p(1e-6)) and got[1] == pytest.approx(math.log1p(used["x"] + 5))
    fixed, used = screen.left_reflect_log(df, ["x"], reflection_max={"x": 0.5})
    assert used == {"x": 0.5} and values(fixed, "x", "i")[3] == 0.0  # above the maximum: floored


def test_required_columns_are_named_sorted(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError, match="b, z"):
        harmonize.rename_to_canonical(df, {"z": "z", "a": "a", "b": "b"})


def raw_csv(path, names, rows, comment=True):
    lines = ["# a comment line"] if comment else []
    lines += [",".join(names)] + [",".join("" if v is None else str(v) for v in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_both_catalogues_from_csv_to_splits(spark, tmp_path):
    names_a, names_b = ["extra", *C.RENAME_A], ["default_flag", *C.RENAME_B]
    measures = [1.5] * 19
    kinds = ["CONFIRMED", "FALSE POSITIVE", "CANDIDATE", "REFUTED", "odd"]
    a = raw_csv(tmp_path / "a.csv", names_a, [["x", i, kinds[i % 3], *measures] for i in range(30)])
    b = raw_csv(tmp_path / "b.csv", names_b, [[i % 2, f"p{i}", kinds[i % 5], *measures] for i in range(40)])
    surveys = harmonize.prepare_surveys(catalogs.read_survey_a(spark, a), catalogs.read_survey_b(spark, b))
    counts = {k: v.count() for k, v in surveys.items()}
    assert counts == {"a_labeled": 20, "a_candidates": 10, "b_labeled": 12, "b_candidates": 4}
    assert surveys["a_labeled"].schema["group_id"].dataType.simpleString() == "string"
    assert "label" not in surveys["a_candidates"].columns
    assert not set(C.DROP_MISSING) & set(surveys["b_candidates"].columns)
    assert {r[0] for r in surveys["b_labeled"].select("transit_depth").collect()} == {15000.0}
    assert {r[0] for r in surveys["a_labeled"].select("transit_depth").collect()} == {1.5}
    assert catalogs.read_survey_b(spark, b, preferred_only=False).count() == 40

    parts = splits.named_splits(surveys["a_labeled"], surveys["b_labeled"])
    path = catalogs.save_splits(parts, surveys["a_candidates"], surveys["b_candidates"], str(tmp_path / "splits"))
    sizes = {s: catalogs.load_split(spark, path, s).count() for s in catalogs.SPLITS}
    assert sizes["train"] + sizes["test"] == 20 and sizes["b_labeled"] == 12
    assert (sizes["a_unlabeled"], sizes["b_unlabeled"]) == (10, 4)
    assert "label" not in catalogs.load_split(spark, path, "a_unlabeled").columns
    sets = harmonize.evaluation_sets(catalogs.load_split(spark, path, "test"), catalogs.load_split(spark, path, "b_labeled"))
    by_set = {r[0]: r[1] for r in sets.groupBy("dataset").count().collect()}
    assert by_set[C.SET_AB] == by_set[C.SET_A] + by_set[C.SET_B]
    with pytest.raises(KeyError, match="transit_depth"):
        harmonize.evaluation_sets(surveys["a_labeled"].drop("transit_depth"), surveys["b_labeled"])


def test_partition_report_counts_rows_in_neither(spark):
    df = spark.createDataFrame([("CONFIRMED",), ("CANDIDATE",), ("confirmed",), (None,)], "label string")
    got = {(r["part"], r["raw_label"]): r["n"] for r in harmonize.partition_report(df).collect()}
    assert got == {("labeled", "CONFIRMED"): 1, ("candidate", "CANDIDATE"): 1, ("neither", "confirmed"): 1, ("neither", None): 1}


@pytest.mark.parametrize("direct", [10**6, 50])
def test_exact_quantiles_equal_numpy(spark, direct):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=4000)
    hot = np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 20, 4000).astype(float))  # one value on 40 % of rows
    spike = np.where(np.arange(4000) < 3990, 0.0, 1e9)
    rows = [(float(a), float(b), float(c), None, float(a) if i % 3 else None) for i, (a, b, c) in enumerate(zip(x, hot, spike))]
    df = spark.createDataFrame(rows, "x double, hot double, spike double, empty double, gaps double").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = quantiles.exact_quantiles(df, df.columns, probs, direct_rows=direct)
    assert got["empty"] is None
    gaps = np.array([r[4] for r in rows if r[4] is not None])
    for name, data in (("x", x), ("hot", hot), ("spike", spike), ("gaps", gaps)):
        np.testing.assert_allclose(got[name], np.percentile(data, [100 * p for p in probs]), rtol=1e-12)


def test_iqr_fences_and_clip(spark):
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate([1.0, 2.0, 3.0, 10.0, None])], "i int, x double, e double")
    clipped, fitted, summary = screen.fit_and_clip(df, columns=["x", "e", "absent"])
    q1, q3 = 1.75, 4.75
    assert fitted == {"x": (q1, q3, q1 - 4.5, q3 + 4.5)}
    row = summary.first()
    assert (row["outlier_n"], row["outlier_pct"]) == (1, pytest.approx(0.2))
    assert values(clipped, "x", "i") == [1.0, 2.0, 3.0, 9.25, None]


def test_profile_of_odd_columns(spark):
    rows = [(1.0, None, 5.0), (2.0, None, 5.0), (2.0, None, 5.0), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, empty double, flat double")
    got = {r["feature"]: r.asDict() for r in profile.column_profile(df).collect()}
    assert got["a"]["missing_rate"] == 0.25 and got["a"]["n_unique"] == 2
    assert got["a"]["top_value_frac"] == pytest.approx(2 / 3) and got["a"]["median"] == 2.0
    assert (got["empty"]["missing_rate"], got["empty"]["n_unique"], got["empty"]["median"]) == (1.0, 0, None)
    dropped = {r["feature"]: r["reason"] for r in profile.drop_suggestions(profile.column_profile(df)).collect()}
    assert dropped == {"empty": "missing", "flat": "constant"}
    approx = {r["feature"]: r.asDict() for r in profile.column_profile(df, mode="approx").collect()}
    assert approx["a"]["n_unique"] == 2 and approx["a"]["top_value_frac"] == pytest.approx(2 / 3)
    bins = profile.histograms(df, ["flat", "empty"], bins=4).orderBy("bin").collect()
    assert [(r["feature"], r["n"]) for r in bins] == [("flat", 0), ("flat", 0), ("flat", 4), ("flat", 0)]


def test_spearman_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 6, 300).astype(float)
    b = a + rng.normal(size=300)
    c = np.where(rng.random(300) < 0.3, np.nan, rng.integers(0, 3, 300))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c))], "i long, a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in correlation.spearman(df, ["a", "b", "c"], key="i").collect()}
    import pandas as pd

    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    for (x, y), rho in got.items():
        pair = pdf[[x, y]].loc[:, ~pdf[[x, y]].columns.duplicated()].dropna()
        assert rho == pytest.approx(np.corrcoef(pair[x].rank(), pair[y].rank())[0, 1])
    strong = correlation.correlated_pairs(correlation.pearson(df, ["a", "b", "c"]), limit=0.5).collect()
    assert [(r["feature_i"], r["feature_j"]) for r in strong] == [("b", "a")]


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    got = ordering.value_index(df, order="k").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_positions_with_a_value_on_a_third_of_the_rows(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 101).alias("v"))
    placed = ordering.value_index(df, order="v", ties=["id"])
    assert placed.columns == ["id", "v", "idx"]
    got = [(r["v"], r["id"]) for r in placed.orderBy("idx").collect()]
    assert got == sorted(got) and [r["idx"] for r in placed.orderBy("idx").collect()] == list(range(6000))


def test_positions_of_a_text_key_with_a_frequent_value(spark):
    df = spark.range(5000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    df = df.withColumn("k", F.when(F.col("n") != 7, F.col("k")))
    for ties in (["n"], []):
        placed = ordering.value_index(df, order="k", ties=ties).orderBy("idx").collect()
        keys = [r["k"] for r in placed]
        assert [r["idx"] for r in placed] == list(range(5000)) and keys[0] is None and keys[1:] == sorted(keys[1:])
        if ties:
            own = [r["n"] for r in placed if r["k"] == "same"]
            assert own == sorted(own)


def test_large_groups_skip_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(splits, "LOOKUP_ROWS", 5)
    monkeypatch.setattr(splits, "LOOKUP_SHARE", 10**9)
    df = fold_frame(spark, [1 + g % 9 for g in range(900)])
    light = {r["group_id"]: r["fold"] for r in splits.group_folds(df).collect()}
    folded = splits.with_folds(df)
    assert folded.count() == df.count()
    assert all(light[r["group_id"]] == r["fold"] for r in folded.collect())


def test_records(spark):
    df = spark.createDataFrame([(10 * i, f"g{i % 3}", i % 2, float(i) if i else None) for i in range(8)], "k long, group_id string, label int, x double")
    listed = records.list_records(df, order=["k"], max_rows=3).collect()
    assert [(r["row_id"], r["group_id"], r["label"]) for r in listed] == [(0, "g0", 0), (1, "g1", 1), (2, "g2", 0)]
    assert records.list_records(df.drop("label"), order=["k"], max_rows=0).count() == 8
    table = records.numbered(df, order="k")
    assert math.isnan(records.get_record(table, 0, features=["x"])["x"])
    assert records.get_record(table, 7, features=["x"]) == {"x": 7.0}
    with pytest.raises(IndexError):
        records.get_record(table, 8, features=["x"])
    asked = spark.createDataFrame([(2,), (5,), (99,)], "row_id long")
    assert sorted(r["x"] for r in records.get_records(table, asked, features=["x"]).collect()) == [2.0, 5.0]
    assert {r["group_id"]: r["row_id"] for r in records.first_rows(table).collect()} == {"g0": 0, "g1": 1, "g2": 2}


def fold_frame(spark, sizes):
    rows = [(f"g{g}", int((g + i) % 3 == 0), i) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "group_id string, label int, i int")


def test_folds_keep_groups_whole_and_classes_even(spark):
    df = fold_frame(spark, [1 + g % 7 for g in range(900)])
    folded = splits.with_folds(df)
    assert folded.count() == df.count()
    assert folded.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    rate = df.agg(F.avg("label")).first()[0]
    for r in folded.groupBy("fold").agg(F.count("*").alias("n"), F.avg("label").alias("p")).collect():
        assert r["n"] == pytest.approx(df.count() / 5, rel=0.05) and r["p"] == pytest.approx(rate, abs=0.03)


def test_a_group_with_a_third_of_all_rows_leaves_the_other_folds_even(spark):
    df = fold_frame(spark, [3000, *[2] * 3000])
    folded = splits.with_folds(df)
    assert folded.count() == 9000
    sizes = sorted(r[1] for r in folded.groupBy("fold").count().collect())
    assert sizes[-1] == 3000  # the heavy group alone
    assert max(sizes[:-1]) - min(sizes[:-1]) <= 40


def test_folds_depend_on_shares_alone(spark):
    sizes = [600, 90, 45, *[1 + g % 4 for g in range(400)]]
    small_, twice = (splits.group_folds(fold_frame(spark, [n * k for n in sizes]).withColumn("label", F.lit(1))) for k in (1, 2))
    folds = {r["group_id"]: r["fold"] for r in small_.collect()}
    assert len(folds) == len(sizes)
    assert folds == {r["group_id"]: r["fold"] for r in twice.collect()}


def test_split_errors(spark):
    df = fold_frame(spark, [1, 2, 3])
    with pytest.raises(KeyError):
        splits.with_folds(df.drop("label"))
    with pytest.raises(ValueError, match="group_id"):
        splits.with_folds(df.withColumn("group_id", F.when(F.col("i") > 0, F.col("group_id"))))
    with pytest.raises(ValueError, match="folds 0 to 4"):
        splits.train_test_split(df, fold_index=5)


def test_background_sample_is_exact_and_repeatable(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"))
    first = splits.background_sample(df, features=["x"], key="id", max_rows=50)
    again = splits.background_sample(df.repartition(7), features=["x"], key="id", max_rows=50)
    assert {r[0] for r in first.collect()} == {r[0] for r in again.collect()} and first.count() == 50
    assert splits.background_sample(df, features=["x"], key="id", max_rows=900).count() == 500
    with pytest.raises(KeyError, match="y"):
        splits.background_sample(df, features=["y"], key="id")


def test_validation_messages(spark):
    features = list(C.MODEL_FEATURES)
    row = {f: "1.0" for f in features if f != "orbital_period_days"}
    row.update(transit_depth="bad-number", impact_parameter="-1", stellar_logg_cgs="7", a_over_rs="inf", stellar_teff_k=None)
    schema = ", ".join(f"{k} string" for k in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    got = validate.validate_rows(df).first()
    assert list(got["errors"]) == [
        "Missing required feature: orbital_period_days",
        "impact_parameter: -1 is below minimum 0",
        "transit_depth: expected numeric value, got 'bad-number'",
        "stellar_teff_k: value is required",
        "stellar_logg_cgs: 7 is above maximum 6",
    ]
    assert (got["impact_parameter"], got["stellar_logg_cgs"], got["a_over_rs"]) == (-1.0, 7.0, math.inf)
    with pytest.raises(Exception, match="Missing required feature: orbital_period_days; impact_parameter"):
        validate.require_valid(validate.validate_rows(df)).collect()
    valid, rejected = validate.split_valid(validate.validate_rows(df))
    assert valid.count() == 0 and rejected.count() == 1


def test_general_format_writes_numbers_like_c(spark):
    xs = [0.0, -1.0, 7.0, 123456.0, 1234567.0, 0.0001234, 0.00001234, 1e-300, 1e20, 100000.0, 999999.5, 3.14159265, -0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = values(df.select("i", validate.general_format(F.col("x")).alias("s")), "s", "i")
    assert got == [f"{x:g}" for x in xs]


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None), (1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    got = validate.fill_defaults(df, features="abcd", intervals={"a": (0.0, 2.0), "b": (3.0, None), "c": (None, 9.0)}).collect()
    assert sorted(map(tuple, got)) == [(1.0, 2.0, 3.0, 4.0), (1.0, 3.0, 9.0, 0.0)]


def test_grouped_digits_are_numbers(spark):
    df = spark.createDataFrame([("1_000",), ("1__0",), ("_1",), ("1_0.5e1_0",), ("1_",)], "x string")
    rows = [(r["x"], len(r["errors"])) for r in validate.validate_rows(df, features=["x"], intervals={}).collect()]
    assert rows == [(1000.0, 0), (None, 1), (None, 1), (10.5e10, 0), (None, 1)]


def test_spearman_with_frequent_values_and_missing_partners(spark):
    import pandas as pd

    rng = np.random.default_rng(8)
    n = 2500
    pdf = pd.DataFrame({"a": rng.integers(0, 1500, n).astype(float), "b": rng.normal(size=n), "c": rng.normal(size=n), "none": np.nan})
    pdf.loc[: n // 3, "a"] = 7.0  # a value on a third of the rows
    pdf.loc[rng.random(n) < 0.4, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "c"] = np.nan
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(pdf.itertuples(index=False))], "i long, a double, b double, c double, none double")
    for r in correlation.spearman(df, list(pdf.columns), key="i").collect():
        pair = pdf[[r["feature_i"]]].assign(y=pdf[r["feature_j"]]).dropna()
        if pair.empty:
            assert r["rho"] is None
        else:
            assert r["rho"] == pytest.approx(np.corrcoef(pair.iloc[:, 0].rank(), pair["y"].rank())[0, 1])
