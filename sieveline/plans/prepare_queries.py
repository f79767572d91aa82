"""Harmonising, splitting, profiling and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.config import SEED
from sieveline.operators import correlation, harmonize, profile, records, screen, splits, validate
from sieveline.models import stages
from sieveline.operators.thresholds import decide
from sieveline.operators.evaluate import confusion, with_metrics
from sieveline.plans import sql_views as V
from sieveline.plans import testbed as T
from sieveline.plans.registry import query, with_ctes
from sieveline.session import scratch_path, written
from sieveline.sources import catalogs

DIGITS = 6


def rounded(df, *columns):
    return df.select(*[F.round(c, DIGITS).alias(c) if c in columns else F.col(c) for c in df.columns])


def r(*columns):
    return ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in columns)


A_COLS = T.FEATURES_A


@query("harmonize_a", with_ctes(V.A_RAW, V.A, "SELECT row_id, group_id, label, quantity, price, discount, tax FROM a"))
def harmonize_a(spark, sf):
    return T.survey_a(spark, sf)[0]


@query("harmonize_b", with_ctes(V.B_RAW, V.B, f"SELECT event_id, group_id, label, {r('amount', 'k')} FROM b"))
def harmonize_b(spark, sf):
    return rounded(T.survey_b(spark, sf)[0], "amount", "k")


@query(
    "candidates_union",
    with_ctes(
        V.A_RAW,
        V.B_RAW,
        """SELECT dataset, group_id, count(*) AS n_rows FROM (
             SELECT 'survey_a' AS dataset, group_id FROM a_raw WHERE raw_label = 'CANDIDATE'
             UNION ALL
             SELECT 'survey_b', group_id FROM b_raw WHERE raw_label = 'CANDIDATE' AND default_flag = 1)
           GROUP BY ALL""",
    ),
)
def candidates_union(spark, sf):
    """U1 on the unlabeled parts: one union, counted per group."""
    sets = {"survey_a": T.survey_a(spark, sf)[1].select("group_id"), "survey_b": T.survey_b(spark, sf)[1].select("group_id")}
    return harmonize.combine_sets(sets).groupBy("dataset", "group_id").agg(F.count("*").alias("n_rows"))


@query(
    "label_counts",
    with_ctes(V.B_RAW, "SELECT raw_label AS disposition, count(*) AS n FROM b_raw GROUP BY 1 ORDER BY n DESC, 1"),
)
def label_counts(spark, sf):
    return profile.category_counts(T.survey_b_raw(spark, sf), "disposition")


@query(
    "unmapped_report",
    with_ctes(
        V.B_RAW,
        """SELECT CASE WHEN raw_label IN ('CONFIRMED', 'FALSE POSITIVE', 'REFUTED') THEN 'labeled'
                       WHEN raw_label = 'CANDIDATE' THEN 'candidate' ELSE 'neither' END AS part,
                  raw_label, count(*) AS n FROM b_raw GROUP BY ALL""",
    ),
)
def unmapped_report(spark, sf):
    return harmonize.partition_report(T.survey_b_raw(spark, sf), target="disposition")


@query("group_folds", with_ctes(V.A_RAW, V.A, V.FOLDS, "SELECT group_id, n_pos, n_neg, fold FROM folds"))
def group_folds(spark, sf):
    return splits.group_folds(T.survey_a(spark, sf)[0])


@query("group_folds_heavy", with_ctes(V.A_RAW, V.A, V.HEAVY, V.HEAVY_FOLDS, "SELECT group_id, n_pos, n_neg, fold FROM folds"))
def group_folds_heavy(spark, sf):
    """K1 where nine groups hold over 1 % of the rows each: they are placed first, the others fill up."""
    a = T.survey_a(spark, sf)[0]
    number = F.split("row_id", "-")[2].cast("int")
    big = F.when(number % 5 == 0, F.concat(F.lit("big-"), (number % 9).cast("string"))).otherwise(F.col("group_id"))
    return splits.group_folds(a.withColumn("group_id", big))


@query(
    "fold_balance",
    with_ctes(
        V.A_RAW,
        V.A,
        V.FOLDS,
        """SELECT fold, CAST(sum(n_pos + n_neg) AS BIGINT) AS n_rows, CAST(sum(n_pos) AS BIGINT) AS n_pos,
                  count(*) AS n_groups FROM folds GROUP BY fold""",
    ),
)
def fold_balance(spark, sf):
    return splits.fold_balance(splits.with_folds(T.survey_a(spark, sf)[0]))


@query(
    "train_test_split",
    with_ctes(
        V.A_RAW,
        V.A,
        V.FOLDS,
        """SELECT row_id, group_id, label, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split
           FROM a JOIN folds USING (group_id)""",
    ),
)
def train_test_split(spark, sf):
    return splits.train_test_split(T.survey_a(spark, sf)[0]).select("row_id", "group_id", "label", "split")


@query(
    "named_splits",
    with_ctes(
        V.A_RAW,
        V.A,
        V.B_RAW,
        V.B,
        V.FOLDS,
        """SELECT split, label, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM (
             SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, label, group_id
             FROM a JOIN folds USING (group_id)
             UNION ALL SELECT 'b_labeled', label, group_id FROM b) GROUP BY ALL""",
    ),
)
def named_splits(spark, sf):
    a = T.survey_a(spark, sf)[0].select("group_id", "label", "quantity")
    b = T.survey_b(spark, sf)[0].select("group_id", "label")
    parts = splits.named_splits(a, b)
    return parts.groupBy("split", "label").agg(
        F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups")
    )


def _wide_c(spark, sf):
    """Survey C with a mostly missing and a constant column, after screening."""
    df = T.survey_c(spark, sf).select(
        "o_orderkey",
        "o_totalprice",
        "c_acctbal",
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("partial"),
        (F.col("o_custkey") * 0).cast("double").alias("flat"),
    )
    return screen.screen_physical(df, T.INTERVALS_C)


_C_COLS = ("o_totalprice", "c_acctbal", "partial", "flat")
_C_WIDE = """
cw AS (SELECT o_orderkey, CASE WHEN o_totalprice < 0 OR o_totalprice > 450000 THEN NULL ELSE o_totalprice END AS o_totalprice,
              CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
              CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS partial,
              CAST(o_custkey * 0 AS DOUBLE) AS flat FROM c)"""


def _profile_sql(source, columns):
    one = """SELECT '{c}' AS feature, count(*) AS n, 1.0 - count({c}) / CAST(count(*) AS DOUBLE) AS missing_rate,
      count(DISTINCT {c}) AS n_unique,
      (SELECT max(k) FROM (SELECT count(*) AS k FROM {s} WHERE {c} IS NOT NULL GROUP BY {c})) / CAST(count({c}) AS DOUBLE) AS top_value_frac,
      quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median,
      quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.99) AS p99,
      quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {s}"""
    return " UNION ALL ".join(one.format(c=c, s=source) for c in columns)


_PROFILE_NUM = ("missing_rate", "top_value_frac", "p01", "p25", "median", "p75", "p99", "iqr")


@query(
    "column_profile",
    with_ctes(
        V.C, _C_WIDE, f"prof AS ({_profile_sql('cw', _C_COLS)})", f"SELECT feature, n, n_unique, {r(*_PROFILE_NUM)} FROM prof"
    ),
)
def column_profile(spark, sf):
    return rounded(profile.column_profile(_wide_c(spark, sf), _C_COLS), *_PROFILE_NUM)


@query(
    "missing_constant_screen",
    with_ctes(
        V.C,
        _C_WIDE,
        f"prof AS ({_profile_sql('cw', _C_COLS)})",
        """SELECT feature, round(missing_rate, 6) AS missing_rate, n_unique,
                  CASE WHEN missing_rate > 0.5 THEN 'missing' ELSE 'constant' END AS reason
           FROM prof WHERE missing_rate > 0.5 OR n_unique <= 1""",
    ),
)
def missing_constant_screen(spark, sf):
    found = profile.drop_suggestions(profile.column_profile(_wide_c(spark, sf), _C_COLS))
    return rounded(found, "missing_rate")


@query(
    "null_counts",
    with_ctes(
        V.C,
        _C_WIDE,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{'bigint' if c == 'o_orderkey' else 'double'}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM cw"
            for c in ("o_orderkey", *_C_COLS)
        ),
    ),
)
def null_counts(spark, sf):
    return profile.null_counts(_wide_c(spark, sf))


def _hist_sql(source, columns, bins=20):
    one = """SELECT '{c}' AS feature, bin, lo + bin * ((hi - lo) / {b}) AS bin_lo,
        CASE WHEN bin = {b} - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {b}) END AS bin_hi, coalesce(k, 0) AS n
      FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
                   CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM {s}) AS lim
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range({b})) AS g
      LEFT JOIN (SELECT CAST(least(floor(({c} - l.lo) / ((l.hi - l.lo) / {b})), {b} - 1) AS INTEGER) AS bin, count(*) AS k
                 FROM {s}, (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
                   CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM {s}) AS l
                 WHERE {c} IS NOT NULL GROUP BY 1) AS h USING (bin)"""
    return " UNION ALL ".join(one.format(c=c, s=source, b=bins) for c in columns)


@query(
    "histogram",
    with_ctes(
        V.C, _C_WIDE, f"h AS ({_hist_sql('cw', _C_COLS)})", f"SELECT feature, bin, {r('bin_lo', 'bin_hi')}, n FROM h"
    ),
)
def histogram(spark, sf):
    return rounded(profile.histograms(_wide_c(spark, sf), _C_COLS), "bin_lo", "bin_hi")


def _skew_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) FROM {source}, "
        f"(SELECT avg({c}) AS m FROM {source})) AS skewness"
        for c in columns
    )


@query(
    "skewness",
    with_ctes(
        V.B_RAW,
        V.B,
        f"sk AS ({_skew_sql('b', ('amount', 'k'))})",
        """SELECT feature, round(skewness, 6) AS skewness,
             CASE WHEN skewness > 1 THEN 'right' WHEN skewness < -1 THEN 'left' ELSE 'none' END AS suggested FROM sk""",
    ),
)
def skewness(spark, sf):
    return rounded(profile.skewness(T.survey_b(spark, sf)[0], ("amount", "k")), "skewness")


@query("physical_screen", with_ctes(V.A_RAW, V.A, V.A_SCREENED, "SELECT row_id, group_id, label, quantity, price, discount, tax FROM s1"))
def physical_screen(spark, sf):
    return screen.screen_physical(T.survey_a(spark, sf)[0], T.INTERVALS_A)


def _screen_summary_sql(source, intervals):
    parts = []
    for c, (lo, hi) in intervals.items():
        tests = [f"{c} < {lo}"] * (lo is not None) + [f"{c} > {hi}"] * (hi is not None)
        parts.append(
            f"SELECT '{c}' AS feature, CAST({'NULL' if lo is None else lo} AS DOUBLE) AS lower, "
            f"CAST({'NULL' if hi is None else hi} AS DOUBLE) AS upper, "
            f"count(*) FILTER (WHERE {' OR '.join(tests)}) AS out_of_range_n, "
            f"round(count(*) FILTER (WHERE {' OR '.join(tests)}) / CAST(count(*) AS DOUBLE), 6) AS out_of_range_pct FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("physical_screen_summary", with_ctes(V.C, _screen_summary_sql("c", T.INTERVALS_C)))
def physical_screen_summary(spark, sf):
    return rounded(screen.screen_summary(T.survey_c(spark, sf), T.INTERVALS_C), "out_of_range_pct")


@query(
    "right_log",
    with_ctes(
        V.C,
        """SELECT o_orderkey, round(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE ln(1 + c_acctbal) END, 6) AS c_acctbal,
                  round(ln(1 + o_totalprice), 6) AS o_totalprice FROM c""",
    ),
)
def right_log(spark, sf):
    df = T.survey_c(spark, sf).select("o_orderkey", "c_acctbal", "o_totalprice")
    return rounded(screen.right_log(df, ["c_acctbal", "o_totalprice"]), "c_acctbal", "o_totalprice")


@query(
    "left_reflect_log",
    with_ctes(
        V.A_RAW,
        V.A,
        V.A_SCREENED,
        "m AS (SELECT max(discount) + 0.000001 AS top FROM s1)",
        "SELECT row_id, round(CASE WHEN top - discount < 0 THEN 0.0 ELSE ln(1 + (top - discount)) END, 6) AS discount FROM s1, m",
    ),
)
def left_reflect_log(spark, sf):
    df = screen.screen_physical(T.survey_a(spark, sf)[0], T.INTERVALS_A).select("row_id", "discount")
    return rounded(screen.left_reflect_log(df, ["discount"])[0], "discount")


def _fences_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, q[1] AS q1, q[2] AS q3, q[2] - q[1] AS iqr, q[1] - 1.5 * (q[2] - q[1]) AS lower_fence, "
        f"q[2] + 1.5 * (q[2] - q[1]) AS upper_fence, "
        f"(SELECT count(*) FROM {source} WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS outlier_n, "
        f"(SELECT count(*) FROM {source}) AS n FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {source})"
        for c in columns
    )


_FENCE_NUM = ("q1", "q3", "iqr", "lower_fence", "upper_fence", "outlier_pct")
_B_FENCES = f"f AS ({_fences_sql('b', ('amount', 'k'))})"


@query(
    "iqr_fences",
    with_ctes(
        V.B_RAW,
        V.B,
        _B_FENCES,
        "f2 AS (SELECT *, outlier_n / CAST(n AS DOUBLE) AS outlier_pct FROM f)",
        f"SELECT feature, outlier_n, {r(*_FENCE_NUM)} FROM f2",
    ),
)
def iqr_fences(spark, sf):
    df = T.survey_b(spark, sf)[0]
    return rounded(screen.iqr_summary(df, screen.fit_iqr_fences(df, columns=["amount", "k"])), *_FENCE_NUM)


@query(
    "iqr_clip",
    with_ctes(
        V.B_RAW,
        V.B,
        _B_FENCES,
        """w AS (SELECT max(lower_fence) FILTER (WHERE feature = 'amount') AS alo, max(upper_fence) FILTER (WHERE feature = 'amount') AS ahi,
                        max(lower_fence) FILTER (WHERE feature = 'k') AS klo, max(upper_fence) FILTER (WHERE feature = 'k') AS khi FROM f)""",
        """SELECT event_id, round(CASE WHEN amount < alo THEN alo WHEN amount > ahi THEN ahi ELSE amount END, 6) AS amount,
                  round(CASE WHEN k < klo THEN klo WHEN k > khi THEN khi ELSE k END, 6) AS k FROM b, w""",
    ),
)
def iqr_clip(spark, sf):
    df = T.survey_b(spark, sf)[0].select("event_id", "amount", "k")
    return rounded(screen.fit_and_clip(df, columns=["amount", "k"])[0], "amount", "k")


@query(
    "median_impute",
    with_ctes(
        V.C,
        V.C_SCREENED,
        "m AS (SELECT median(o_totalprice) AS mt, median(c_acctbal) AS ma FROM c1)",
        "SELECT o_orderkey, round(coalesce(o_totalprice, mt), 6) AS o_totalprice, round(coalesce(c_acctbal, ma), 6) AS c_acctbal FROM c1, m",
    ),
)
def median_impute(spark, sf):
    df = screen.screen_physical(T.survey_c(spark, sf), T.INTERVALS_C).select("o_orderkey", "o_totalprice", "c_acctbal")
    model = stages.MedianImputer(columns=["o_totalprice", "c_acctbal"]).fit(df)
    return rounded(model.transform(df), "o_totalprice", "c_acctbal")


@query(
    "standard_scale",
    with_ctes(
        V.C,
        "m AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(c_acctbal) AS m2, stddev_pop(c_acctbal) AS s2 FROM c)",
        "SELECT o_orderkey, round((o_totalprice - m1) / s1, 6) AS o_totalprice, round((c_acctbal - m2) / s2, 6) AS c_acctbal FROM c, m",
    ),
)
def standard_scale(spark, sf):
    df = T.survey_c(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    model = stages.Standardizer(columns=["o_totalprice", "c_acctbal"]).fit(df)
    return rounded(model.transform(df), "o_totalprice", "c_acctbal")


def prepared_a(spark, sf):
    """Survey A through all seven steps, fitted on the training part only."""
    labeled = splits.with_folds(T.survey_a(spark, sf)[0])
    labeled = labeled.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))
    labeled = written(labeled, "folds")  # each fitted step reads the training part
    model = stages.fit_preprocessing(
        labeled.where("split = 'train'"), T.SPEC_A, keep=["row_id", "group_id", "label", "split", "fold"], vector=None
    )
    return model.transform(labeled)


@query(
    "preprocess_stages",
    with_ctes(V.A_RAW, V.A, V.PREPARED, f"SELECT row_id, group_id, label, split, fold, {r(*A_COLS)} FROM p4"),
)
def preprocess_stages(spark, sf):
    return rounded(prepared_a(spark, sf), *A_COLS)


FLAGSHIP_WEIGHTS = {"quantity": 0.4, "price": -0.7, "discount": 0.3, "tax": 0.5, "": 0.05}


@query(
    "screened_split_metrics",
    with_ctes(
        V.A_RAW,
        V.A,
        V.PREPARED,
        f"d AS (SELECT split, label, CASE WHEN {V.score_sql(FLAGSHIP_WEIGHTS)} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM p4)",
        f"m AS (SELECT split, {V.COUNTS_SQL} FROM d GROUP BY split)",
        f"""SELECT split, tn, fp, fn, tp, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy,
              round({V.RECALL_SQL}, 6) AS recall, round({V.PRECISION_SQL}, 6) AS precision, round({V.F2_SQL}, 6) AS f2 FROM m""",
    ),
)
def screened_split_metrics(spark, sf):
    """Flagship: harmonise, split, screen, transform, score, evaluate."""
    scored = prepared_a(spark, sf).select(
        "split", "label", decide(T.stand_in_score(FLAGSHIP_WEIGHTS), 0.5).alias("prediction")
    )
    return rounded(with_metrics(confusion(scored, keys=["split"])), "accuracy", "recall", "precision", "f2")


def _pearson_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{columns[i]}' AS feature_i, '{columns[j]}' AS feature_j, "
        f"corr({columns[i]}, {columns[j]}) AS rho FROM {source} WHERE {columns[i]} IS NOT NULL AND {columns[j]} IS NOT NULL"
        for i in range(len(columns))
        for j in range(i + 1)
    )


def _spearman_sql(source, columns):
    def ranked(x, y):
        rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
        return (
            f"(SELECT {rank.format(x)} AS rx, {rank.format(y)} AS ry FROM {source} "
            f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
        )

    return " UNION ALL ".join(
        f"SELECT '{columns[i]}' AS feature_i, '{columns[j]}' AS feature_j, corr(rx, ry) AS rho FROM {ranked(columns[i], columns[j])}"
        for i in range(len(columns))
        for j in range(i + 1)
    )


@query(
    "pearson_matrix",
    with_ctes(
        V.A_RAW, V.A, V.A_SCREENED, f"p AS ({_pearson_sql('s1', A_COLS)})", "SELECT feature_i, feature_j, round(rho, 6) AS rho FROM p"
    ),
)
def pearson_matrix(spark, sf):
    return rounded(correlation.pearson(screen.screen_physical(T.survey_a(spark, sf)[0], T.INTERVALS_A), A_COLS), "rho")


def _spearman(spark, sf):
    df = screen.screen_physical(T.survey_a(spark, sf)[0], T.INTERVALS_A)
    return correlation.spearman(df, A_COLS, key="row_id")


_SPEARMAN_CTES = (V.A_RAW, V.A, V.A_SCREENED, f"p AS ({_spearman_sql('s1', A_COLS)})")


@query("spearman_matrix", with_ctes(*_SPEARMAN_CTES, "SELECT feature_i, feature_j, round(rho, 6) AS rho FROM p"))
def spearman_matrix(spark, sf):
    return rounded(_spearman(spark, sf), "rho")


@query(
    "correlated_pairs",
    with_ctes(
        *_SPEARMAN_CTES,
        "SELECT feature_i, feature_j, round(rho, 6) AS rho FROM p WHERE feature_i <> feature_j AND abs(rho) > 0.002",
    ),
)
def correlated_pairs(spark, sf):
    return rounded(correlation.correlated_pairs(_spearman(spark, sf), limit=0.002), "rho")


_VALIDATE = ("amount", "k")
_VALID_SQL = """
v AS (
  SELECT event_id, TRY_CAST(value AS DOUBLE) AS amount, TRY_CAST(k AS DOUBLE) AS k,
         concat_ws('; ',
           CASE WHEN value IS NULL THEN 'amount: value is required' END,
           CASE WHEN value < 1 THEN 'amount: ' || format('{:g}', value) || ' is below minimum 1' END,
           CASE WHEN value > 400 THEN 'amount: ' || format('{:g}', value) || ' is above maximum 400' END,
           CASE WHEN k IS NULL THEN 'k: value is required' END,
           CASE WHEN k IS NOT NULL AND TRY_CAST(k AS DOUBLE) IS NULL
                THEN 'k: expected numeric value, got ''' || k || '''' END,
           CASE WHEN TRY_CAST(k AS DOUBLE) > 95 THEN 'k: ' || format('{:g}', TRY_CAST(k AS DOUBLE)) || ' is above maximum 95' END
         ) AS errors
  FROM (SELECT event_id, value, CASE WHEN event_type = 'click' THEN event_type
                                     WHEN event_type = 'signup' THEN NULL
                                     ELSE json_extract_string(props, '$.k') END AS k FROM events))"""
VALIDATE_INTERVALS = {"amount": (1.0, 400.0), "k": (None, 95.0)}


def inputs_to_validate(events):
    """Events as unchecked inputs: text amounts, and a `k` that is a word or missing for some types."""
    kind = F.col("event_type")
    k = F.when(kind == "click", kind).when(kind != "signup", F.get_json_object("props", "$.k"))
    return events.select("event_id", "ts", F.col("value").cast("string").alias("amount"), k.alias("k"))


@query("validate_rows", with_ctes(_VALID_SQL, "SELECT event_id, amount, k, errors FROM v"))
def validate_rows(spark, sf):
    rows = inputs_to_validate(T.table(spark, sf, "events")).drop("ts")
    checked = validate.validate_rows(rows, features=_VALIDATE, intervals=VALIDATE_INTERVALS)
    return checked.withColumn("errors", F.concat_ws("; ", "errors"))


@query(
    "fill_defaults",
    with_ctes(
        V.A_RAW,
        V.A,
        V.A_SCREENED,
        """SELECT row_id, coalesce(quantity, 25.0) AS quantity, coalesce(price, 0.0) AS price,
                  round(coalesce(discount, 0.045), 6) AS discount, coalesce(tax, 0.07) AS tax FROM s1""",
    ),
)
def fill_defaults(spark, sf):
    df = screen.screen_physical(T.survey_a(spark, sf)[0], T.INTERVALS_A).select("row_id", *A_COLS)
    return rounded(validate.fill_defaults(df, features=A_COLS, intervals=T.INTERVALS_A), "discount")


@query(
    "background_sample",
    with_ctes(
        V.A_RAW,
        V.A,
        f"SELECT row_id, quantity, price, discount, tax FROM a ORDER BY md5('{SEED}:' || row_id), row_id LIMIT 200",
    ),
)
def background_sample(spark, sf):
    return splits.background_sample(T.survey_a(spark, sf)[0], features=A_COLS, key="row_id")


@query(
    "row_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey AS group_id FROM orders",
)
def row_numbers(spark, sf):
    df = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"))
    return records.numbered(df, order="o_orderkey")


@query(
    "first_record_of_group",
    """SELECT group_id, min(row_id) AS row_id FROM (
         SELECT o_custkey AS group_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders) GROUP BY group_id""",
)
def first_record_of_group(spark, sf):
    df = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"))
    return records.first_rows(records.numbered(df, order="o_orderkey"))


@query(
    "record_preview",
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey AS group_id FROM orders ORDER BY row_id LIMIT 500",
)
def record_preview(spark, sf):
    df = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"))
    return records.list_records(df, order=["o_orderkey"])


@query(
    "records_by_id",
    """SELECT row_id, o_totalprice FROM (
         SELECT o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)
       WHERE row_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def records_by_id(spark, sf):
    """P14 in batch: the numbered rows whose numbers another table asks for."""
    orders = T.table(spark, sf, "orders")
    table = records.numbered(orders.select("o_orderkey", "o_totalprice"), order="o_orderkey")
    asked = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("row_id"))
    return records.get_records(table, asked, features=["o_totalprice"])


@query(
    "saved_splits",
    with_ctes(
        V.A_RAW,
        V.A,
        V.B_RAW,
        V.B,
        V.FOLDS,
        """SELECT split, label, count(*) AS n_rows FROM (
             SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, label FROM a JOIN folds USING (group_id)
             UNION ALL SELECT 'b_labeled', label FROM b
             UNION ALL SELECT 'a_unlabeled', NULL FROM a_raw WHERE raw_label = 'CANDIDATE'
             UNION ALL SELECT 'b_unlabeled', NULL FROM b_raw WHERE raw_label = 'CANDIDATE' AND default_flag = 1) GROUP BY ALL""",
    ),
)
def saved_splits(spark, sf):
    """The five processed sets written as one partitioned table and read back."""
    (a, a_open), (b, b_open) = T.survey_a(spark, sf), T.survey_b(spark, sf)
    path = scratch_path(spark, "splits")
    catalogs.save_splits(splits.named_splits(a, b), a_open, b_open, path)
    return catalogs.load_table(spark, path).groupBy("split", "label").agg(F.count("*").alias("n_rows"))


_EXPLORE = ("o_totalprice", "c_acctbal", "partial")
_EXPLORE_TOP = 10_000.000001


@query(
    "exploratory_stages",
    with_ctes(
        V.C,
        _C_WIDE,
        f"""x AS (SELECT o_orderkey, ln(1 + o_totalprice) AS o_totalprice, ln(1 + ({_EXPLORE_TOP} - c_acctbal)) AS c_acctbal,
                    partial FROM cw)""",
        "q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS q_{c}" for c in _EXPLORE) + " FROM x)",
        "SELECT o_orderkey, "
        + ", ".join(
            f"round(CASE WHEN {c} < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) THEN q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) "
            f"WHEN {c} > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]) THEN q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]) ELSE {c} END, 6) AS {c}"
            for c in _EXPLORE
        )
        + " FROM x, q",
    ),
)
def exploratory_stages(spark, sf):
    """C17: drop the constant, screen, log, reflect at a fixed maximum, clip every column."""
    df = T.survey_c(spark, sf).select(
        "o_orderkey", "o_totalprice", "c_acctbal",
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("partial"),
        (F.col("o_custkey") * 0).cast("double").alias("flat"),
    )
    stages_ = stages.exploratory_pipeline(
        drop=["flat"], intervals=T.INTERVALS_C, right_skewed=["o_totalprice"], left_skewed=["c_acctbal"],
        reflection_max={"c_acctbal": _EXPLORE_TOP}, columns=list(_EXPLORE),
    )
    return rounded(stages_.fit(df).transform(df), *_EXPLORE)
