"""Queries that take the paths written for large tables, text keys, missing scores and files.

Each has the result of its plain form, so it shares that form's SQL where there is one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import metrics as M
from sieveline.operators import curves, deploy, harmonize, neighbors, profile, records, screen, thresholds
from sieveline.operators.evaluate import confusion
from sieveline.plans import evaluate_queries as E
from sieveline.plans import prepare_queries as P
from sieveline.plans import sql_views as V
from sieveline.plans import testbed as T
from sieveline.plans.evaluate_queries import rounded
from sieveline.plans.registry import ORACLES, query, with_ctes
from sieveline.session import scratch_path, written
from sieveline.sources import artifacts, catalogs

NARROWED = 500


@query("iqr_fences_narrowed", ORACLES["iqr_fences"])
def iqr_fences_narrowed(spark, sf):
    """Quantiles found by narrowing brackets, as for columns of hundreds of thousands of values."""
    df = T.survey_b(spark, sf)[0]
    fences = screen.fit_iqr_fences(df, columns=["amount", "k"], direct_rows=NARROWED)
    return rounded(screen.iqr_summary(df, fences), *P._FENCE_NUM)


@query("column_profile_narrowed", ORACLES["column_profile"])
def column_profile_narrowed(spark, sf):
    wide = written(P._wide_c(spark, sf).select(*P._C_COLS), "profiled")
    return rounded(profile.column_profile(wide, P._C_COLS, direct_rows=NARROWED), *P._PROFILE_NUM)


@query("knn_exact_blocks", ORACLES["knn_exact"])
def knn_exact_blocks(spark, sf):
    """Few pivots and small blocks: every cell is cut and its queries are sent in chunks."""
    rows = T.table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("label")
    )
    found = neighbors.nearest(
        rows, rows, k=E.K, query_id="vec_id", train_id="vec_id", vector="embedding", payload=["label"],
        exclude_same_id=True, pivots=8, block_rows=64,
    )
    return rounded(found, "distance")


@query(
    "row_numbers_text",
    """SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS row_id FROM orders""",
)
def row_numbers_text(spark, sf):
    """P13 by a text key of which each value fills a large part of the table."""
    orders = T.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return records.numbered(orders, order="o_orderstatus", ties=["o_orderkey"])


_GAPS = """
gaps AS (SELECT label, CASE WHEN CAST(split_part(row_id, '-', 2) AS INTEGER) % 7 < 2 THEN NULL ELSE score END AS score, model, dataset FROM scored),
known AS (SELECT * FROM gaps WHERE score IS NOT NULL),
per AS (SELECT model, dataset, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM known GROUP BY model, dataset, score),
runs AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model, dataset) AS p
         FROM per WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC)),
ap AS (SELECT model, dataset, round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / max(p), 6) AS average_precision FROM runs GROUP BY ALL),
d AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM known)"""


@query(
    "scores_missing",
    with_ctes(
        V.A_RAW, V.A, V.SCORED, _GAPS,
        f"SELECT model, dataset, {V.COUNTS_SQL}, any_value(average_precision) AS average_precision FROM d JOIN ap USING (model, dataset) GROUP BY model, dataset",
    ),
)
def scores_missing(spark, sf):
    """A5, A1, E9 where some scores are NULL and some NaN: curve and counts leave out the same rows."""
    part = F.split("row_id", "-")[1].cast("int") % 7
    gaps = F.when(part == 0, F.lit(float("nan"))).when(part > 1, F.col("score"))
    scored = written(E.scored_a(spark, sf).withColumn("score", gaps), "gaps")
    area = curves.ranking_metrics(scored, keys=E.KEYS).select(*E.KEYS, "average_precision")
    decided = scored.withColumn("prediction", thresholds.decide(F.col("score"), 0.5))
    counts = confusion(decided, keys=E.KEYS).select(*E.KEYS, *M.COUNTS)
    return rounded(counts.join(area, E.KEYS), "average_precision")


@query("harmonize_b_csv", ORACLES["harmonize_b"])
def harmonize_b_csv(spark, sf):
    """Catalogue B written as CSV, read back by column name and harmonised."""
    path = scratch_path(spark, "catalogue-b")
    catalogs.save_table(T.survey_b_raw(spark, sf), path, fmt="csv", header=True, escape='"')
    rows = catalogs.read_survey_b(spark, path)
    labeled = harmonize.prepare_survey(rows, T.MAP_B, unit_factors={"amount": 10000.0}, keep=("event_id",))[0]
    return rounded(labeled.withColumn("event_id", F.col("event_id").cast("long")), "amount", "k")


def _commented_csv(df, path):
    """CSV files that begin with comment lines above their header and hold one more among the rows."""
    header = ",".join(df.columns)

    def lines(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["# a catalogue", "# 1, 2, 3", header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([*batch.column(0).to_pylist(), "# so far"])], names=["value"])

    rows = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    rows.mapInArrow(lines, "value string").write.text(path)


@query("harmonize_a_csv", ORACLES["harmonize_a"])
def harmonize_a_csv(spark, sf):
    """Catalogue A as CSV files with comment lines, read by column name and harmonised."""
    path = scratch_path(spark, "catalogue-a")
    _commented_csv(T.survey_a_raw(spark, sf), path)
    return harmonize.prepare_survey(catalogs.read_survey_a(spark, path), T.MAP_A, keep=("row_id",))[0]


# the i-th measure of a standard catalogue, from columns of line items and of events
_MEASURES = [name for _, _, name in C.SURVEY_COLUMNS[2:]]
_KEPT = [m for m in _MEASURES if m not in C.DROP_MISSING]


@query(
    "standard_surveys",
    with_ctes(
        """ra AS (SELECT CAST(l_orderkey AS VARCHAR) AS g, l_returnflag AS k, l_quantity AS v FROM lineitem)""",
        """rb AS (SELECT CAST(user_id AS VARCHAR) AS g, event_type AS k, CAST(value AS DOUBLE) AS v FROM events WHERE value > 0)""",
        "parts AS ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS part, g, {label} AS label, v, {scale} AS scale FROM {source} WHERE k IN ({kinds})"
            for name, source, kinds, label, scale in (
                ("a_labeled", "ra", "'R', 'A'", "CASE k WHEN 'R' THEN 1 ELSE 0 END", 1.0),
                ("a_candidates", "ra", "'N'", "NULL", 1.0),
                ("b_labeled", "rb", "'purchase', 'error', 'signup'", "CASE k WHEN 'purchase' THEN 1 ELSE 0 END", C.PERCENT_TO_PPM),
                ("b_candidates", "rb", "'view'", "NULL", C.PERCENT_TO_PPM),
            )
        )
        + ")",
        f"""SELECT part, count(*) AS n_rows, count(DISTINCT g) AS n_groups, CAST(sum(label) AS BIGINT) AS n_positive, {len(_KEPT)} AS n_measures,
              round(sum(v * 1), 2) AS first_measure, round(sum(v * {_MEASURES.index("transit_depth") + 1}) * max(scale), 0) AS depth FROM parts GROUP BY part""",
    ),
)
def standard_surveys(spark, sf):
    """Both catalogues under their standard raw names, prepared with the standard settings."""
    items = T.survey_a_raw(spark, sf)
    raw_a = items.select(
        F.col("l_orderkey").alias("kepid"), F.col("disposition").alias("koi_disposition"),
        *[(F.col("l_quantity") * (i + 1)).alias(a) for i, (a, _, _) in enumerate(C.SURVEY_COLUMNS[2:])],
    )
    events = T.survey_b_raw(spark, sf)
    raw_b = events.select(
        F.col("user_id").alias("pl_name"), "disposition", C.PREFERRED_FLAG,
        *[(F.col("amount").cast("double") * (i + 1)).alias(b) for i, (_, b, _) in enumerate(C.SURVEY_COLUMNS[2:])],
    )
    out = None
    for part, df in harmonize.prepare_surveys(raw_a, raw_b).items():
        label = F.sum("label") if "label" in df.columns else F.lit(None)
        measures = [c for c in df.columns if c not in ("group_id", "label")]
        row = df.agg(
            F.lit(part).alias("part"), F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"),
            label.cast("long").alias("n_positive"), F.lit(len(measures)).alias("n_measures"),
            F.round(F.sum("orbital_period_days"), 2).alias("first_measure"), F.round(F.sum("transit_depth"), 0).alias("depth"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "metrics_of_one",
    f"SELECT * FROM ({ORACLES['evaluation_grid']}) WHERE model = 'm1' AND profile = 'f2' AND dataset IN ('test', 'all')",
)
def metrics_of_one(spark, sf):
    """P10: the comparison rows of one model and profile on some datasets."""
    return deploy.metric_rows(E.evaluation_grid(spark, sf), model="m1", profile="f2", datasets=["test", "all"])


@query(
    "importance_of_one",
    f"""SELECT * FROM ({ORACLES['permutation_importance']}) WHERE dataset = 'test' AND deploy_id = '{min(E._IMP_MODELS)}'
        ORDER BY importance_mean DESC, feature LIMIT 3""",
)
def importance_of_one(spark, sf):
    """The most important features of one deployment on one dataset."""
    return deploy.feature_importance(E.permutation_importance(spark, sf), deploy_id=min(E._IMP_MODELS), dataset="test", top_n=3)


_GROUPS = "SELECT CAST(l_returnflag AS VARCHAR) AS flag, count(*) AS n FROM lineitem GROUP BY 1"


@query("artifact_runs", f"{_GROUPS} HAVING count(*) > 0")
def artifact_runs(spark, sf):
    """Two runs of one table; rewriting the first leaves the second, which is read."""
    root = scratch_path(spark, "artifacts")
    counts = T.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    for tag, table in (("v1", counts), ("v2", counts), ("v1", counts.limit(0))):
        artifacts.write_artifact(table, root, "flags", run_tag=tag)
    nothing = artifacts.read_artifact(spark, root, "absent", schema="flag string, n long")
    return artifacts.read_artifact(spark, root, "flags", run_tag="v2").select("flag", "n").unionByName(nothing)


@query(
    "artifact_reuse",
    f"""WITH g AS ({_GROUPS}) SELECT CAST(step AS INTEGER) AS step, reused, (SELECT count(*) FROM g) AS n_rows
        FROM (VALUES (0, false), (1, true), (2, false), (3, true), (4, false)) AS s(step, reused)""",
)
def artifact_reuse(spark, sf):
    """Built, reused, rebuilt for another configuration, reused unchecked, forced."""
    root = scratch_path(spark, "reuse")
    counts = T.table(spark, sf, "lineitem").groupBy("l_returnflag").count()
    calls = [({"a": 1, "b": {2, 3}}, {}), ({"b": {3, 2}, "a": 1}, {}), ({"a": 2}, {}), ({"a": 3}, {"check": False}), ({"a": 2}, {"force": True})]
    out = None
    for step, (config, how) in enumerate(calls):
        table, reused = artifacts.materialize_or_reuse(spark, root, "flags", config, lambda: counts, **how)
        row = table.agg(F.lit(step).alias("step"), F.lit(reused).alias("reused"), F.count("*").alias("n_rows"))
        row = written(row, "reuse-step")  # the next call may replace the table
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "reuse_on_change",
    """WITH n AS (SELECT count(*) AS n FROM orders)
       SELECT CAST(step AS INTEGER) AS step, what, reused, (SELECT n FROM n) AS n_rows FROM (VALUES
         (0, 'new', false), (1, 'same rows in another order', true), (2, 'one value changed', false), (3, 'unchecked', true),
         (4, 'forced', false), (5, 'same again', true)) AS s(step, what, reused)""",
)
def reuse_on_change(spark, sf):
    """The rows' fingerprint decides whether a result is built anew."""
    root = scratch_path(spark, "reuse")
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == least, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    dealt = orders.repartition(7, "o_totalprice").sortWithinPartitions(F.desc("o_orderkey"))
    steps = [
        ("new", orders, {}), ("same rows in another order", dealt, {}), ("one value changed", changed, {}),
        ("unchecked", orders, {"check": False}), ("forced", orders, {"force": True}), ("same again", dealt, {}),
    ]
    out = None
    for step, (what, rows, how) in enumerate(steps):
        asked = {"rows": artifacts.fingerprint(rows)}
        table, reused = artifacts.materialize_or_reuse(spark, root, "orders", asked, lambda rows=rows: rows, **how)
        row = table.agg(F.lit(step).alias("step"), F.lit(what).alias("what"), F.lit(reused).alias("reused"), F.count("*").alias("n_rows"))
        row = written(row, "reuse-step")  # the next call may replace the table
        out = row if out is None else out.unionByName(row)
    return out


@query("evaluation_union", """
WITH a AS (SELECT l_quantity AS quantity, l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS s FROM lineitem),
u AS (SELECT CASE s WHEN 'O' THEN 'first' ELSE 'second' END AS dataset, * FROM a UNION ALL SELECT 'both', * FROM a)
SELECT dataset, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(sum(quantity), 2) AS quantity FROM u GROUP BY dataset""")
def evaluation_union(spark, sf):
    """Both evaluation sets and their union from one pass over each."""
    rows = T.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), "l_linestatus",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )
    sets = harmonize.evaluation_sets(
        rows.where("l_linestatus = 'O'"), rows.where("l_linestatus <> 'O'"), features=["quantity", "tax"], label="label",
        names=("first", "second", "both"),
    )
    sums = sets.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.sum("quantity").alias("quantity"))
    return rounded(sums.withColumn("quantity", F.col("quantity").cast("double")), "quantity")
