"""Metrics, curves, thresholds, manifests, importance, attribution and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.config import SEED
from sieveline.functions import metrics as M
from sieveline.operators import curves, deploy, evaluate, explain, importance, neighbors, probing, splits, thresholds, trees
from sieveline.models.stages import fit_preprocessing
from sieveline.operators.harmonize import combine_sets
from sieveline.plans import sql_views as V
from sieveline.plans import testbed as T
from sieveline.plans.prepare_queries import A_COLS, FLAGSHIP_WEIGHTS, prepared_a, r, rounded
from sieveline.plans.registry import query, with_ctes
from sieveline.session import local_frame, written


def folded_a(spark, sf):
    return splits.with_folds(T.survey_a(spark, sf)[0])


def scored_a(spark, sf):
    """(row_id, fold, dataset, model, score, label) for both stand-in models."""
    df = folded_a(spark, sf).withColumn("dataset", F.when(F.col("fold") == 0, "test").otherwise("train"))
    return T.scored_long(df, keep=("row_id", "fold", "dataset", "label"))


def score_table(spark, sf):
    """The scores as a written table: curves and tuning read them several times."""
    return written(scored_a(spark, sf).select("model", "dataset", "fold", "score", "label"), "scores")


SCORED = (V.A_RAW, V.A, V.SCORED)
KEYS = ["model", "dataset"]
_AT_HALF = "d AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"
_COUNTS = f"m AS (SELECT model, dataset, {V.COUNTS_SQL} FROM d GROUP BY model, dataset)"


def _at_half(spark, sf):
    return scored_a(spark, sf).withColumn("prediction", thresholds.decide(F.col("score"), 0.5))


@query(
    "confusion",
    with_ctes(
        *SCORED,
        _AT_HALF,
        """k AS (SELECT model, dataset, label AS actual, prediction AS predicted, count(*) AS c FROM d GROUP BY ALL)""",
        """g AS (SELECT model, dataset, actual, predicted, coalesce(c, 0) AS n
                 FROM (SELECT DISTINCT model, dataset FROM d) AS md
                 CROSS JOIN (SELECT unnest([0, 1]) AS actual) CROSS JOIN (SELECT unnest([0, 1]) AS predicted)
                 LEFT JOIN k USING (model, dataset, actual, predicted))""",
        """SELECT norm, model, dataset, actual, predicted, n,
             round(CASE norm WHEN 'all' THEN n / CAST(sum(n) OVER (PARTITION BY norm, model, dataset) AS DOUBLE)
               WHEN 'true' THEN n / CAST(sum(n) OVER (PARTITION BY norm, model, dataset, actual) AS DOUBLE)
               ELSE n / CAST(sum(n) OVER (PARTITION BY norm, model, dataset, predicted) AS DOUBLE) END, 6) AS share
           FROM g CROSS JOIN (SELECT unnest(['all', 'true', 'pred']) AS norm)""",
    ),
)
def confusion(spark, sf):
    counts = T.fixed_small(evaluate.confusion(_at_half(spark, sf), keys=KEYS))
    out = None
    for norm in ("all", "true", "pred"):
        part = evaluate.confusion_table(counts, keys=KEYS, normalize=norm).withColumn("norm", F.lit(norm))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "share")


@query(
    "prf_metrics",
    with_ctes(
        *SCORED,
        _AT_HALF,
        _COUNTS,
        f"""SELECT model, dataset, tn, fp, fn, tp, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy,
              round({V.RECALL_SQL}, 6) AS recall, round({V.PRECISION_SQL}, 6) AS precision, round({V.F2_SQL}, 6) AS f2 FROM m""",
    ),
)
def prf_metrics(spark, sf):
    table = evaluate.with_metrics(evaluate.confusion(_at_half(spark, sf), keys=KEYS))
    return rounded(table, "accuracy", "recall", "precision", "f2")


@query(
    "floor_objectives",
    with_ctes(
        *SCORED,
        _AT_HALF,
        _COUNTS,
        f"q AS (SELECT *, {V.RECALL_SQL} AS rec, {V.PRECISION_SQL} AS prec FROM m)",
        """SELECT model, dataset, floor, round(CASE WHEN prec >= floor THEN rec ELSE 0 END, 6) AS recall_at_precision,
                  round(CASE WHEN rec >= floor THEN prec ELSE 0 END, 6) AS precision_at_recall
           FROM q CROSS JOIN (SELECT CAST(unnest([0.4, 0.5, 0.6, 0.9]) AS DOUBLE) AS floor)""",
    ),
)
def floor_objectives(spark, sf):
    counts, c = evaluate.confusion(_at_half(spark, sf), keys=KEYS), M.Counts.named()
    cells = [
        F.struct(
            F.lit(x).alias("floor"),
            M.recall_at_precision(x)(c).alias("recall_at_precision"),
            M.precision_at_recall(x)(c).alias("precision_at_recall"),
        )
        for x in (0.4, 0.5, 0.6, 0.9)
    ]
    return rounded(counts.select(*KEYS, F.inline(F.array(*cells))), "recall_at_precision", "precision_at_recall")


_RUN = """
sc AS (SELECT model, dataset, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM scored GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
               sum(pos) OVER (PARTITION BY model, dataset) AS p, sum(neg) OVER (PARTITION BY model, dataset) AS n
        FROM sc WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC))"""


@query(
    "average_precision",
    with_ctes(
        *SCORED,
        _RUN,
        """SELECT model, dataset, round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / max(p), 6) AS average_precision
           FROM run GROUP BY model, dataset""",
    ),
)
def average_precision(spark, sf):
    return rounded(curves.ranking_metrics(score_table(spark, sf), keys=KEYS).drop("roc_auc"), "average_precision")


@query(
    "roc_auc",
    with_ctes(
        *SCORED,
        _RUN,
        """SELECT model, dataset, round(sum(neg * (cp - pos / 2.0)) / (CAST(max(p) AS DOUBLE) * max(n)), 6) AS roc_auc
           FROM run GROUP BY model, dataset""",
    ),
)
def roc_auc(spark, sf):
    return rounded(curves.ranking_metrics(score_table(spark, sf), keys=KEYS).drop("average_precision"), "roc_auc")


@query(
    "roc_points",
    with_ctes(
        *SCORED,
        _RUN,
        """SELECT model, dataset, score AS threshold, round(cn / CAST(n AS DOUBLE), 6) AS fpr, round(cp / CAST(p AS DOUBLE), 6) AS tpr
           FROM run
           UNION ALL SELECT DISTINCT model, dataset, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM scored""",
    ),
)
def roc_points(spark, sf):
    points = curves.roc_points(score_table(spark, sf), keys=KEYS)
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return rounded(points.withColumn("threshold", finite), "fpr", "tpr")


@query(
    "pr_points",
    with_ctes(
        *SCORED,
        _RUN,
        """SELECT model, dataset, score AS threshold, round(cp / CAST(cp + cn AS DOUBLE), 6) AS precision,
                  round(cp / CAST(p AS DOUBLE), 6) AS recall, round(p / CAST(p + n AS DOUBLE), 6) AS prevalence FROM run""",
    ),
)
def pr_points(spark, sf):
    return rounded(curves.pr_points(score_table(spark, sf), keys=KEYS), "precision", "recall", "prevalence")


_OBJECTIVES = f"""
obj AS (SELECT *, {V.F2_SQL} AS best_f2,
  CASE WHEN {V.PRECISION_SQL} >= 0.5 THEN {V.RECALL_SQL} ELSE 0.0 END AS best_recall_constrained,
  CASE WHEN {V.RECALL_SQL} >= 0.5 THEN {V.PRECISION_SQL} ELSE 0.0 END AS best_precision_constrained
  FROM curve)"""

_CURVE = (
    """
lim AS (SELECT model, fold, min(score) AS lo, max(score) AS hi FROM scored GROUP BY model, fold),
grid AS (SELECT model, fold, lo, hi, CAST(j AS INTEGER) AS idx, CASE WHEN j = 99 THEN hi ELSE lo + j * ((hi - lo) / 99.0) END AS threshold
         FROM lim CROSS JOIN range(100) AS g(j)),
curve AS (
  SELECT model, fold, idx, threshold,
         count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
         count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp
  FROM grid JOIN scored USING (model, fold) GROUP BY model, fold, idx, threshold),"""
    + _OBJECTIVES
)
_OBJ = ("best_f2", "best_recall_constrained", "best_precision_constrained")


@query("threshold_curve", with_ctes(*SCORED, _CURVE, f"SELECT model, fold, idx, tn, fp, fn, tp, {r('threshold', *_OBJ)} FROM obj"))
def threshold_curve(spark, sf):
    return rounded(thresholds.threshold_curve(score_table(spark, sf), keys=["model", "fold"]), "threshold", *_OBJ)


_TUNED = (
    _CURVE
    + """,
long AS ("""
    + " UNION ALL ".join(f"SELECT model, fold, idx, threshold, '{p}' AS profile, {p} AS v FROM obj" for p in _OBJ)
    + """),
span AS (SELECT model, min(lo) AS glo, max(hi) AS ghi FROM lim GROUP BY model),
common AS (SELECT model, fold, lo, hi, CAST(j AS INTEGER) AS idx, CASE WHEN j = 99 THEN ghi ELSE glo + j * ((ghi - glo) / 99.0) END AS x
           FROM lim JOIN span USING (model) CROSS JOIN range(100) AS g(j)),
placed AS (SELECT *, (x - lo) / ((hi - lo) / 99.0) AS pos,
                  CAST(least(greatest(floor((x - lo) / ((hi - lo) / 99.0)), 0), 98) AS INTEGER) AS j FROM common),
inter AS (SELECT p.model, p.fold, p.idx, p.x, a.profile,
                 CASE WHEN x <= lo THEN f.v WHEN x >= hi THEN l.v ELSE a.v + (b.v - a.v) * (pos - j) END AS v
          FROM placed p JOIN long a ON a.model = p.model AND a.fold = p.fold AND a.idx = p.j
          JOIN long b ON b.model = p.model AND b.fold = p.fold AND b.idx = p.j + 1 AND b.profile = a.profile
          JOIN long f ON f.model = p.model AND f.fold = p.fold AND f.idx = 0 AND f.profile = a.profile
          JOIN long l ON l.model = p.model AND l.fold = p.fold AND l.idx = 99 AND l.profile = a.profile),
mean AS (SELECT model, profile, idx, min(x) AS threshold, round(avg(v), 12) AS v FROM inter GROUP BY model, profile, idx),
tuned AS (SELECT model, profile, threshold AS best_threshold, v AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY model, profile ORDER BY v DESC, idx) AS k FROM mean) WHERE k = 1)"""
)


def tuned_a(scored):
    return thresholds.tune_thresholds(scored.select("model", "fold", "score", "label"))


@query("threshold_tuning", with_ctes(*SCORED, _TUNED, f"SELECT model, profile, {r('best_threshold', 'best_score')} FROM tuned"))
def threshold_tuning(spark, sf):
    return rounded(tuned_a(score_table(spark, sf)), "best_threshold", "best_score")


@query(
    "threshold_list",
    with_ctes(
        *SCORED,
        """curve AS (
             SELECT model, fold, threshold,
               count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
               count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp
             FROM scored CROSS JOIN (SELECT CAST(unnest([0.2, 0.35, 0.5, 0.65, 0.8]) AS DOUBLE) AS threshold)
             GROUP BY model, fold, threshold)""",
        _OBJECTIVES,
        "long AS (" + " UNION ALL ".join(f"SELECT model, threshold, '{p}' AS profile, {p} AS v FROM obj" for p in _OBJ) + ")",
        "mean AS (SELECT model, profile, threshold, round(avg(v), 12) AS v FROM long GROUP BY ALL)",
        """SELECT model, profile, threshold AS best_threshold, round(v, 6) AS best_score FROM (
             SELECT *, row_number() OVER (PARTITION BY model, profile ORDER BY v DESC, threshold) AS k FROM mean) WHERE k = 1""",
    ),
)
def threshold_list(spark, sf):
    scored = score_table(spark, sf)
    return rounded(thresholds.tune_thresholds(scored, thresholds=[0.2, 0.35, 0.5, 0.65, 0.8]), "best_score")


_GRID = (
    _TUNED
    + f""",
pooled AS (SELECT model, dataset, score, label FROM scored UNION ALL SELECT model, 'all', score, label FROM scored),
cut AS (SELECT model, replace(profile, 'best_', '') AS profile, best_threshold AS threshold FROM tuned),
dec AS (SELECT model, profile, threshold, dataset, label, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS prediction
        FROM pooled JOIN cut USING (model)),
cnt AS (SELECT model, profile, threshold, dataset, {V.COUNTS_SQL} FROM dec GROUP BY model, profile, threshold, dataset),
bsc AS (SELECT model, dataset, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM pooled GROUP BY ALL),
brun AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                sum(pos) OVER (PARTITION BY model, dataset) AS p, sum(neg) OVER (PARTITION BY model, dataset) AS n
         FROM bsc WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC)),
area AS (SELECT model, dataset, sum(pos * cp / CAST(cp + cn AS DOUBLE)) / max(p) AS pr_auc,
                sum(neg * (cp - pos / 2.0)) / (CAST(max(p) AS DOUBLE) * max(n)) AS roc_auc FROM brun GROUP BY model, dataset),
eval AS (SELECT model, profile, threshold, dataset, tn, fp, fn, tp, {V.RECALL_SQL} AS recall, {V.PRECISION_SQL} AS precision,
                {V.F2_SQL} AS f2, pr_auc, roc_auc, (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy
         FROM cnt JOIN area USING (model, dataset))"""
)
_EVAL_NUM = ("threshold", "recall", "precision", "f2", "pr_auc")


def grid_a(spark, sf):
    scored = score_table(spark, sf)
    tuned = T.fixed_small(tuned_a(scored))
    return tuned, evaluate.evaluation_grid(scored.select("model", "dataset", "score", "label"), tuned, combined="all")


@query("evaluation_grid", with_ctes(*SCORED, _GRID, f"SELECT model, profile, dataset, tn, fp, fn, tp, {r(*_EVAL_NUM)} FROM eval"))
def evaluation_grid(spark, sf):
    return rounded(grid_a(spark, sf)[1], *_EVAL_NUM)


@query(
    "comparison_table",
    with_ctes(
        *SCORED,
        _GRID,
        f"SELECT model, profile, {r(*_EVAL_NUM)}, tn, fp, fn, tp, dataset FROM eval ORDER BY dataset, profile, eval.f2 DESC, model",
    ),
)
def comparison_table(spark, sf):
    return rounded(evaluate.comparison_table(grid_a(spark, sf)[1]), *_EVAL_NUM)


SELECTION = (
    {"deploy_id": "deploy_f2", "model": "m1", "profile": "f2"},
    {"deploy_id": "deploy_precision", "model": "m1", "profile": "precision_constrained"},
    {"deploy_id": "deploy_recall", "model": "m2", "profile": "recall_constrained"},
)
_SELECTION_SQL = "sel(deploy_id, model, profile) AS (VALUES " + ", ".join(
    f"('{s['deploy_id']}', '{s['model']}', '{s['profile']}')" for s in SELECTION
) + ")"
_MANIFEST = ("threshold", *[f"{p}_{m}" for p in ("test", "train") for m in deploy.MANIFEST_METRICS])
_MANIFEST_SQL = (
    "man AS (SELECT deploy_id, model, profile, threshold, "
    + ", ".join(
        f"max({m}) FILTER (WHERE dataset = '{p}') AS {p}_{m}" for p in ("test", "train") for m in deploy.MANIFEST_METRICS
    )
    + " FROM sel JOIN eval USING (model, profile) GROUP BY ALL)"
)


@query("deploy_manifest", with_ctes(*SCORED, _GRID, _SELECTION_SQL, _MANIFEST_SQL, f"SELECT deploy_id, model, profile, {r(*_MANIFEST)} FROM man"))
def deploy_manifest(spark, sf):
    tuned, grid = grid_a(spark, sf)
    table = deploy.deploy_manifest(tuned, grid, SELECTION, datasets={"test": "test", "train": "train"})
    return rounded(table, *_MANIFEST)


_DIAG = ("threshold", "accuracy", "recall", "precision", "f2", "roc_auc", "average_precision")


@query(
    "diagnostics",
    with_ctes(
        *SCORED,
        _GRID,
        _SELECTION_SQL,
        "dg AS (SELECT *, pr_auc AS average_precision FROM sel JOIN eval USING (model, profile) WHERE dataset <> 'all')",
        f"""SELECT 'v1' AS run_tag, deploy_id, model AS model_name, profile, dataset, 1 AS positive_label, 0 AS negative_label,
              {r(*_DIAG)} FROM dg""",
    ),
)
def diagnostics(spark, sf):
    scored = score_table(spark, sf)
    rows = deploy.resolve_selection(tuned_a(scored), SELECTION)
    registry = local_frame(spark, rows, "deploy_id string, model_name string, profile string, threshold double")
    return rounded(evaluate.diagnostics(scored, registry), *_DIAG)


@query(
    "selection_without_threshold",
    with_ctes(
        *SCORED,
        "wanted AS (SELECT DISTINCT model, 'profile_' || dataset AS profile FROM scored UNION SELECT DISTINCT model, 'f2' FROM scored)",
        "SELECT model, profile FROM wanted WHERE profile <> 'f2'",
    ),
)
def selection_without_threshold(spark, sf):
    """Anti join of J2: selections whose profile was never tuned."""
    scored = score_table(spark, sf)
    wanted = scored.select("model", F.concat(F.lit("profile_"), "dataset").alias("profile")).distinct()
    wanted = wanted.union(scored.select("model", F.lit("f2")).distinct())
    return deploy.unmatched_selection(wanted, tuned_a(scored))


@query("dataset_names", with_ctes(*SCORED, "SELECT DISTINCT dataset FROM scored ORDER BY 1"))
def dataset_names(spark, sf):
    return deploy.distinct_values(scored_a(spark, sf), "dataset")


@query(
    "class_weights",
    """SELECT doc_id, n_chars, quality, round(sum(1) OVER () / (2.0 * count(*) OVER (PARTITION BY quality)), 6) AS weight
       FROM labels JOIN documents USING (doc_id)""",
)
def class_weights(spark, sf):
    rows = T.table(spark, sf, "labels").select("doc_id", "quality").join(
        T.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    weights = splits.class_weights(rows, target="quality")
    weight = F.when(F.col("quality") == 1, F.lit(weights.get(1))).otherwise(F.lit(weights.get(0)))
    return rounded(rows.withColumn("weight", weight), "weight")


@query(
    "score_threshold",
    with_ctes(
        V.A_RAW,
        V.A,
        V.PREPARED,
        f"sc AS (SELECT row_id, {V.score_sql(FLAGSHIP_WEIGHTS)} AS score FROM p4)",
        """SELECT row_id, score AS probability_positive, round(1 - score, 6) AS probability_negative,
             round(score - 0.55, 6) AS margin, CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS prediction FROM sc""",
    ),
)
def score_threshold(spark, sf):
    s = F.col("probability_positive")
    scored = prepared_a(spark, sf).select("row_id", T.stand_in_score(FLAGSHIP_WEIGHTS).alias("probability_positive"))
    return scored.select(
        "row_id",
        "probability_positive",
        F.round(1 - s, 6).alias("probability_negative"),
        F.round(s - 0.55, 6).alias("margin"),
        thresholds.decide(s, 0.55).alias("prediction"),
    )


REPEATS = 20


def _step_sql(n, repeat):
    return "CASE " + " ".join(f"WHEN {n} % {p} <> 0 THEN {p}" for p in importance.step_order(repeat)) + " END"


def _maps_sql(n):
    return "CASE rep " + " ".join(f"WHEN {i} THEN {_step_sql(n, i)}" for i in range(REPEATS)) + " END"


@query(
    "column_permutation",
    with_ctes(
        V.A_RAW,
        V.A,
        f"""ids AS (SELECT row_id, price, row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS idx,
                    count(*) OVER () AS n FROM a)""",
        f"""par AS (SELECT row_id, rep, ({_maps_sql('n')} * idx + CAST(rep + 1 AS BIGINT) * {(SEED + 1) * importance.SHIFT} % n) % n AS donor
                    FROM ids CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range({REPEATS})))""",
        "SELECT par.row_id, rep AS repeat, ids.price FROM par JOIN ids ON ids.idx = par.donor",
    ),
)
def column_permutation(spark, sf):
    return importance.permute_column(T.survey_a(spark, sf)[0], "price", key="row_id", repeats=REPEATS)


_IMP_MODELS = {"deploy_f2": ("m1", "f2", 0.5), "deploy_recall": ("m2", "recall_constrained", 0.45)}
_METRIC_SQL = {"f2": V.F2_SQL, "recall": V.RECALL_SQL, "precision": V.PRECISION_SQL}


#: Rows of a block where importance is shuffled within blocks: several blocks also in small tables.
BLOCK_ROWS = 500

_WHOLE_SHUFFLE = (
    f"""ids AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS idx,
                      count(*) OVER (PARTITION BY dataset) AS n FROM sets)""",
    f"""par AS (SELECT *, ({_maps_sql('n')} * idx + CAST(rep + 1 AS BIGINT) * {(SEED + 1) * importance.SHIFT} % n) % n AS donor
                    FROM ids CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range({REPEATS})))""",
    "met AS (SELECT par.*, "
    + ", ".join(f"ids.{f} AS d_{f}" for f in A_COLS)
    + " FROM par JOIN ids ON ids.dataset = par.dataset AND ids.idx = par.donor)",
)
_BLOCK_SHUFFLE = (
    f"""hashed AS (SELECT *, md5('{SEED}:' || row_id) AS h,
                      CAST(ceil(count(*) OVER (PARTITION BY dataset) / {BLOCK_ROWS}.0) AS BIGINT) AS n_blocks FROM sets)""",
    "dealt AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % n_blocks AS block FROM hashed)",
    """ids AS (SELECT *, row_number() OVER (PARTITION BY dataset, block ORDER BY h, row_id) - 1 AS idx,
                      count(*) OVER (PARTITION BY dataset, block) AS n FROM dealt)""",
    f"""par AS (SELECT *, ({_maps_sql('n')} * idx
                      + (CAST(rep + 1 AS BIGINT) * {(SEED + 1) * importance.SHIFT} + block * {importance.SHIFT}) % n) % n AS donor
                    FROM ids CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range({REPEATS})))""",
    "met AS (SELECT par.*, "
    + ", ".join(f"ids.{f} AS d_{f}" for f in A_COLS)
    + " FROM par JOIN ids ON ids.dataset = par.dataset AND ids.block = par.block AND ids.idx = par.donor)",
)


def _importance_sql(shuffle=_WHOLE_SHUFFLE):
    parts = []
    for deploy_id, (model, profile, cut) in _IMP_MODELS.items():
        variants = " UNION ALL ".join(
            f"SELECT dataset, rep, label, '{f}' AS feature, CASE WHEN "
            + V.score_sql(T.SCORES_A[model]).replace(f"* {f}", f"* d_{f}")
            + f" >= {cut} THEN 1 ELSE 0 END AS prediction FROM met"
            for f in A_COLS
        )
        metric = M.importance_metric(profile)
        parts.append(
            f"""SELECT '{deploy_id}' AS deploy_id, '{model}' AS model_name, '{profile}' AS profile, CAST({cut} AS DOUBLE) AS threshold,
                  dataset, feature, avg(base - s) AS importance_mean, stddev_pop(base - s) AS importance_std, '{metric}' AS scoring
                FROM (SELECT dataset, feature, rep, {_METRIC_SQL[metric]} AS s FROM (
                        SELECT dataset, feature, rep, {V.COUNTS_SQL} FROM ({variants}) GROUP BY dataset, feature, rep))
                JOIN (SELECT dataset, {_METRIC_SQL[metric]} AS base FROM (
                        SELECT dataset, {V.COUNTS_SQL} FROM (SELECT dataset, label, CASE WHEN {V.score_sql(T.SCORES_A[model])} >= {cut}
                          THEN 1 ELSE 0 END AS prediction FROM sets) GROUP BY dataset)) USING (dataset)
                GROUP BY dataset, feature"""
        )
    return (
        V.A_RAW,
        V.A,
        V.FOLDS,
        """sets AS (SELECT a.*, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS dataset FROM a JOIN folds USING (group_id)
                    UNION ALL SELECT a.*, 'all' FROM a)""",
        *shuffle,
        f"imp0 AS ({' UNION ALL '.join(parts)})",
        """imp AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY deploy_id, dataset ORDER BY importance_mean DESC) AS INTEGER) AS importance_rank,
                   CAST(20 AS INTEGER) AS n_repeats FROM (SELECT deploy_id, model_name, profile, threshold, dataset, feature, scoring,
                      round(importance_mean, 9) AS importance_mean, round(importance_std, 9) AS importance_std FROM imp0))""",
    )


def importance_a(spark, sf, block_rows=None):
    df = written(folded_a(spark, sf), "folds")
    sets = combine_sets(
        {"test": df.where("fold = 0"), "train": df.where("fold <> 0")}, combined="all"
    ).select("dataset", "row_id", *A_COLS, "label")
    deployments = {
        d: {
            "model_name": m,
            "profile": p,
            "threshold": t,
            "score": lambda frame, w=T.SCORES_A[m]: frame.withColumn("score", T.stand_in_score(w)),
        }
        for d, (m, p, t) in _IMP_MODELS.items()
    }
    return importance.permutation_importance(sets, deployments, key="row_id", features=A_COLS, n_repeats=REPEATS, block_rows=block_rows)


@query(
    "permutation_importance",
    with_ctes(
        *_importance_sql(),
        """SELECT deploy_id, model_name, profile, threshold, dataset, feature, round(importance_mean, 6) AS importance_mean,
             round(importance_std, 6) AS importance_std, n_repeats, scoring, importance_rank FROM imp""",
    ),
)
def permutation_importance(spark, sf):
    return rounded(importance_a(spark, sf), "importance_mean", "importance_std")


@query(
    "importance_in_blocks",
    with_ctes(
        *_importance_sql(_BLOCK_SHUFFLE),
        """SELECT deploy_id, model_name, profile, threshold, dataset, feature, round(importance_mean, 6) AS importance_mean,
             round(importance_std, 6) AS importance_std, n_repeats, scoring, importance_rank FROM imp""",
    ),
)
def importance_in_blocks(spark, sf):
    return rounded(importance_a(spark, sf, block_rows=BLOCK_ROWS), "importance_mean", "importance_std")


@query(
    "importance_matrix",
    with_ctes(
        *_importance_sql(),
        "SELECT feature, "
        + ", ".join(
            f"round(max(importance_mean) FILTER (WHERE deploy_id = '{d}' AND dataset = '{s}'), 6) AS {d}__{s}"
            for d in _IMP_MODELS
            for s in ("test", "train", "all", "none")
        )
        + " FROM imp GROUP BY feature",
    ),
)
def importance_matrix(spark, sf):
    sets = ("test", "train", "all", "none")
    table = deploy.importance_matrix(importance_a(spark, sf), deploy_ids=list(_IMP_MODELS), datasets=sets, features=A_COLS)
    return rounded(table, *[f"{d}__{s}" for d in _IMP_MODELS for s in sets])


@query(
    "top_features",
    with_ctes(
        *_importance_sql(),
        """SELECT deploy_id, dataset, feature, round(importance_mean, 6) AS importance_mean FROM (
             SELECT *, row_number() OVER (PARTITION BY deploy_id, dataset ORDER BY importance_mean DESC, feature) AS k FROM imp) WHERE k <= 2""",
    ),
)
def top_features(spark, sf):
    # equal importances are told apart by name, so they are compared in cells of 1e-9
    table = importance_a(spark, sf).withColumn("importance_mean", F.round("importance_mean", 9))
    top = deploy.top_features(table, top_n=2).select("deploy_id", "dataset", "feature", "importance_mean")
    return rounded(top, "importance_mean")


_W = FLAGSHIP_WEIGHTS
_W_BASE = " + ".join([str(_W[""])] + [f"({_W[f]}) * b_{f}" for f in A_COLS])


_LINEAR_CTES = (
    V.A_RAW,
    V.A,
    V.PREPARED,
    f"bg AS (SELECT * FROM p4 ORDER BY md5('{SEED}:' || row_id), row_id LIMIT 200)",
    "mb AS (SELECT " + ", ".join(f"avg({f}) AS b_{f}" for f in A_COLS) + " FROM bg)",
    "lin AS ("
    + " UNION ALL ".join(
        f"SELECT p4.row_id, {i} AS i, '{f}' AS feature, a.{f} AS feature_value_raw, p4.{f} AS feature_value_model, "
        f"({_W[f]}) * (p4.{f} - b_{f}) AS shap_value, {_W_BASE} AS base_value FROM p4 JOIN a USING (row_id), mb"
        for i, f in enumerate(A_COLS)
    )
    + ")",
)


def attributed_a(spark, sf):
    df = splits.with_folds(T.survey_a(spark, sf)[0]).withColumn(
        "split", F.when(F.col("fold") == 0, "test").otherwise("train")
    )
    df = written(df.select("*", *[F.col(f).alias(f"raw_{f}") for f in A_COLS]), "folds")
    keep = ["row_id", "split", *[f"raw_{f}" for f in A_COLS]]
    ready = fit_preprocessing(df.where("split = 'train'"), T.SPEC_A, keep=keep, vector=None).transform(df)
    background = splits.background_sample(ready, features=A_COLS, key="row_id")
    weights = {f: _W[f] for f in A_COLS}
    return explain.linear_attribution(ready, background, key="row_id", weights=weights, intercept=_W[""])


@query(
    "linear_attribution",
    with_ctes(
        *_LINEAR_CTES,
        """SELECT row_id, feature, round(feature_value_raw, 6) AS feature_value_raw, round(feature_value_model, 6) AS feature_value_model,
             round(shap_value, 6) AS shap_value, round(base_value, 6) AS base_value,
             CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, i) AS INTEGER) AS abs_rank FROM lin""",
    ),
)
def linear_attribution(spark, sf):
    return rounded(attributed_a(spark, sf), "feature_value_raw", "feature_value_model", "shap_value", "base_value")


@query(
    "waterfall",
    with_ctes(
        *_LINEAR_CTES,
        "rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, i) AS k FROM lin)",
        """SELECT row_id, CAST(least(k, 3) AS INTEGER) AS abs_rank, round(sum(shap_value), 6) AS shap_value,
             round(max(base_value), 6) AS base_value, CASE WHEN least(k, 3) = 3 THEN '2 other features' ELSE max(feature) END AS feature
           FROM rk GROUP BY row_id, least(k, 3)""",
    ),
)
def waterfall(spark, sf):
    """The two largest attributions of every row, the others pooled."""
    return rounded(explain.waterfall(attributed_a(spark, sf), key="row_id", max_display=3), "shap_value", "base_value")


_SHAP = {"amount": 0.3, "k": -0.02, "": -3.0}


def _shap_state(amount, k):
    return f"(1.0 / (1.0 + exp(-(-3.0 + 0.3 * {amount} + (-0.02) * {k}))))"


_F = {(i, j): _shap_state("x.amount" if i else "b.amount", "x.k" if j else "b.k") for i in (0, 1) for j in (0, 1)}


@query(
    "shapley_sampling",
    with_ctes(
        V.B_RAW,
        V.B,
        "x AS (SELECT event_id, ln(1 + amount) AS amount, coalesce(k, 0.0) AS k FROM b)",
        f"b200 AS (SELECT * FROM x ORDER BY md5('{SEED}:' || event_id), event_id LIMIT 200)",
        f"""s AS (SELECT x.event_id, x.amount, x.k, avg({_F[0, 0]}) AS base,
                avg(({_F[1, 0]} - {_F[0, 0]} + {_F[1, 1]} - {_F[0, 1]}) / 2) AS phi_amount,
                avg(({_F[0, 1]} - {_F[0, 0]} + {_F[1, 1]} - {_F[1, 0]}) / 2) AS phi_k
              FROM x CROSS JOIN b200 AS b GROUP BY x.event_id, x.amount, x.k)""",
        """l AS (SELECT event_id, base, 0 AS i, 'amount' AS feature, amount AS v, phi_amount AS phi FROM s
                 UNION ALL SELECT event_id, base, 1, 'k', k, phi_k FROM s)""",
        """SELECT event_id, feature, round(v, 6) AS feature_value_raw, round(v, 6) AS feature_value_model,
             round(phi, 6) AS shap_value, round(base, 6) AS base_value,
             CAST(row_number() OVER (PARTITION BY event_id ORDER BY round(abs(phi), 9) DESC, i) AS INTEGER) AS abs_rank FROM l""",
    ),
)
def shapley_sampling(spark, sf):
    """Sampled attributions of a logistic score for every row of survey B's labeled part.

    With two features a pair of opposite orders is every order, so SQL can state the result.
    """
    df = T.survey_b(spark, sf)[0].select("event_id", F.log1p("amount").alias("amount"), F.coalesce("k", F.lit(0.0)).alias("k"))
    background = splits.background_sample(df, features=["amount", "k"], key="event_id")
    table = explain.sampled_attribution(
        df, background, key="event_id", features=["amount", "k"],
        score=lambda frame: frame.withColumn("score", T.logistic(_SHAP)),
    )
    return rounded(table, "feature_value_raw", "feature_value_model", "shap_value", "base_value")



# a stand-in ensemble over two features: a tree of depth two and a stump, with their weights
_TREES = (
    (0.6, [
        {"id": 0, "feature": 0, "threshold": 3.0, "left": 1, "right": 2},
        {"id": 1, "feature": 1, "threshold": 40.0, "left": 3, "right": 4},
        {"id": 2, "feature": 1, "threshold": 70.0, "left": 5, "right": 6},
        {"id": 3, "value": 0.1}, {"id": 4, "value": 0.35}, {"id": 5, "value": 0.8}, {"id": 6, "value": 0.55},
    ]),
    (0.4, [{"id": 0, "feature": 1, "threshold": 55.0, "left": 1, "right": 2}, {"id": 1, "value": 0.2}, {"id": 2, "value": 0.6}]),
)


def _tree_state(amount, k):
    deep = f"CASE WHEN {amount} <= 3.0 THEN CASE WHEN {k} <= 40 THEN 0.1 ELSE 0.35 END ELSE CASE WHEN {k} <= 70 THEN 0.8 ELSE 0.55 END END"
    return f"CAST(0.6 * ({deep}) + 0.4 * (CASE WHEN {k} <= 55 THEN 0.2 ELSE 0.6 END) AS DOUBLE)"


_G = {(i, j): _tree_state("x.amount" if i else "b.amount", "x.k" if j else "b.k") for i in (0, 1) for j in (0, 1)}


@query(
    "tree_attribution",
    with_ctes(
        V.B_RAW,
        V.B,
        "x AS (SELECT event_id, ln(1 + amount) AS amount, coalesce(k, 0.0) AS k FROM b)",
        f"b200 AS (SELECT * FROM x ORDER BY md5('{SEED}:' || event_id), event_id LIMIT 200)",
        f"""s AS (SELECT x.event_id, x.amount, x.k, avg({_G[0, 0]}) AS base,
                avg(({_G[1, 0]} - {_G[0, 0]} + {_G[1, 1]} - {_G[0, 1]}) / 2) AS phi_amount,
                avg(({_G[0, 1]} - {_G[0, 0]} + {_G[1, 1]} - {_G[1, 0]}) / 2) AS phi_k
              FROM x CROSS JOIN b200 AS b GROUP BY x.event_id, x.amount, x.k)""",
        """l AS (SELECT event_id, base, 'amount' AS feature, amount AS v, phi_amount AS phi FROM s
                 UNION ALL SELECT event_id, base, 'k', k, phi_k FROM s)""",
        """SELECT event_id, feature, round(v, 6) AS feature_value_model, round(phi, 6) + 0.0 AS shap_value,
             round(base, 6) AS base_value FROM l""",
    ),
)
def tree_attribution(spark, sf):
    """Exact attributions of a stand-in ensemble for every row, against 200 background rows."""
    features = ["amount", "k"]
    df = T.survey_b(spark, sf)[0].select("event_id", F.log1p("amount").alias("amount"), F.coalesce("k", F.lit(0.0)).alias("k"))
    background = splits.background_sample(df, features=features, key="event_id", max_rows=200)
    leaves = [leaf for weight, nodes in _TREES for leaf in trees.leaves_of(nodes, weight)]
    parts = trees.tree_attribution(df, background, key="event_id", features=features, leaves=leaves)
    parts = parts.drop("feature_value_raw", "abs_rank")
    return rounded(parts, "feature_value_model", "shap_value", "base_value")


K = 5
_NEIGHBORS = f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label FROM embeddings),
nn AS (SELECT * FROM (
  SELECT q.vec_id, t.vec_id AS neighbor_id, list_distance(q.v, t.v) AS distance, t.label,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, t.v), 9), t.vec_id) AS INTEGER) AS rank
  FROM e AS q JOIN e AS t ON q.vec_id <> t.vec_id) WHERE rank <= {K})"""


def neighbors_of_embeddings(spark, sf):
    rows = T.table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("label")
    )
    return neighbors.nearest(
        rows, rows, k=K, query_id="vec_id", train_id="vec_id", vector="embedding", payload=["label"], exclude_same_id=True
    )


@query("knn_exact", with_ctes(_NEIGHBORS, "SELECT vec_id, neighbor_id, round(distance, 6) AS distance, rank, label FROM nn"))
def knn_exact(spark, sf):
    return rounded(neighbors_of_embeddings(spark, sf), "distance")


@query(
    "knn_vote",
    with_ctes(
        _NEIGHBORS,
        """SELECT vec_id, round(avg(CAST(label AS DOUBLE)), 6) AS uniform,
             round(coalesce(avg(CAST(label AS DOUBLE)) FILTER (WHERE distance = 0),
                            sum(label / distance) FILTER (WHERE distance > 0) / sum(1 / distance) FILTER (WHERE distance > 0)), 6) AS distance
           FROM nn GROUP BY vec_id""",
    ),
)
def knn_vote(spark, sf):
    found = neighbors_of_embeddings(spark, sf)
    votes = found.groupBy("vec_id").agg(*[neighbors.vote_of("label", weights).alias(weights) for weights in ("uniform", "distance")])
    return rounded(votes, "uniform", "distance")


@query(
    "knn_probing_recall",
    with_ctes(
        _NEIGHBORS,
        "SELECT count(DISTINCT vec_id) AS n_queries, count(*) AS n_true, TRUE AS recall_reached FROM nn WHERE vec_id % 50 = 0",
    ),
)
def knn_probing_recall(spark, sf):
    """Neighbours by probing for every 50th vector, against all rows, and whether at least nine
    in ten of the true ones are met."""
    rows = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0")
    ids = {"query_id": "vec_id", "vector": "embedding", "exclude_same_id": True}
    index = probing.build_index(rows, want=K + 1, train_id="vec_id", vector="embedding", cell_rows=32)
    found = probing.search(asked, index, k=K, **ids)
    truth = neighbors.nearest(asked, rows, k=K, train_id="vec_id", **ids)
    met = probing.recall(found, truth, query_id="vec_id")
    return met.select("n_queries", "n_true", (F.col("recall") >= 0.9).alias("recall_reached"))
