"""Fitted models, search, candidate scoring and streams."""

from __future__ import annotations

import dataclasses

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sieveline.models import families
from sieveline.models.boosting import HistBoosting
from sieveline.functions.metrics import SEARCH_SCORERS
from sieveline.models.search import candidate_metrics, fit_model, run_search, search_summary
from sieveline.models.stages import fit_preprocessing
from sieveline.operators import explain, neighbors, splits
from sieveline.operators.score import predict, rank_candidates
from sieveline.operators.validate import split_valid, validate_rows
from sieveline.plans import sql_views as V
from sieveline.plans import testbed as T
from sieveline.plans.prepare_queries import _VALID_SQL, VALIDATE_INTERVALS, _VALIDATE, inputs_to_validate, rounded
from sieveline.plans.registry import query, with_ctes
from sieveline.session import scratch_path, written
from sieveline.streaming import flows

# one point of each family's search space; what is not named keeps the family's own default
PARAMS = {
    "logreg": {"C": 1.0},
    "svc_rbf": {"C": 1.0, "gamma": 0.05},
    "rf": {"n_estimators": 200, "max_depth": 8},
    "hgb": {"learning_rate": 0.1, "max_leaf_nodes": 16, "max_iter": 100},
    "knn": {"n_neighbors": 5, "weights": "distance"},
}


def folded(spark, sf):
    """Labeled survey A with its folds, as a table that fits and scoring read several times."""
    return written(splits.with_folds(T.survey_a(spark, sf)[0]), "folds")


def _scores(name):
    def run(spark, sf):
        """Fit on all folds but the first, score every labeled row."""
        df = folded(spark, sf)
        model = fit_model(df.where("fold <> 0"), families.default_specs()[name], PARAMS[name], spec=T.SPEC_A)
        deployed = {name: {"model": model, "model_name": name, "profile": "f2", "threshold": 0.5}}
        return predict(df, deployed, deploy_id=name, key="row_id", features=T.FEATURES_A, validate=False)

    return run


_LOGREG = (V.A_RAW, V.A, V.PREPARED_ALL, V.newton(PARAMS["logreg"]["C"]), f"scored AS (SELECT p4.*, 1.0 / (1.0 + exp(-({V.MARGIN}))) AS p FROM p4, fitted)")


def _scored_sql(deploy_id, where):
    return f"""SELECT row_id, '{deploy_id}' AS deploy_id, 'logreg' AS model_name, 'f2' AS profile, 0.5::DOUBLE AS threshold,
      round(p, 6) AS probability_positive, round(1.0 - p, 6) AS probability_negative, round(p - 0.5, 6) AS margin,
      CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, 1 AS positive_label, 0 AS negative_label FROM scored WHERE {where}"""


_SCORES = ("probability_positive", "probability_negative", "margin")


@query("logreg_scores", with_ctes(*_LOGREG, _scored_sql("logreg", "split <> 'candidate'")))
def logreg_scores(spark, sf):
    """M1: fitted outside the first fold by Newton steps, as the SQL takes them."""
    return rounded(_scores("logreg")(spark, sf), *_SCORES)


for _query, _family in (("rf_scores", "rf"), ("gbt_scores", "hgb"), ("rff_svm_scores", "svc_rbf"), ("knn_scores", "knn")):
    query(_query)(_scores(_family))


def _fitted_logreg(spark, sf):
    df = folded(spark, sf)
    model = fit_model(df.where("fold <> 0"), families.default_specs()["logreg"], PARAMS["logreg"], spec=T.SPEC_A)
    return {"deploy_f2": {"model": model, "model_name": "logreg", "profile": "f2", "threshold": 0.5}}


@query("candidate_scores", with_ctes(*_LOGREG, _scored_sql("deploy_f2", "split = 'candidate'")))
def candidate_scores(spark, sf):
    """V6: unlabeled rows scored by a deployed model, most likely first."""
    scored = predict(
        T.survey_a(spark, sf)[1], _fitted_logreg(spark, sf), deploy_id="deploy_f2", key="row_id",
        features=T.FEATURES_A, validate=False,
    )
    return rounded(rank_candidates(scored, key="row_id"), *_SCORES)


def _inside(intervals):
    tests = [f"{c} {op} {b}" for c, ends in intervals.items() for op, b in zip((">=", "<="), ends) if b is not None]
    return " AND ".join(tests)


@query(
    "strict_scores",
    with_ctes(
        *_LOGREG,
        f"ok AS (SELECT row_id FROM a_raw WHERE {_inside(T.INTERVALS_A)})",
        _scored_sql("deploy_f2", "split = 'candidate' AND row_id IN (SELECT row_id FROM ok)"),
    ),
)
def strict_scores(spark, sf):
    """V5: candidates that pass validation, scored in the strict form that fails on any other."""
    rows = T.survey_a(spark, sf)[1]
    valid, _ = split_valid(validate_rows(rows, features=T.FEATURES_A, intervals=T.INTERVALS_A))
    scored = predict(valid, _fitted_logreg(spark, sf), deploy_id="deploy_f2", key="row_id", features=T.FEATURES_A, intervals=T.INTERVALS_A)
    return rounded(scored, *_SCORES)


_BASE = " + ".join([f"w{i} * b_{f}" for i, f in enumerate(T.FEATURES_A)] + [f"w{len(T.FEATURES_A)}"])


@query(
    "explain_model",
    with_ctes(
        *_LOGREG,
        "bg AS (SELECT p4.* FROM p4 JOIN (SELECT row_id FROM a ORDER BY md5('42:' || row_id), row_id LIMIT 200) USING (row_id))",
        "mb AS (SELECT " + ", ".join(f"avg({f}) AS b_{f}" for f in T.FEATURES_A) + " FROM bg)",
        "l AS ("
        + " UNION ALL ".join(
            f"SELECT c.row_id, {i} AS i, '{f}' AS feature, r.{f} AS raw, c.{f} AS v, w{i} * (c.{f} - b_{f}) AS phi, {_BASE} AS base, p "
            "FROM scored AS c JOIN a_raw AS r USING (row_id), mb, fitted WHERE c.split = 'candidate'"
            for i, f in enumerate(T.FEATURES_A)
        )
        + ")",
        """SELECT row_id, feature, round(raw, 6) AS feature_value_raw, round(v, 6) AS feature_value_model, round(phi, 6) AS shap_value,
             CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, i) AS INTEGER) AS abs_rank, round(base, 6) AS base_value,
             'log_odds' AS scale, round(p, 6) AS probability_positive, round(1.0 - p, 6) AS probability_negative,
             CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, 'deploy_f2' AS deploy_id, 'logreg' AS model_name, 'f2' AS profile,
             0.5::DOUBLE AS threshold, 1 AS positive_label, 0 AS negative_label, 'linear' AS explainer FROM l""",
    ),
)
def explain_model(spark, sf):
    """X8 on a fitted logistic model: prediction and attribution of every candidate."""
    told = explain.explain_deployment(
        T.survey_a(spark, sf)[1], T.survey_a(spark, sf)[0], _fitted_logreg(spark, sf), deploy_id="deploy_f2",
        key="row_id", features=T.FEATURES_A,
    )
    return rounded(told, "feature_value_raw", "feature_value_model", "shap_value", "base_value", *_SCORES[:2])


@query(
    "explain_forest",
    with_ctes(V.A_RAW, "SELECT row_id, 4 AS n_features, TRUE AS adds_up, TRUE AS in_order FROM a_raw WHERE raw_label = 'CANDIDATE'"),
)
def explain_forest(spark, sf):
    """X5, X7, X8 on a fitted forest of 200 trees: every candidate's exact attributions, whether they
    add up to its probability less the background's, and whether they are ranked by size."""
    df = folded(spark, sf)
    model = fit_model(df.where("fold <> 0"), families.default_specs()["rf"], PARAMS["rf"], spec=T.SPEC_A)
    deployed = {"rf": {"model": model, "model_name": "rf", "profile": "f2", "threshold": 0.5}}
    parts = explain.explain_deployment(
        T.survey_a(spark, sf)[1], T.survey_a(spark, sf)[0], deployed, deploy_id="rf", key="row_id", features=T.FEATURES_A
    )
    gap = F.abs(F.sum("shap_value") + F.max("base_value") - F.max("probability_positive"))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("abs_rank", F.abs("shap_value").alias("v")))), lambda x: -x["v"])
    return parts.groupBy("row_id").agg(
        F.count("*").cast("int").alias("n_features"), (gap < 1e-9).alias("adds_up"), (sizes == F.array_sort(sizes)).alias("in_order")
    )


@query("svm_gap", with_ctes(V.A_RAW, V.A, V.FOLDS, "SELECT count(*) AS n_rows, 512 AS n_features, TRUE AS within_gap FROM a JOIN folds USING (group_id) WHERE fold <> 0"))
def svm_gap(spark, sf):
    """M2: whether the fit's duality gap is at most a hundredth of its objective."""
    rows = folded(spark, sf).where("fold <> 0")
    model = fit_model(rows, families.default_specs()["svc_rbf"], PARAMS["svc_rbf"], spec=T.SPEC_A).stages[-1]
    width, gap = len(model.getOrDefault("weights")) - 1, model.getOrDefault("gap")
    return rows.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(width).alias("n_features"), F.lit(0 <= gap <= 0.01).alias("within_gap"))


_STUMP = ("quantity", "discount", "tax")  # columns of few values, whose cuts SQL can list


@query(
    "boosted_stump",
    with_ctes(
        V.A_RAW, V.A, V.PREPARED,
        "n0 AS (SELECT count(*) AS n, avg(label) AS p FROM p3 WHERE split = 'train')",
        "g AS (" + " UNION ALL ".join(
            f"SELECT {i} AS f, {c} AS v, sum(p - label) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM p3, n0 WHERE split = 'train' GROUP BY {c}, p"
            for i, c in enumerate(_STUMP)
        ) + ")",
        """l AS (SELECT f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY f) AS gt,
                 sum(h) OVER (PARTITION BY f) AS ht, sum(n) OVER (PARTITION BY f) AS nt FROM g WINDOW w AS (PARTITION BY f ORDER BY v))""",
        """top AS (SELECT * FROM l WHERE nl >= 20 AND nt - nl >= 20
                 ORDER BY round(gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht, 9) DESC, f, v LIMIT 1)""",
        "x AS (SELECT row_id, CASE f WHEN 0 THEN quantity WHEN 1 THEN discount ELSE tax END <= v AS goes_left, top.*, p FROM p3, top, n0)",
        """SELECT row_id, round(1.0 / (1.0 + exp(-(ln(p / (1 - p)) - 0.5 * CASE WHEN goes_left THEN gl / hl ELSE (gt - gl) / (ht - hl) END))), 6) AS score
           FROM x""",
    ),
)
def boosted_stump(spark, sf):
    """M6 in its smallest form: one round of one split, fitted outside the first fold."""
    df = folded(spark, sf)
    spec = dataclasses.replace(T.SPEC_A, scale=False)
    prepare = fit_preprocessing(df.where("fold <> 0"), spec, keep=["row_id", "label", "fold"], vector=None)
    ready = VectorAssembler(inputCols=list(_STUMP), outputCol="features").transform(prepare.transform(df))
    learner = HistBoosting(maxIter=1, maxLeafNodes=2, learningRate=0.5)
    scored = families.positive_score(learner.fit(ready.where("fold <> 0")), ready)
    return rounded(scored.select("row_id", "score"), "score")


# candidates whose scores SQL can state: (family, number, stand-in score)
_CANDIDATES = [("linear", 0, "m1"), ("linear", 1, "m2"), ("steep", 0, "m2")]


@query(
    "search_summary",
    with_ctes(
        V.A_RAW, V.A, V.SCORED,
        f"c AS (SELECT model, fold, {V.COUNTS_SQL} FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored) GROUP BY model, fold)",
        "s AS (SELECT model, fold, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM scored GROUP BY ALL)",
        """r AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY model, fold) AS p
                 FROM s WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC))""",
        "ap AS (SELECT model, fold, sum(pos * cp / CAST(cn AS DOUBLE)) / max(p) AS pr_auc FROM r GROUP BY model, fold)",
        f"""m AS (SELECT model AS source, avg({V.RECALL_SQL}) AS recall, avg({V.PRECISION_SQL}) AS precision, avg({V.F2_SQL}) AS f2, avg(pr_auc) AS pr_auc
                  FROM c JOIN ap USING (model, fold) GROUP BY model)""",
        "k(model, candidate_id, source) AS (VALUES " + ", ".join(map(str, _CANDIDATES)) + ")",
        "b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f2, 12) DESC, candidate_id) AS i FROM k JOIN m USING (source))",
        """SELECT model, '"' || source || '"' AS source, round(f2, 6) AS best_score_refit_f2, round(recall, 6) AS best_mean_test_recall,
             round(precision, 6) AS best_mean_test_precision, round(f2, 6) AS best_mean_test_f2, round(pr_auc, 6) AS best_mean_test_pr_auc FROM b WHERE i = 1""",
    ),
)
def search_summary_of_scores(spark, sf):
    """Metrics of candidates by fold, and the best candidate of each family."""
    scored = T.scored_long(folded(spark, sf), keep=("row_id", "fold", "label"))
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("candidate_id"), F.lit(s).alias("source")) for m, i, s in _CANDIDATES]))
    scores = scored.withColumnRenamed("model", "of").select("*", named.alias("c")).where("of = c.source")
    scores = scores.select("c.model", "c.candidate_id", "fold", "row_id", "score", "label", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("prediction"))
    found = candidate_metrics(written(scores, "candidate-scores"), [(m, i, {"source": s}) for m, i, s in _CANDIDATES], SEARCH_SCORERS)
    best = search_summary(found)
    numbers = [c for c in best.columns if c.startswith("best_") and c != "best_params"]
    return rounded(best.select("model", F.col("best_params")["source"].alias("source"), *numbers), *numbers)


@query("model_search")
def model_search(spark, sf):
    """M8 and A15 over two families with grouped folds."""
    specs = families.by_name(["logreg", "rf"])
    specs["logreg"] = dataclasses.replace(specs["logreg"], space={"C": families.log_uniform(1e-3, 1e2), "max_iter": families.one_of(50)})
    specs["rf"] = dataclasses.replace(
        specs["rf"], space={"n_estimators": families.integers(5, 15), "max_depth": families.one_of(3, 5)}
    )
    found = run_search(folded(spark, sf), spec=T.SPEC_A, specs=specs, n_iter=2, refit=False)
    return search_summary(found.cv_results)


def _inputs(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return flows.file_stream(spark, sf, schema, name="events.parquet")


@query(
    "stream_validate",
    with_ctes(
        _VALID_SQL,
        "SELECT event_id, amount, k, CASE WHEN errors = '' THEN NULL ELSE errors END AS errors FROM v",
    ),
)
def stream_validate(spark, sf):
    """What the two sinks hold after the stream is drained."""
    out = scratch_path(spark, "stream-validate")
    flows.validate_stream(
        inputs_to_validate(_inputs(spark, sf)), valid_path=f"{out}/valid", rejected_path=f"{out}/rejected",
        checkpoint=f"{out}/checkpoint", features=_VALIDATE, intervals=VALIDATE_INTERVALS,
    ).awaitTermination()
    valid = spark.read.parquet(f"{out}/valid").drop("batch", "ts")
    rejected = spark.read.parquet(f"{out}/rejected").drop("batch", "ts")
    return valid.unionByName(rejected, allowMissingColumns=True)


_STREAM_WEIGHTS = {"amount": 0.01, "k": -0.02, "": 0.3}


@query(
    "stream_score",
    """SELECT event_id, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
         SELECT event_id, floor(1e6 / (1.0 + exp(-(0.3 + 0.01 * value + (-0.02) * CAST(json_extract_string(props, '$.k') AS DOUBLE)))) + 0.5) / 1e6 AS score
         FROM events)""",
)
def stream_score(spark, sf):
    """Stateless scoring, appended to a table."""
    out = scratch_path(spark, "stream-score")

    def score(stream):
        rows = stream.select(
            "event_id", F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("double").alias("k")
        )
        scored = rows.select("event_id", T.stand_in_score(_STREAM_WEIGHTS).alias("score"))
        return scored.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))

    flows.score_stream(_inputs(spark, sf), score, path=f"{out}/scores", checkpoint=f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/scores")


@query(
    "stream_knn",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     t AS (SELECT vec_id AS t_id, v AS t_v, label AS y FROM e WHERE vec_id % 3 <> 0),
     d AS (SELECT vec_id, t_id, y, sqrt(list_sum(list_transform(list_zip(v, t_v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS distance
           FROM e, t WHERE vec_id % 3 = 0),
     nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), t_id) AS rank FROM d)
     SELECT vec_id, round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 6) AS score FROM nn WHERE rank <= 5 GROUP BY vec_id""",
)
def stream_knn(spark, sf):
    """T2 with a deployment that joins with its own table: k-NN over the vectors, batch by batch."""
    out = scratch_path(spark, "stream-knn")
    vectors = T.table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("y"))
    train = vectors.where("vec_id % 3 <> 0")
    stream = flows.file_stream(spark, sf, spark.read.parquet(f"{sf}/embeddings.parquet").schema, name="embeddings.parquet")

    index = neighbors.build_index(train, want=5, train_id="vec_id", vector="embedding", payload=["y"])

    def score(batch):
        found = neighbors.search(batch, index, k=5, query_id="vec_id", vector="embedding")
        voted = neighbors.vote(found, query_id="vec_id", label="y")
        return voted.select("vec_id", (F.round("score", 6)).alias("score"))

    flows.score_stream(
        stream.where("vec_id % 3 = 0"), score, path=f"{out}/scores", checkpoint=f"{out}/checkpoint", by_batch=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/scores").drop("batch")


@query(
    "stream_monitor",
    """WITH w AS (SELECT epoch(date_trunc('hour', ts)) AS s, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
                         event_type FROM events)
     SELECT strftime(make_timestamp(CAST(s * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start, feature, count(*) AS n_rows,
            count(*) FILTER (WHERE event_type = 'purchase') AS n_positive,
            CASE feature WHEN 'value' THEN count(*) FILTER (WHERE value < 1 OR value > 400) ELSE count(*) FILTER (WHERE k > 95) END AS out_of_range_n
     FROM w CROSS JOIN (SELECT unnest(['value', 'k']) AS feature) GROUP BY s, feature""",
)
def stream_monitor(spark, sf):
    """Windows closed by the watermark, and those left open once the stream is drained."""
    out = scratch_path(spark, "stream-monitor")
    k = F.get_json_object("props", "$.k").cast("double").alias("k")
    shown = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), "value", k, "event_type")
    settings = {"ts": "ts", "intervals": {"value": (1.0, 400.0), "k": (None, 95.0)}, "positive": F.col("event_type") == "purchase"}
    counts = flows.monitor(shown(_inputs(spark, sf)), **settings)
    (
        counts.writeStream.format("parquet").outputMode("append").option("path", f"{out}/windows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    closed = spark.read.schema(counts.schema).parquet(f"{out}/windows")
    both = closed.unionByName(flows.open_windows(shown(T.table(spark, sf, "events")), closed, **settings))
    return both.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
