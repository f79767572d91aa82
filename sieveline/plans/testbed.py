"""The driver tables seen as survey catalogues.

A: line items grouped by order. B: events with other names, units and unmapped labels.
C: orders with their customer's balance, the only measure with impossible (negative) values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import FeatureSpec
from sieveline.operators import harmonize as H
from sieveline.session import BROADCAST_ROWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LABELS_OF_FLAG = {"R": "CONFIRMED", "A": "FALSE POSITIVE", "N": "CANDIDATE"}
LABELS_OF_EVENT = {
    "purchase": "CONFIRMED",
    "error": "FALSE POSITIVE",
    "signup": "REFUTED",
    "view": "CANDIDATE",
}

MAP_A = {
    "l_orderkey": "group_id",
    "disposition": "label",
    "l_quantity": "quantity",
    "l_extendedprice": "price",
    "l_discount": "discount",
    "l_tax": "tax",
}
MAP_B = {
    "user_id": "group_id",
    "disposition": "label",
    "amount": "amount",
    "k": "k",
}

FEATURES_A = ("quantity", "price", "discount", "tax")
INTERVALS_A = {"quantity": (2.0, 48.0), "price": (0.0, None), "discount": (0.0, 0.09), "tax": (None, 0.07)}
INTERVALS_B = {"amount": (0.0, 4000000.0), "k": (None, 95.0)}
INTERVALS_C = {"o_totalprice": (0.0, 450000.0), "c_acctbal": (0.0, None)}
SPEC_A = FeatureSpec(
    features=FEATURES_A,
    right_skewed=("price",),
    left_skewed=("discount",),
    intervals=INTERVALS_A,
)

# stand-in scores: fixed weights on screened and clipped features, one set per model
SCORES_A = {
    "m1": {"quantity": 0.05, "price": -0.00002, "discount": 4.0, "tax": -3.0, "": 0.1},
    "m2": {"quantity": -0.02, "price": 0.00001, "discount": -6.0, "tax": 5.0, "": 0.2},
}


def survey_a_raw(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    named = None
    for k, v in LABELS_OF_FLAG.items():
        named = F.when(flag == k, v) if named is None else named.when(flag == k, v)
    parts = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    row_id = F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in parts])
    return df.select(
        row_id.alias("row_id"), "l_orderkey", named.alias("disposition"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def survey_b_raw(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    named = None
    for k, v in LABELS_OF_EVENT.items():
        named = F.when(kind == k, v) if named is None else named.when(kind == k, v)
    return df.select(
        "event_id",
        "user_id",
        F.coalesce(named, kind).alias("disposition"),
        # the amount arrives as text, as a CSV column with bad entries would
        F.col("value").cast("string").alias("amount"),
        F.get_json_object("props", "$.k").alias("k"),
        # an empty measurement is never the preferred one
        F.when(F.col("value") > 0, F.lit(1)).otherwise(F.lit(0)).alias("default_flag"),
    )


def survey_a(spark, sf_dir):
    """(labeled, candidates) of A, with the row key."""
    return H.prepare_survey(survey_a_raw(spark, sf_dir), MAP_A, keep=("row_id",))


def survey_b(spark, sf_dir):
    return H.prepare_survey(
        H.preferred_rows(survey_b_raw(spark, sf_dir)), MAP_B, unit_factors={"amount": 10000.0}, keep=("event_id",)
    )


def survey_c(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def linear(weights: dict):
    z = F.lit(float(weights.get("", 0.0)))
    for name, w in weights.items():
        if name:
            z = z + F.lit(w) * F.col(name)
    return z


def logistic(weights: dict):
    return 1.0 / (1.0 + F.exp(-linear(weights)))


def stand_in_score(weights: dict):
    """Logistic of a fixed linear form, in cells of 1e-6."""
    return F.floor(1e6 / (1.0 + F.exp(-linear(weights))) + 0.5) / 1e6


def scored_long(df: DataFrame, keep=()) -> DataFrame:
    """One row per (row, model) with the stand-in score; each model scored once."""
    return df.select(
        *keep,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), stand_in_score(w).alias("score"))
                    for m, w in SCORES_A.items()
                ]
            )
        ),
    )


def fixed_small(df: DataFrame) -> DataFrame:
    """Materialise a summary of a few rows (tuned thresholds) so that later steps reuse it."""
    table = df.limit(BROADCAST_ROWS + 1).toArrow()
    if table.num_rows > BROADCAST_ROWS:
        raise ValueError(f"a summary of over {BROADCAST_ROWS} rows is not small")
    return df.sparkSession.createDataFrame(table, df.schema)
