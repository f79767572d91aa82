"""Catalogue files and processed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.operators.harmonize import preferred_rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and `#` comment lines; every column arrives as text.

    Catalogue files carry more columns than a schema names, and a given schema is matched by
    position, so columns are taken by name here and coerced when harmonised. No inference
    scan. Only lines that start with `#` are comments.
    """
    return (
        spark.read.option("header", True).option("comment", "#").option("escape", '"')
        .option("enforceSchema", False).csv(path)
    )


def read_survey_a(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path)


def read_survey_b(spark: SparkSession, path: str, *, preferred_only: bool = True) -> DataFrame:
    """Catalogue B, by default only the preferred row of each object (S3)."""
    df = read_csv(spark, path)
    if C.PREFERRED_FLAG in df.columns:
        df = df.withColumn(C.PREFERRED_FLAG, F.col(C.PREFERRED_FLAG).try_cast("double"))
    return preferred_rows(df) if preferred_only else df


def load_table(spark: SparkSession, path: str, *, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Any file format Spark reads."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def save_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by=(), **options) -> str:
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


SPLITS = ("train", "test", "b_labeled", "a_unlabeled", "b_unlabeled")


def save_splits(splits: DataFrame, candidates_a: DataFrame, candidates_b: DataFrame, path: str) -> str:
    """All five processed sets as one table partitioned by `split`."""
    out = splits
    for df, name in ((candidates_a, "a_unlabeled"), (candidates_b, "b_unlabeled")):
        out = out.unionByName(df.withColumn("split", F.lit(name)), allowMissingColumns=True)
    return save_table(out, path, partition_by=["split"])


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; one of {', '.join(SPLITS)}")
    df = spark.read.parquet(path).where(F.col("split") == split).drop("split")
    return df.drop(C.TARGET) if split.endswith("unlabeled") else df
