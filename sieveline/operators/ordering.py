"""Global positions, running totals and average ranks with no single-task sort (H3).

Rows are put into buckets that follow the sort order. Per-bucket totals give every bucket its
starting offset; a window inside each bucket does the rest. Buckets come from the digits of a
hash (uniform by construction) or from quantile cuts of the sort column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.operators.sketches import sketch_quantiles
from sieveline.session import small, written

BUCKET = "__bucket"


def bucket_count(spark: SparkSession) -> int:
    """Buckets to aim at: follows the shuffle width of the session."""
    return max(32, min(32_768, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def hash_digits(spark: SparkSession) -> int:
    """Hex digits that give at least that many buckets."""
    return max(2, math.ceil(math.log(bucket_count(spark), 16)))


def quantile_marks(df: DataFrame, column: str, n: int) -> list[float]:
    """n - 1 values that part the rows about evenly; a frequent value appears more than once."""
    probs = [i / n for i in range(1, n)]
    found = sketch_quantiles(df, {column: F.col(column)}, probs, k=min(65_535, max(2000, 4 * n)))
    return [float(m) for m in found[column][3] or []]


def cut_points(df: DataFrame, column: str, n: int) -> list[float]:
    """Fewer than n increasing split values of about equal row mass (one sketch aggregate)."""
    return sorted(set(quantile_marks(df, column, n)))


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], *, descending: bool = False) -> DataFrame:
    """Add the number of the value range that holds `column`; a JVM binary search per row."""
    splits = [float("-inf"), *cuts, float("inf")]
    out = Bucketizer(splits=splits, inputCol=column, outputCol=BUCKET).transform(df)
    number = F.col(BUCKET).cast("int")
    return out.withColumn(BUCKET, -number if descending else number)


def bucket_offsets(totals: DataFrame, *, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums before each bucket (`o_<c>`) and over the whole key (`all_<c>`).

    `totals` holds a row per (keys, bucket): a few keys times the bucket count.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return totals.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums],
    )


def running_totals(
    rows: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, order) value with sums of its rows, running sums `cum_<c>` in the order
    of `order` (inclusive) and sums over the key `all_<c>`.

    Values are aggregated before they are sorted, so a value that many rows share is a single
    row by then and cannot overload a bucket. Bucket totals come from a scan of their own that
    shuffles only (keys x buckets) rows.
    """
    keys = list(keys)
    cuts = cut_points(rows, order, bucket_count(rows.sparkSession))
    aggs = [expr.alias(c) for c, expr in sums.items()]
    totals = with_bucket(rows, order, cuts, descending=descending).groupBy(*keys, BUCKET).agg(*aggs)
    offsets = small(bucket_offsets(small(totals), keys=keys, sums=list(sums)))
    values = with_bucket(rows.groupBy(*keys, order).agg(*aggs), order, cuts, descending=descending)
    here = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(F.desc(order) if descending else F.asc(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = values.select("*", *[F.sum(c).over(here).alias(f"w_{c}") for c in sums])
    # every bucket has its offsets; a left join spares the source a not-null test of the bucket
    return inside.join(offsets, [*keys, BUCKET], "left").select(
        *keys,
        order,
        *sums,
        *[(F.col(f"o_{c}") + F.col(f"w_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def dense_index(
    df: DataFrame,
    *,
    bucket: Column,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    out: str = "idx",
) -> DataFrame:
    """0-based position of every row along `order`, separately per key.

    `bucket` must not decrease along `order`; `order` must be total, so that a recomputed task
    gives the same positions.
    """
    keys = list(keys)
    parts = df.withColumn(BUCKET, bucket)
    totals = parts.groupBy(*keys, BUCKET).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    here = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    numbered = parts.withColumn("__r", F.row_number().over(here))
    return numbered.join(offsets, [*keys, BUCKET]).select(
        *df.columns, (F.col("__o") + F.col("__r") - 1).cast("long").alias(out)
    )


def hash_index(
    df: DataFrame, *, hash_col: str, ties: Sequence[str] = (), keys: Sequence[str] = (), out: str = "idx",
    digits: int | None = None,
) -> DataFrame:
    """Positions in the order of a hex digest; 16**digits buckets of equal expected size."""
    digits = digits or hash_digits(df.sparkSession)
    return dense_index(
        df,
        bucket=F.substring(F.col(hash_col), 1, digits),
        order=[F.col(hash_col), *[F.col(t) for t in ties]],
        keys=keys,
        out=out,
    )


def value_index(df: DataFrame, *, order: str, ties: Sequence[str] = (), out: str = "idx") -> DataFrame:
    """Positions in the order of a column of any sortable type (P13 row numbers), ties by further
    columns and then by a hash of the row.

    Spark's range partitioning deals the rows out by all of these, so a value that many rows share
    is cut as well. The sorted ranges are written once: a row's place in its range and the sizes of
    the ranges before, one row per range, give its position. NULL keys come first.
    """
    columns = [F.col(order), *[F.col(t) for t in ties], F.xxhash64(*[F.col(c) for c in df.columns])]
    ranged = df.repartitionByRange(bucket_count(df.sparkSession), *columns).sortWithinPartitions(*columns)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")  # the id holds the partition above 33 bits of row number
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select(*df.columns, (F.col("__start") + row).cast("long").alias(out))


HOT_SHARE = 1000


def average_ranks(values: DataFrame, *, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """One row per (keys, value) with its count and average rank."""
    ranked = running_totals(values, keys=keys, order=value, sums={"cnt": F.count("*")})
    # ranks of the tied block run from cum - cnt + 1 to cum
    return ranked.select(
        *keys, value, "cnt", (F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0).alias(out)
    )
