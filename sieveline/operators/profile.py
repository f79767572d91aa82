"""Column profiles, category counts, histograms and finders built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.exprs import null_double, number_of, numeric_columns, rows_of
from sieveline.operators.quantiles import DIRECT_ROWS, exact_quantiles
from sieveline.session import local_frame

PROFILE_PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long (feature, value) rows; missing values included."""
    return df.select(
        *keep,
        rows_of(
            [F.struct(F.lit(c).alias("feature"), number_of(df, c).alias("value")) for c in columns]
        ),
    )


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, *, mode: str = "exact", direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """n, missing rate, distinct values, share of the mode and five percentiles per column (F1).

    Exact mode shuffles one partially aggregated row per distinct value and reads percentiles
    by narrowing scans. `mode="approx"` needs no shuffle of values at all: sketches for the
    distinct count and the percentiles, heavy-hitter sketch for the mode.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    quantiles = exact_quantiles(df, columns, PROFILE_PROBS, mode=mode, direct_rows=direct_rows)
    if mode == "approx":
        x = [number_of(df, c) for c in columns]
        wide = df.agg(
            F.count("*").alias("n"),
            *[F.count(v).alias(f"c{i}") for i, v in enumerate(x)],
            *[F.approx_count_distinct(v, 0.01).alias(f"d{i}") for i, v in enumerate(x)],
            *[
                F.call_function("approx_top_k", v, F.lit(1), F.lit(10_000)).alias(f"t{i}")
                for i, v in enumerate(x)
            ],
        )
        stats = wide.select(
            rows_of(
                [
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col("n"),
                        F.col(f"c{i}").alias("held"),
                        F.col(f"d{i}").alias("n_unique"),
                        F.get(F.col(f"t{i}.count"), F.lit(0)).alias("top"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    else:
        freq = unpivot(df, columns).groupBy("feature", "value").agg(F.count("*").alias("cnt"))
        present = F.col("value").isNotNull()
        stats = freq.groupBy("feature").agg(
            F.sum("cnt").alias("n"),
            F.sum(F.when(present, F.col("cnt")).otherwise(F.lit(0))).alias("held"),
            F.count_if(present).alias("n_unique"),
            F.max(F.when(present, F.col("cnt"))).alias("top"),
        )
    marks = local_frame(
        df.sparkSession,
        [(c, *(q or [None] * 5)) for c, q in quantiles.items()],
        "feature string, p01 double, p25 double, median double, p75 double, p99 double",
    )
    table = stats.join(F.broadcast(marks), "feature").select(
        "feature",
        "n",
        F.when(F.col("held") == 0, F.lit(1.0)).otherwise((F.col("n") - F.col("held")) / F.col("n")).alias("missing_rate"),
        "n_unique",
        F.when(F.col("held") > 0, F.col("top") / F.col("held")).alias("top_value_frac"),
        "p01", "p25", "median", "p75", "p99",
        (F.col("p75") - F.col("p25")).alias("iqr"),
    )
    return table.orderBy("missing_rate", F.desc_nulls_last("top_value_frac"), "feature")


def null_counts(df: DataFrame) -> DataFrame:
    """Rows, missing values and type per column (F2)."""
    fields = df.schema.fields
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    return wide.select(
        rows_of(
            [
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.col("n").alias("n_rows"),
                    F.col(f"m{i}").alias("n_missing"),
                )
                for i, f in enumerate(fields)
            ]
        )
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in a total order."""
    return df.orderBy(*order).limit(n)


def drop_suggestions(profile: DataFrame, *, max_missing: float = 0.5) -> DataFrame:
    """Columns to drop: too many missing values (F4) or a single value."""
    reason = F.when(F.col("missing_rate") > max_missing, F.lit("missing")).when(
        F.col("n_unique") <= 1, F.lit("constant")
    )
    return profile.select("feature", "missing_rate", "n_unique", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def histograms(df: DataFrame, columns: Sequence[str] | None = None, *, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max, last bin closed, missing values ignored.

    A constant column gets the unit-wide range around its value.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    x = {c: number_of(df, c) for c in columns}
    row = df.agg(*[f(v).alias(f"{n}_{c}") for c, v in x.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bounds = {}
    for c in columns:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is not None:
            bounds[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    if not bounds:
        return df.sparkSession.createDataFrame([], "feature string, bin int, bin_lo double, bin_hi double, n long")
    structs = []
    for c, (lo, hi) in bounds.items():
        cell = F.floor((x[c] - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int")
        cell = F.when(cell >= bins, F.lit(bins - 1)).otherwise(cell)
        structs.append(F.struct(F.lit(c).alias("feature"), cell.alias("bin")))
    counts = (
        df.select(rows_of(structs)).where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    )
    grid = local_frame(
        df.sparkSession,
        [
            (c, b, lo + b * ((hi - lo) / bins), hi if b == bins - 1 else lo + (b + 1) * ((hi - lo) / bins))
            for c, (lo, hi) in bounds.items()
            for b in range(bins)
        ],
        "feature string, bin int, bin_lo double, bin_hi double",
    )
    full = grid.join(counts, ["feature", "bin"], "left")
    return full.select("feature", "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def skewness(df: DataFrame, columns: Sequence[str] | None = None, *, limit: float = 1.0) -> DataFrame:
    """Population skewness per column and the transform it suggests."""
    columns = numeric_columns(df) if columns is None else list(columns)
    wide = df.agg(*[F.skewness(number_of(df, c)).alias(f"s{i}") for i, c in enumerate(columns)])
    long = wide.select(
        rows_of(
            [
                F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(f"s{i}"), null_double()).alias("skewness"))
                for i, c in enumerate(columns)
            ]
        )
    )
    side = (
        F.when(F.col("skewness") > limit, F.lit("right"))
        .when(F.col("skewness") < -limit, F.lit("left"))
        .otherwise(F.lit("none"))
    )
    return long.withColumn("suggested", side)
