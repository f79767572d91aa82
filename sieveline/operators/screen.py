"""Physical screening, skew transforms and IQR fences."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions.exprs import (
    null_double,
    clip,
    log1p_nonneg,
    number_of,
    numeric_columns,
    out_of_range,
    replace_columns,
    rows_of,
)
from sieveline.operators.quantiles import DIRECT_ROWS, exact_quantiles

Interval = tuple[float | None, float | None]


def screen_physical(
    df: DataFrame, intervals: Mapping[str, Interval] | None = None, *, replace_with: float | None = None
) -> DataFrame:
    """Values outside their interval become missing (or `replace_with`); ends are inclusive."""
    intervals = C.PHYSICAL_INTERVALS if intervals is None else intervals
    fill = null_double() if replace_with is None else F.lit(float(replace_with))
    exprs = {}
    for name, (lower, upper) in intervals.items():
        if name in df.columns:
            x = number_of(df, name)
            exprs[name] = F.when(out_of_range(x, lower, upper), fill).otherwise(x)
    return replace_columns(df, exprs)


def screen_summary(df: DataFrame, intervals: Mapping[str, Interval] | None = None) -> DataFrame:
    """Out-of-range count and share of all rows per feature, in one aggregate."""
    intervals = C.PHYSICAL_INTERVALS if intervals is None else intervals
    held = [(n, lo, hi) for n, (lo, hi) in intervals.items() if n in df.columns]
    counts = df.agg(
        F.count("*").alias("rows"),
        *[
            F.count_if(out_of_range(number_of(df, n), lo, hi)).alias(f"bad{i}")
            for i, (n, lo, hi) in enumerate(held)
        ],
    )
    if not held:
        schema = "feature string, lower double, upper double, out_of_range_n long, out_of_range_pct double"
        return df.sparkSession.createDataFrame([], schema)
    table = counts.select(
        rows_of(
            [
                F.struct(
                    F.lit(n).alias("feature"),
                    F.lit(lo).cast("double").alias("lower"),
                    F.lit(hi).cast("double").alias("upper"),
                    F.col(f"bad{i}").alias("out_of_range_n"),
                    F.when(F.col("rows") > 0, F.col(f"bad{i}") / F.col("rows")).alias("out_of_range_pct"),
                )
                for i, (n, lo, hi) in enumerate(held)
            ]
        )
    )
    return table.orderBy(F.desc("out_of_range_pct"), "feature")


def right_log(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """log1p(max(x, 0)) on the listed columns that exist (C4)."""
    return replace_columns(df, {c: log1p_nonneg(number_of(df, c)) for c in columns if c in df.columns})


def fit_reflection_max(df: DataFrame, columns: Iterable[str], *, eps: float = C.REFLECT_EPS) -> dict:
    """Largest value plus eps per column, one aggregate for all."""
    held = [c for c in columns if c in df.columns]
    if not held:
        return {}
    row = df.agg(*[F.max(number_of(df, c)).alias(f"m{i}") for i, c in enumerate(held)]).first()
    return {c: None if row[i] is None else float(row[i]) + eps for i, c in enumerate(held)}


def left_reflect_log(
    df: DataFrame,
    columns: Iterable[str],
    *,
    reflection_max: Mapping[str, float] | None = None,
    eps: float = C.REFLECT_EPS,
) -> tuple[DataFrame, dict]:
    """log1p(max(M - x, 0)) with given or fitted M; returns the M used."""
    columns = [c for c in columns if c in df.columns]
    used = dict(reflection_max or {})
    used.update(fit_reflection_max(df, [c for c in columns if c not in used], eps=eps))
    exprs = {c: log1p_nonneg(F.lit(used[c]).cast("double") - number_of(df, c)) for c in columns}
    return replace_columns(df, exprs), used


def fit_iqr_fences(
    df: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    whisker: float = C.WHISKER,
    mode: str = "exact",
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, tuple[float, float, float, float]]:
    """column -> (q1, q3, lower fence, upper fence); all-missing columns get none."""
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    fitted = {}
    for name, qs in exact_quantiles(df, columns, (0.25, 0.75), mode=mode, direct_rows=direct_rows).items():
        if qs is not None:
            reach = whisker * (qs[1] - qs[0])
            fitted[name] = (qs[0], qs[1], qs[0] - reach, qs[1] + reach)
    return fitted


def fences_only(fitted: Mapping[str, tuple]) -> dict[str, tuple[float, float]]:
    return {c: (v[-2], v[-1]) for c, v in fitted.items()}


def iqr_summary(df: DataFrame, fitted: Mapping[str, tuple[float, float, float, float]]) -> DataFrame:
    """Fences and the count and share of rows outside them, one aggregate."""
    held = list(fitted.items())
    if not held:
        return df.sparkSession.createDataFrame(
            [],
            "feature string, q1 double, q3 double, iqr double, lower_fence double,"
            " upper_fence double, outlier_n long, outlier_pct double",
        )
    counts = df.agg(
        F.count("*").alias("rows"),
        *[
            F.count_if(out_of_range(number_of(df, c), lo, hi)).alias(f"bad{i}")
            for i, (c, (_, _, lo, hi)) in enumerate(held)
        ],
    )
    table = counts.select(
        rows_of(
            [
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(q1).alias("q1"),
                    F.lit(q3).alias("q3"),
                    F.lit(q3 - q1).alias("iqr"),
                    F.lit(lo).alias("lower_fence"),
                    F.lit(hi).alias("upper_fence"),
                    F.col(f"bad{i}").alias("outlier_n"),
                    (F.col(f"bad{i}") / F.col("rows")).alias("outlier_pct"),
                )
                for i, (c, (q1, q3, lo, hi)) in enumerate(held)
            ]
        )
    )
    return table.orderBy(F.desc("outlier_pct"), "feature")


def clip_to_fences(df: DataFrame, fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip to fitted fences; missing stays missing, absent columns are skipped (C11)."""
    exprs = {c: clip(number_of(df, c), lo, hi) for c, (lo, hi) in fences.items() if c in df.columns}
    return replace_columns(df, exprs)


def fit_and_clip(df: DataFrame, *, columns=None, whisker: float = C.WHISKER, mode: str = "exact"):
    """(clipped, fitted fences, summary) in one call."""
    fitted = fit_iqr_fences(df, columns=columns, whisker=whisker, mode=mode)
    return clip_to_fences(df, fences_only(fitted)), fitted, iqr_summary(df, fitted)
