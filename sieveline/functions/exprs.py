"""Null-safe scalar expressions.

SQL NULL is the only missing value: Spark orders NaN above every number and skips NULL in
`greatest`/`least`, so both are avoided here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def null_double() -> Column:
    return F.lit(None).cast("double")


_NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def number(col: Column, dtype: T.DataType) -> Column:
    """Coerce to double, unparsable and NaN become NULL."""
    if isinstance(dtype, T.StringType):
        value = F.when(col.rlike(_NUMERIC_TEXT), F.trim(col).try_cast("double"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = col.cast("double")
    else:
        value = col.try_cast("double")
    return F.nanvl(value, null_double())


def number_of(df: DataFrame, name: str) -> Column:
    return number(F.col(name), df.schema[name].dataType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def replace_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """One `select` that swaps the named columns and leaves the rest as they are."""
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def out_of_range(x: Column, lower: float | None, upper: float | None) -> Column:
    """Outside [lower, upper]; a missing value is never outside."""
    bad = F.lit(False)
    if lower is not None:
        bad = bad | (x < F.lit(float(lower)))
    if upper is not None:
        bad = bad | (x > F.lit(float(upper)))
    return F.coalesce(bad, F.lit(False))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Missing stays missing."""
    out = x
    if upper is not None:
        out = F.when(x > F.lit(float(upper)), F.lit(float(upper))).otherwise(out)
    if lower is not None:
        out = F.when(x < F.lit(float(lower)), F.lit(float(lower))).otherwise(out)
    return out


def log1p_nonneg(x: Column) -> Column:
    return F.log1p(clip(x, lower=0.0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def lookup(col: Column, mapping: Mapping[str, object]) -> Column:
    """Dictionary mapping as a `when` chain; keys outside the map give NULL."""
    out = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if out is not None else F.lit(None)


def seeded_hash(seed: int | str, *cols: Column) -> Column:
    """md5 of `seed:col:...`; the same text gives the same digest in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def rows_of(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))
