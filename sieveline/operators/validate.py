"""Row validation with messages, and defaults for missing inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import config as C
from sieveline.functions.exprs import is_finite

_DIGITS = r"\d(_?\d)*"  # digits may be grouped, as in 1_000
_FLOAT_TEXT = rf"(?i)^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$"


def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g writes them."""
    sci = F.format_string("%.5e", x)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    fixed = F.regexp_replace(sci.try_cast("decimal(30,12)").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(sci, r"\.?0*e", "e")
    plain = F.when(exponent.between(-4, 5), fixed).otherwise(short)
    return F.when(x == 0, F.lit("0")).otherwise(plain)


def _quoted(x: Column) -> Column:
    has_single, has_double = x.contains("'"), x.contains('"')
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def validate_rows(
    df: DataFrame,
    *,
    features: Sequence[str] = C.MODEL_FEATURES,
    intervals: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Replace features by their parsed values and add `errors`, an array of messages (V3).

    NaN and infinities pass the range test. A value outside its interval is reported and kept;
    one that cannot be parsed is reported and becomes NULL.
    """
    intervals = C.PHYSICAL_INTERVALS if intervals is None else intervals
    checks, cleaned = [], {}
    for name in features:
        if name not in df.columns:
            checks.append(F.lit(C.MISSING_FEATURE.format(name=name)))
            continue
        raw = F.col(name)
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            parsed = F.when(raw.rlike(_FLOAT_TEXT), F.replace(F.trim(raw), F.lit("_")).try_cast("double"))
        else:
            parsed = raw.cast("double")
        cleaned[name] = parsed
        checks.append(F.when(raw.isNull(), F.lit(C.MISSING_VALUE.format(name=name))))
        if isinstance(kind, T.StringType):
            checks.append(
                F.when(
                    raw.isNotNull() & parsed.isNull(),
                    F.concat(F.lit(C.NOT_NUMERIC.format(name=name)), _quoted(raw)),
                )
            )
        lower, upper = intervals.get(name, (None, None))
        for bound, side, broken in (
            (lower, C.BELOW, lambda v, b: v < b),
            (upper, C.ABOVE, lambda v, b: v > b),
        ):
            if bound is not None:
                checks.append(
                    F.when(
                        is_finite(parsed) & broken(parsed, F.lit(float(bound))),
                        F.concat(F.lit(f"{name}: "), general_format(parsed), F.lit(C.OUT_OF_RANGE.format(side=side, bound=bound))),
                    )
                )
    kept = [cleaned[c].alias(c) if c in cleaned else F.col(c) for c in df.columns]
    return df.select(*kept, F.array_compact(F.array(*checks)).alias("errors"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with one joined message)."""
    bad = F.size("errors") > 0
    return (
        validated.where(~bad).drop("errors"),
        validated.where(bad).withColumn("errors", F.concat_ws("; ", "errors")),
    )


def require_valid(validated: DataFrame) -> DataFrame:
    """Strict form: the job fails with the joined messages at the first invalid row."""
    checked = F.when(F.size("errors") > 0, F.raise_error(F.concat_ws("; ", "errors"))).otherwise(F.lit(True))
    return validated.where(checked).drop("errors")


def fill_defaults(
    df: DataFrame, *, features: Sequence[str] = C.MODEL_FEATURES, intervals: Mapping[str, tuple] | None = None
) -> DataFrame:
    """Missing inputs become the interval's midpoint, else its one end, else 0."""
    intervals = C.PHYSICAL_INTERVALS if intervals is None else intervals
    exprs = []
    for name in df.columns:
        if name not in features:
            exprs.append(F.col(name))
            continue
        lower, upper = intervals.get(name, (None, None))
        if lower is not None and upper is not None:
            default = (lower + upper) / 2.0
        else:
            default = next((b for b in (lower, upper) if b is not None), 0.0)
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        exprs.append(F.coalesce(value, F.lit(float(default))).alias(name))
    return df.select(*exprs)
