"""Quantile sketches merged in two levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rank error is about 2.3 / k**0.9; a sketch takes some 17 bytes times k
SKETCH_K = 8000
RANK_ERROR = 0.001
_MERGERS = 64


def sketch_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], *, k: int = SKETCH_K
) -> dict[str, tuple[int, float | None, float | None, list[float] | None]]:
    """name -> (non-missing rows, minimum, maximum, approximate quantiles at `probs`).

    Every task sends one sketch per column to one of a few mergers, which send one each to the
    last step: no single task receives a sketch from every input task.
    """
    names = list(columns)
    marks = F.array(*[F.lit(float(p)) for p in probs])
    rows = df.select(
        F.pmod(F.spark_partition_id(), F.lit(_MERGERS)).alias("m"),
        *[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)],
    )
    parts, whole, out = [], [], []
    for i in range(len(names)):
        x = F.nanvl(F.col(f"x{i}"), F.lit(None).cast("double"))
        parts += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.kll_sketch_agg_double(x, k).alias(f"s{i}"),
        ]
        whole += [
            F.sum(f"n{i}").alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
            F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")), k).alias(f"s{i}"),
        ]
        out += [
            f"n{i}", f"lo{i}", f"hi{i}",
            F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), marks)).alias(f"q{i}"),
        ]
    row = rows.groupBy("m").agg(*parts).agg(*whole).select(*out).first()
    return {
        n: (row[f"n{i}"] or 0, row[f"lo{i}"], row[f"hi{i}"], None if row[f"q{i}"] is None else list(row[f"q{i}"]))
        for i, n in enumerate(names)
    }
