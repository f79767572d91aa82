"""Pearson and pairwise-complete Spearman correlation in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.exprs import null_double, number_of, numeric_columns, rows_of
from sieveline.operators.ordering import HOT_SHARE, running_totals
from sieveline.session import spread, written


def _lower_pairs(columns: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i + 1)]


def _pairs_table(df: DataFrame, columns, x, y) -> DataFrame:
    """One aggregate of corr(x_ij, y_ij) for every pair with i >= j."""
    pairs = _lower_pairs(columns)
    wide = df.agg(*[F.corr(x(i, j), y(i, j)).alias(f"r{i}_{j}") for i, j in pairs])
    return wide.select(
        rows_of(
            [
                F.struct(
                    F.lit(columns[i]).alias("feature_i"),
                    F.lit(columns[j]).alias("feature_j"),
                    F.nanvl(F.col(f"r{i}_{j}"), null_double()).alias("rho"),
                )
                for i, j in pairs
            ]
        )
    )


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lower triangle of the Pearson matrix; pairs skip rows missing either value."""
    columns = numeric_columns(df) if columns is None else list(columns)
    v = [number_of(df, c) for c in columns]
    both = [[v[j].isNotNull() & v[i].isNotNull() for j in range(len(columns))] for i in range(len(columns))]
    return _pairs_table(
        df,
        columns,
        lambda i, j: F.when(both[i][j], v[i]),
        lambda i, j: F.when(both[i][j], v[j]),
    )


def spearman(df: DataFrame, columns: Sequence[str] | None = None, *, key: str) -> DataFrame:
    """Lower triangle of the Spearman matrix, average ranks over pairwise-complete rows.

    Every column is ranked once. Beside the rows of a value the ranking counts those in which each
    partner with missing values is there, and running sums of these counts are the value's ranks
    over the rows that the pair has in common. So a row is shuffled once per column, not once per
    pair. `key` is the row key that brings the ranks of a row back together.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    d = len(columns)
    v = [F.col(f"v{i}") for i in range(d)]
    values = df.select(F.col(key).alias("k"), *[number_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    values = spread(values)
    seen = values.agg(F.count("*").alias("n"), *[F.count(v[i]).alias(f"n{i}") for i in range(d)]).first()
    partial = [j for j in range(d) if seen[f"n{j}"] < seen["n"]]
    there = [v[j].isNotNull().alias(f"p{j}") for j in partial]
    long = values.select(
        "k", *there, rows_of([F.struct(F.lit(i).alias("ctx"), v[i].alias("value")) for i in range(d)])
    ).where(F.col("value").isNotNull())
    counts = {"cnt": F.count("*"), **{f"c{j}": F.count_if(F.col(f"p{j}")) for j in partial}}
    ranked = running_totals(long, keys=["ctx"], order="value", sums=counts)
    # ranks of the tied block run from cum - count + 1 to cum
    place = {"cnt": "r", **{f"c{j}": f"r{j}" for j in partial}}
    ranks = [(F.col(f"cum_{c}") - (F.col(c) - 1) / 2.0).alias(name) for c, name in place.items()]
    ranked = written(ranked.select("ctx", "value", "cnt", *ranks), "ranks")

    # A frequent value would send all its rows to one task. At most HOT_SHARE values per
    # column can each hold 1/HOT_SHARE of the rows; those ranks are broadcast.
    names = list(place.values())
    total = max(1, seen["n"])
    hot = ranked.where(F.col("cnt") > total / HOT_SHARE).select("ctx", "value", *[F.col(n).alias(f"hot_{n}") for n in names])
    marked = long.select("k", "ctx", "value").join(F.broadcast(hot), ["ctx", "value"], "left")
    direct = marked.where(F.col("hot_r").isNotNull()).select("k", "ctx", *[F.col(f"hot_{n}").alias(n) for n in names])
    rest = marked.where(F.col("hot_r").isNull()).select("k", "ctx", "value")
    cold = ranked.where(F.col("cnt") <= total / HOT_SHARE).select("ctx", "value", *names)
    joined = rest.join(cold, ["ctx", "value"]).select("k", "ctx", *names)
    rows = (
        direct.unionByName(joined)
        .groupBy("k")
        .agg(*[F.max(F.when(F.col("ctx") == i, F.col(n))).alias(f"{n}_{i}") for i in range(d) for n in names])
    )

    def paired(i, j):
        """The rank of column i among the rows that have j, in rows that have both."""
        rank = F.col(f"r{j}_{i}" if j in partial else f"r_{i}")
        return F.when(F.col(f"r_{i}").isNotNull() & F.col(f"r_{j}").isNotNull(), rank)

    return _pairs_table(rows, columns, paired, lambda i, j: paired(j, i))


def correlated_pairs(table: DataFrame, *, limit: float = 0.9) -> DataFrame:
    """Off-diagonal pairs with |rho| above the limit, strongest first."""
    return table.where(
        (F.col("feature_i") != F.col("feature_j")) & (F.abs("rho") > F.lit(float(limit)))
    ).orderBy(F.desc(F.abs("rho")), "feature_i", "feature_j")
