"""Numbered records of a table: previews, point lookups, first row of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline import config as C
from sieveline.operators.ordering import value_index


def numbered(df: DataFrame, *, order: str, ties: Sequence[str] = (), out: str = "row_id") -> DataFrame:
    """0-based row numbers in the order of the table's key, whatever its type."""
    return value_index(df, order=order, ties=ties, out=out)


def list_records(
    df: DataFrame, *, order: Sequence[str], id_column: str = C.GROUP, label: str = C.TARGET,
    max_rows: int | None = 500, out: str = "row_id",
) -> DataFrame:
    """Row number with the id and label columns that exist; None or <= 0 lists all rows."""
    shown = [c for c in (id_column, label) if c in df.columns]
    if max_rows is None or max_rows <= 0:
        return numbered(df, order=order[0], ties=order[1:], out=out).select(out, *shown)
    top = df.orderBy(*order).limit(max_rows)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over at most max_rows rows
    return top.select(place.cast("long").alias(out), *shown)


def get_records(table: DataFrame, ids: DataFrame, *, features: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Features of the numbered rows asked for (P14, batch form)."""
    return table.select(row_id, *features).join(ids.select(row_id), row_id, "left_semi")


def get_record(table: DataFrame, row: int, *, features: Sequence[str], row_id: str = "row_id") -> dict:
    """One record by row number, missing values as NaN."""
    found = table.where(F.col(row_id) == int(row)).select(*features).first() if row >= 0 else None
    if found is None:
        raise IndexError(f"row number out of bounds: {row}")
    return {c: float("nan") if found[c] is None else float(found[c]) for c in features}


def first_rows(table: DataFrame, *, group: str = C.GROUP, row_id: str = "row_id") -> DataFrame:
    """First row number of every group."""
    return table.groupBy(group).agg(F.min(row_id).alias(row_id))
