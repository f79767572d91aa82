"""Exact interpolated quantiles without sorting the table or holding a column in one task.

`percentile` keeps every distinct value of a group in one aggregation buffer. That is used
only for a table of proven size. Beyond it, sketches bracket the wanted order statistics and
each further scan narrows the brackets; only counts and sketches are shuffled. The rows
inside a bracket are finally read exactly, once there are few enough of them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.exprs import number_of
from sieveline.operators.sketches import RANK_ERROR, sketch_quantiles

DIRECT_ROWS = 200_000
_MARKS = 64


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    direct_rows: int = DIRECT_ROWS,
    mode: str = "exact",
) -> dict[str, list[float] | None]:
    """column -> quantiles at `probs` (linear interpolation); None for an all-missing column.

    `mode="approx"` returns sketch quantiles (data elements, rank error about 0.001).
    """
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return {}
    values = df.select(*[number_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    margin = 2 * RANK_ERROR
    asked = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, 0.0, margin)})
    sketched = sketch_quantiles(values, {f"v{i}": F.col(f"v{i}") for i in range(len(columns))}, asked)

    out: dict[str, list[float] | None] = {c: None for c in columns}
    direct, wanted, ranks, limits = [], {}, {}, {}
    for i, c in enumerate(columns):
        n, low, high, marks = sketched[f"v{i}"]
        if n == 0:
            continue
        sketch = dict(zip(asked, marks))
        if mode == "approx":
            out[c] = [float(sketch[min(1.0, max(0.0, p))]) for p in probs]
        elif n <= direct_rows:
            direct.append(i)
        else:
            limits[i] = (float(low), float(high))
            for p in probs:
                h = (n - 1) * p
                k = math.floor(h)
                ranks[i, p] = ((k, min(k + 1, n - 1)), h - k)
                lo = sketch[p - margin] if p - margin > 0 else low
                hi = sketch[p + margin] if p + margin < 1 else high
                for rank in ranks[i, p][0]:
                    wanted[i, rank] = (float(lo), float(hi))
    if direct:
        row = values.agg(*[F.percentile(f"v{i}", probs).alias(f"v{i}") for i in direct]).first()
        for i in direct:
            out[columns[i]] = [float(x) for x in row[f"v{i}"]]
    if wanted:
        found = _select_ranks(values, wanted, limits, direct_rows)
        for i in limits:
            picked = []
            for p in probs:
                (a, b), frac = ranks[i, p]
                x, y = found[i, a], found[i, b]
                picked.append(x if x == y else x + (y - x) * frac)
            out[columns[i]] = picked
    return out


def _select_ranks(
    values: DataFrame,
    wanted: Mapping[tuple[int, int], tuple[float, float]],
    limits: Mapping[int, tuple[float, float]],
    direct_rows: int,
) -> dict[tuple[int, int], float]:
    """The values at 0-based ranks, given a first guess of the value range that holds each."""
    found: dict[tuple[int, int], float] = {}
    todo = dict(wanted)
    while todo:
        brackets = sorted({(i, lo, hi) for (i, _), (lo, hi) in todo.items()})
        inside = [F.col(f"v{i}").between(F.lit(lo), F.lit(hi)) for i, lo, hi in brackets]
        counted = values.agg(
            *[F.count_if(F.col(f"v{i}") < F.lit(lo)).alias(f"b{j}") for j, (i, lo, _) in enumerate(brackets)],
            *[F.count_if(c).alias(f"c{j}") for j, c in enumerate(inside)],
        ).first()

        read: dict[int, list] = {}
        narrow: dict[int, list] = {}
        for key, bracket in list(todo.items()):
            i, rank = key
            j = brackets.index((i, *bracket))
            below, held = counted[f"b{j}"], counted[f"c{j}"]
            if not below <= rank < below + held:
                todo[key] = limits[i]  # the guess missed: start from the full range
            elif bracket[0] == bracket[1]:
                found[key] = bracket[0]
                del todo[key]
            else:
                (read if held <= direct_rows else narrow).setdefault(j, []).append(key)
        if not read and not narrow:
            continue

        if read:
            row = values.agg(
                *[
                    F.percentile(
                        F.when(inside[j], F.col(f"v{brackets[j][0]}")),
                        [(r - counted[f"b{j}"]) / max(1, counted[f"c{j}"] - 1) for _, r in keys],
                    ).alias(f"r{j}")
                    for j, keys in read.items()
                ]
            ).first()
            for j, keys in read.items():
                for key, x in zip(keys, row[f"r{j}"]):
                    found[key] = float(x)
                    del todo[key]
        held_in = (
            sketch_quantiles(
                values,
                {str(j): F.when(inside[j], F.col(f"v{brackets[j][0]}")) for j in narrow},
                [x / _MARKS for x in range(_MARKS + 1)],
            )
            if narrow
            else {}
        )
        for j, keys in narrow.items():
            i, lo, hi = brackets[j]
            marks, below, held = held_in[str(j)][3], counted[f"b{j}"], counted[f"c{j}"]
            for key in keys:
                rank = key[1]
                at = (rank - below) * _MARKS / held
                a, b = max(0, math.floor(at) - 1), min(_MARKS, math.ceil(at) + 1)
                new = (lo if a == 0 else float(marks[a]), hi if b == _MARKS else float(marks[b]))
                if new == (lo, hi):  # a heavy value fills the sketch: test it on its own
                    heavy = float(marks[min(_MARKS, max(0, round(at)))])
                    new = _around(values, i, heavy, rank, lo, hi)
                todo[key] = new
    return found


def _around(values: DataFrame, i: int, heavy: float, rank: int, lo: float, hi: float):
    """Narrow to below, at or above one value."""
    v = F.col(f"v{i}")
    row = values.agg(
        F.count_if(v < heavy).alias("below"),
        F.count_if(v == heavy).alias("at"),
        F.max(F.when(v < heavy, v)).alias("prev"),
        F.min(F.when(v > heavy, v)).alias("next"),
    ).first()
    if rank < row["below"]:
        return (lo, float(row["prev"]))
    if rank < row["below"] + row["at"]:
        return (heavy, heavy)
    return (float(row["next"]), hi)
