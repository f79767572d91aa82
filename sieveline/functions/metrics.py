"""Confusion counts and the metrics built from them as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions.exprs import ratio

COUNTS = ("tn", "fp", "fn", "tp")


@dataclass(frozen=True)
class Counts:
    """The four confusion counts as Columns; what a scorer receives."""

    tn: Column
    fp: Column
    fn: Column
    tp: Column

    @classmethod
    def named(cls, prefix: str = "") -> "Counts":
        return cls(*[F.col(prefix + c) for c in COUNTS])


Scorer = Callable[[Counts], Column]


def confusion_aggs(label: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """Aggregates tn, fp, fn, tp for labels 0/1 (A1)."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [
        F.count_if((label == y) & (predicted == p)).alias(prefix + name)
        for name, (y, p) in cells.items()
    ]


def recall(c: Counts) -> Column:
    return ratio(c.tp, c.tp + c.fn)


def precision(c: Counts) -> Column:
    return ratio(c.tp, c.tp + c.fp)


def accuracy(c: Counts) -> Column:
    return ratio(c.tp + c.tn, c.tp + c.tn + c.fp + c.fn)


def fbeta(beta: float = 2.0) -> Scorer:
    """(1+b2) tp / ((1+b2) tp + b2 fn + fp), 0 where undefined (A3)."""
    b2 = float(beta) ** 2

    def score(c: Counts) -> Column:
        weighted = c.tp * F.lit(1.0 + b2)
        return ratio(weighted, weighted + c.fn * F.lit(b2) + c.fp)

    return score


f2 = fbeta(2.0)


def recall_at_precision(floor: float = C.MIN_PRECISION) -> Scorer:
    """Recall where precision reaches the floor, else 0."""
    return lambda c: F.when(precision(c) >= floor, recall(c)).otherwise(F.lit(0.0))


def precision_at_recall(floor: float = C.MIN_RECALL) -> Scorer:
    """Precision where recall reaches the floor, else 0."""
    return lambda c: F.when(recall(c) >= floor, precision(c)).otherwise(F.lit(0.0))


def threshold_objectives(
    *, min_precision: float = C.MIN_PRECISION, min_recall: float = C.MIN_RECALL
) -> dict[str, Scorer]:
    """Objectives a threshold is tuned for, by raw profile name."""
    return {
        "best_f2": f2,
        "best_recall_constrained": recall_at_precision(min_precision),
        "best_precision_constrained": precision_at_recall(min_recall),
    }


IMPORTANCE_SCORERS: Mapping[str, Scorer] = {"f2": f2, "recall": recall, "precision": precision}
SEARCH_SCORERS: Mapping[str, Scorer] = {"recall": recall, "precision": precision, "f2": f2}


def display_profile(profile: str) -> str:
    """Display name of a raw, old or display profile name."""
    return C.PROFILE_DISPLAY.get(profile, profile)


def raw_profile(profile: str, available) -> str:
    """Raw name of a display profile among `available`; current names win over old ones."""
    for raw, display in C.PROFILE_DISPLAY.items():
        if display == profile and raw in available:
            return raw
    raise KeyError(f"none of {sorted(available)} is shown as {profile}")


def importance_metric(profile: str) -> str:
    """Metric an importance run uses for a profile; unknown profiles use f2."""
    return C.PROFILE_METRIC.get(display_profile(profile.strip().lower()), "f2")
