"""Threshold grids, tuning on out-of-fold scores, thresholded decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions.metrics import Counts, Scorer, threshold_objectives
from sieveline.session import small

TIE_DIGITS = 12


def known_score(score: Column) -> Column:
    """The score as a double, NULL for NaN."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def decide(score: Column, threshold: Column | float, positive=1, negative=0) -> Column:
    """Positive label where the score reaches the threshold, inclusive (E9, M12); no label (NULL)
    without a score, NaN included, so that counts and curves leave out the same rows."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    s = known_score(score)
    return F.when(s >= t, F.lit(positive)).when(s < t, F.lit(negative))


def label_pair(labels: Sequence) -> tuple:
    """(positive, negative) of the two labels a decision can give, listed negative first; a first
    label of 1 is the positive one all the same."""
    if len(labels) != 2:
        raise ValueError(f"a decision is between two labels, but {len(labels)} are given")
    first, second = labels
    return (first, second) if first == 1 else (second, first)


def _grid_value(lo: Column, hi: Column, j: Column, n: int) -> Column:
    return F.when(j == n - 1, hi).otherwise(lo + j * ((hi - lo) / F.lit(float(n - 1))))


def threshold_counts(
    scored: DataFrame,
    *,
    keys: Sequence[str],
    thresholds: int | Sequence[float] = 100,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """(keys, idx, threshold, tn, fp, fn, tp) for a prediction of `score >= threshold`, over the
    rows that have a score.

    Every score falls into one grid cell; counts at a threshold are suffix sums over at most
    `thresholds` cells. Work is one pass over the rows, whatever the grid size.
    """
    keys = list(keys)
    s = known_score(F.col(score))
    scored = scored.where(s.isNotNull())
    if isinstance(thresholds, int):
        n = thresholds
        bounds = small(
            scored.groupBy(*keys).agg(
                F.min(s).alias("lo"),
                F.max(s).alias("hi"),
                F.count_if(F.col(label) == 1).alias("all_pos"),
                F.count_if(F.col(label) == 0).alias("all_neg"),
            )
        )
        rows = scored.select(*keys, s.alias("s"), F.col(label).alias("y")).join(bounds, keys)
        lo, hi = F.col("lo"), F.col("hi")
        guess = F.floor((F.col("s") - lo) / ((hi - lo) / F.lit(float(n - 1)))).cast("int")
        guess = F.when(hi > lo, guess).otherwise(F.lit(n - 1))
        guess = F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1))
        celled = rows.withColumn("g", guess)
        g = F.col("g")
        # rounding can put a score one cell off: compare with the grid values themselves
        cell = (
            F.when((g < n - 1) & (F.col("s") >= _grid_value(lo, hi, g + 1, n)), g + 1)
            .when((g > 0) & (F.col("s") < _grid_value(lo, hi, g, n)), g - 1)
            .otherwise(g)
        )
        grid = bounds.select(
            *keys, "lo", "hi", "all_pos", "all_neg", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")
        )
        grid = grid.select(
            *keys, "idx", _grid_value(F.col("lo"), F.col("hi"), F.col("idx"), n).alias("threshold"),
            "all_pos", "all_neg",
        )
    else:
        marks = sorted(float(t) for t in thresholds)
        n = len(marks)
        bounds = small(
            scored.groupBy(*keys).agg(
                F.count_if(F.col(label) == 1).alias("all_pos"),
                F.count_if(F.col(label) == 0).alias("all_neg"),
            )
        )
        celled = scored.select(*keys, s.alias("s"), F.col(label).alias("y"))
        reached = [F.when(F.col("s") >= t, F.lit(1)).otherwise(F.lit(0)) for t in marks]
        cell = sum(reached[1:], reached[0]) - 1
        grid = bounds.select(
            *keys, "all_pos", "all_neg",
            F.posexplode(F.array(*[F.lit(t) for t in marks])).alias("idx", "threshold"),
        )
    counts = celled.groupBy(*keys, cell.alias("idx")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    from_top = (
        Window.partitionBy(*keys).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    )
    full = grid.join(counts, [*keys, "idx"], "left")
    tp = F.sum(F.coalesce("pos", F.lit(0))).over(from_top)
    fp = F.sum(F.coalesce("neg", F.lit(0))).over(from_top)
    return full.select(*keys, "idx", "threshold", "all_pos", "all_neg", tp.alias("tp"), fp.alias("fp")).select(
        *keys,
        "idx",
        "threshold",
        (F.col("all_neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"),
        "tp",
    )


def threshold_curve(
    scored: DataFrame,
    *,
    keys: Sequence[str],
    objectives: Mapping[str, Scorer] | None = None,
    thresholds: int | Sequence[float] = 100,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Objective values along the grid of each key."""
    objectives = objectives or threshold_objectives()
    counts = threshold_counts(scored, keys=keys, thresholds=thresholds, score=score, label=label)
    return counts.select("*", *[fn(Counts.named()).alias(name) for name, fn in objectives.items()])


def tune_thresholds(
    out_of_fold: DataFrame,
    *,
    keys: Sequence[str] = ("model",),
    fold: str = "fold",
    objectives: Mapping[str, Scorer] | None = None,
    thresholds: int | Sequence[float] = 100,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """(keys, profile, best_threshold, best_score) from one out-of-fold score table.

    All objectives come from one set of counts. Each fold has its own grid; the folds'
    objectives are interpolated onto a common grid and averaged, and the first maximum wins.
    """
    keys = list(keys)
    objectives = objectives or threshold_objectives()
    names = list(objectives)
    curve = threshold_curve(
        out_of_fold, keys=[*keys, fold], objectives=objectives, thresholds=thresholds, score=score, label=label
    )
    long = curve.select(
        *keys,
        fold,
        "idx",
        "threshold",
        F.inline(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(p).alias("v")) for p in names])),
    )
    if isinstance(thresholds, int):
        n = thresholds
        # at most `thresholds` entries per fold and profile
        per_fold = long.groupBy(*keys, "profile", fold).agg(
            F.min("threshold").alias("lo"),
            F.max("threshold").alias("hi"),
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("vs"),
        )
        per_fold = per_fold.withColumn(
            "checked",
            F.when(F.col("lo") == F.col("hi"), F.raise_error(F.lit("a fold has constant scores"))).otherwise(
                F.lit(True)
            ),
        ).where("checked")
        span = Window.partitionBy(*keys, "profile")
        common = per_fold.select(
            "*", F.min("lo").over(span).alias("glo"), F.max("hi").over(span).alias("ghi")
        ).select(
            *keys, "profile", fold, "lo", "hi", "vs", "glo", "ghi",
            F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"),
        )
        lo, hi = F.col("lo"), F.col("hi")
        x = _grid_value(F.col("glo"), F.col("ghi"), F.col("idx"), n)
        placed = common.withColumn("x", x)
        x = F.col("x")
        pos = (x - lo) / ((hi - lo) / F.lit(float(n - 1)))
        left = F.least(F.greatest(F.floor(pos).cast("int"), F.lit(0)), F.lit(n - 2))
        at = placed.withColumn("pos", pos).withColumn("j", left)
        a, b = F.element_at("vs", F.col("j") + 1), F.element_at("vs", F.col("j") + 2)
        value = (
            F.when(x <= lo, F.element_at("vs", 1))
            .when(x >= hi, F.element_at("vs", n))
            .otherwise(a + (b - a) * (F.col("pos") - F.col("j")))
        )
        scores = at.select(*keys, "profile", "idx", F.col("x").alias("threshold"), value.alias("v"))
    else:
        scores = long
    mean = scores.groupBy(*keys, "profile", "idx").agg(
        F.round(F.avg("v"), TIE_DIGITS).alias("v"), F.min("threshold").alias("threshold")
    )
    best = mean.groupBy(*keys, "profile").agg(
        F.max_by(F.struct("threshold", "v"), F.struct(F.col("v"), -F.col("idx"))).alias("b")
    )
    return best.select(
        *keys, "profile", F.col("b.threshold").alias("best_threshold"), F.col("b.v").alias("best_score")
    ).orderBy(*keys, "profile")
