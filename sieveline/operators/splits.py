"""Group-disjoint stratified folds, named splits and seeded samples (K1-K4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline import config as C
from sieveline.functions.exprs import seeded_hash
from sieveline.operators.harmonize import require_columns
from sieveline.operators.ordering import hash_digits
from sieveline.session import local_frame, small

_CYCLE = 200
SHARE_DIGITS = 12
LOOKUP_SHARE = 10_000
LOOKUP_ROWS = 50_000


def _assign_heavy(rows, n_splits: int, totals: tuple[int, int]) -> tuple[dict, list[list[float]]]:
    """Largest groups first, each to the fold whose positives and negatives it overfills least."""
    load = [[0.0, 0.0] for _ in range(n_splits)]
    goal = [max(1.0, t / n_splits) for t in totals]
    chosen = {}
    for group, pos, neg in sorted(rows, key=lambda r: (-(r[1] + r[2]), r[0])):
        fold = min(
            range(n_splits),
            key=lambda f: (max((load[f][0] + pos) / goal[0], (load[f][1] + neg) / goal[1]), f),
        )
        load[fold][0] += pos
        load[fold][1] += neg
        chosen[group] = fold
    return chosen, load


def _cycle(load, totals: tuple[int, int], n_splits: int) -> list[int]:
    """Order in which light groups are dealt: plain round robin when no fold is filled yet,
    else a weighted one that gives each fold the share it still lacks."""
    filled = [sum(x) for x in load]
    if not any(filled):
        return list(range(n_splits))
    room = [max(0.0, sum(totals) / n_splits - f) for f in filled]
    if not any(room):
        return list(range(n_splits))
    share = [round(r / sum(room), SHARE_DIGITS) for r in room]
    credit, out = [0.0] * n_splits, []
    for _ in range(_CYCLE):
        credit = [c + s for c, s in zip(credit, share)]
        pick = max(range(n_splits), key=lambda f: (credit[f], -f))
        credit[pick] -= 1.0
        out.append(pick)
    return out


def group_folds(
    df: DataFrame,
    *,
    target: str = C.TARGET,
    group: str = C.GROUP,
    n_splits: int = C.N_SPLITS,
    seed: int = C.SEED,
) -> DataFrame:
    """(group, n_pos, n_neg, fold) of every group (K1). See `with_folds` for the fold of every row.

    A group above 1/(20 n_splits) of all rows is heavy, whatever the number of rows; at most
    20 n_splits such groups can exist, so they are placed on the driver, the largest first, and
    the light ones fill up what is left. Light groups are dealt in the order (positives desc,
    negatives desc, seeded md5, group).
    """
    light, heavy, _ = _folds(df, target=target, group=group, n_splits=n_splits, seed=seed)
    return light.unionByName(_heavy_table(df, heavy, group))


def _heavy_table(df: DataFrame, heavy: list[tuple], group: str) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    return local_frame(df.sparkSession, heavy, f"{group} {kind}, n_pos long, n_neg long, fold int")


def _folds(df: DataFrame, *, target: str, group: str, n_splits: int, seed: int) -> tuple[DataFrame, list[tuple], float | None]:
    """Folds of the light groups, rows of the heavy ones, and the size above which a light group
    is looked up by broadcast."""
    require_columns(df, (target, group), "columns to deal folds by")
    sizes = df.groupBy(F.col(group).alias("g")).agg(
        F.count_if(F.col(target) == 1).alias("n_pos"),
        F.count_if(F.col(target) == 0).alias("n_neg"),
    )
    size = F.col("n_pos") + F.col("n_neg")
    row = sizes.agg(F.sum("n_pos"), F.sum("n_neg"), F.max(size), F.count_if(F.col("g").isNull())).first()
    if row[3]:
        raise ValueError(f"rows without a `{group}` cannot be dealt into folds")
    totals = (row[0] or 0, row[1] or 0)
    limit = sum(totals) / (20.0 * n_splits)
    heavy_rows = [tuple(r) for r in sizes.where(size > limit).collect()] if (row[2] or 0) > limit else []
    chosen, load = _assign_heavy(heavy_rows, n_splits, totals)
    heavy = [(g, p, n, chosen[g]) for g, p, n in heavy_rows]
    cycle = _cycle(load, totals, n_splits)

    light = sizes.where(size <= limit).withColumn("h", seeded_hash(seed, F.col("g")))
    light = light.withColumn("b", F.substring("h", 1, hash_digits(df.sparkSession)))
    # offsets in three levels; the widest un-keyed window sees one row per distinct n_pos
    cells = light.groupBy("n_pos", "n_neg", "b").agg(F.count("*").alias("c"))
    by_pos = cells.groupBy("n_pos").agg(F.sum("c").alias("c"))
    past = Window.unboundedPreceding
    before_pos = by_pos.select(
        "n_pos",
        F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n_pos")).rowsBetween(past, -1)), F.lit(0)).alias("o1"),
    )
    inside = Window.partitionBy("n_pos").orderBy(F.desc("n_neg"), "b").rowsBetween(past, -1)
    offsets = cells.select(
        "n_pos", "n_neg", "b", F.coalesce(F.sum("c").over(inside), F.lit(0)).alias("o2")
    ).join(before_pos, "n_pos")
    place = Window.partitionBy("n_pos", "n_neg", "b").orderBy("h", "g")
    dealt = light.withColumn("r", F.row_number().over(place)).join(offsets, ["n_pos", "n_neg", "b"])
    position = (F.col("o1") + F.col("o2") + F.col("r") - 1).cast("long")
    pick = F.element_at(F.array(*[F.lit(f) for f in cycle]), (position % len(cycle)).cast("int") + 1)
    folds = dealt.select(F.col("g").alias(group), "n_pos", "n_neg", pick.alias("fold"))
    lookup = max(sum(totals) / LOOKUP_SHARE, LOOKUP_ROWS)
    return folds, heavy, lookup if (row[2] or 0) > lookup else None


def with_folds(
    df: DataFrame,
    *,
    target: str = C.TARGET,
    group: str = C.GROUP,
    n_splits: int = C.N_SPLITS,
    seed: int = C.SEED,
) -> DataFrame:
    """Add the `fold` of each row's group (K1, K3).

    Rows of large groups take their fold from a broadcast and skip the shuffle join: the heavy
    groups, and any group with over 1/LOOKUP_SHARE of the rows (and LOOKUP_ROWS rows at least).
    """
    light, heavy, limit = _folds(df, target=target, group=group, n_splits=n_splits, seed=seed)
    table = _heavy_table(df, heavy, group).select(group, "fold")
    size = F.col("n_pos") + F.col("n_neg")
    if limit is not None:
        table = table.unionByName(light.where(size > limit).select(group, "fold"))
        light = light.where(size <= limit)
    elif not heavy:
        return df.join(light.select(group, "fold"), group).select(*df.columns, "fold")
    table = F.broadcast(table)  # at most 20 n_splits + LOOKUP_SHARE rows
    of_large = df.join(table, group).select(*df.columns, "fold")
    of_light = df.join(table, group, "left_anti").join(light.select(group, "fold"), group)
    return of_large.unionByName(of_light.select(*df.columns, "fold"))


def _held_out(fold_index: int, n_splits: int) -> Column:
    """`test` for the rows of one fold, `train` for the others."""
    if fold_index not in range(n_splits):
        raise ValueError(f"there are folds 0 to {n_splits - 1}, not {fold_index}")
    return F.when(F.col("fold") == fold_index, F.lit("test")).otherwise(F.lit("train"))


def train_test_split(df: DataFrame, *, fold_index: int = 0, n_splits: int = C.N_SPLITS, **kw) -> DataFrame:
    """The rows with a `split` column, `train` or `test`: one fold held out. One frame, so that
    the folds are dealt once whichever part is read."""
    split = _held_out(fold_index, n_splits)
    return with_folds(df, n_splits=n_splits, **kw).withColumn("split", split).drop("fold")


def named_splits(labeled_a: DataFrame, labeled_b: DataFrame, *, fold_index: int = 0, **kw) -> DataFrame:
    """Train and test part of A and all of B as the external set, in a `split` column (K2)."""
    part_a = train_test_split(labeled_a, fold_index=fold_index, **kw)
    return part_a.unionByName(labeled_b.withColumn("split", F.lit("b_labeled")), allowMissingColumns=True)


def fold_balance(folded: DataFrame, *, target: str = C.TARGET, group: str = C.GROUP) -> DataFrame:
    """Rows, positives and groups per fold."""
    groups = folded.groupBy("fold", group).agg(
        F.count("*").alias("r"), F.count_if(F.col(target) == 1).alias("p")
    )
    return groups.groupBy("fold").agg(
        F.sum("r").alias("n_rows"), F.sum("p").alias("n_pos"), F.count("*").alias("n_groups")
    )


def background_sample(
    df: DataFrame, *, features, key: str, max_rows: int = 200, seed: int = C.SEED
) -> DataFrame:
    """Exactly min(max_rows, n) rows without replacement, by seeded hash of the row key (K4)."""
    require_columns(df, features, "background features")
    h = seeded_hash(seed, F.col(key))
    return df.select(key, *features, h.alias("__h")).orderBy("__h", key).limit(max_rows).drop("__h")


def class_weights(df: DataFrame, *, target: str = C.TARGET) -> Mapping[int, float]:
    """n / (2 n_c) per class 0 and 1 that occurs (A14); other labels are an error."""
    y = F.col(target)
    row = df.agg(F.count_if(y == 0), F.count_if(y == 1), F.count_if(y.isNull() | ~y.isin(0, 1))).first()
    if row[2]:
        raise ValueError(f"{row[2]} rows have a `{target}` other than 0 and 1")
    total = row[0] + row[1]
    return {c: total / (2.0 * n) for c, n in enumerate(row[:2]) if n}
