"""Exact attribution of tree ensembles against a background.

A leaf is a box: an interval for each feature on its path. Let a tell which intervals of a leaf the
explained row meets and b which a background row meets. A row whose features come in part from one
and in part from the other reaches the leaf exactly if each interval is met by the row its feature
comes from. So a feature counts for the leaf only if one of the two meets its interval and the other
does not, and the Shapley value of that game is a fraction of factorials of how many such features
there are on either side. The values of a row are sums over leaves and background rows; nothing is
sampled, and they add up to the row's score minus the background's mean score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.explain import MAX_BACKGROUND, _long, _raw_columns
from sieveline.session import scratch_path, ship_package

#: Bytes of one table of row, background row and feature in a task.
_TABLE_BYTES = 32 << 20


@dataclass(frozen=True)
class Leaf:
    """`value` for rows with low < x <= high in each of `features` (positions)."""

    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    value: float


def leaves_of(nodes: Sequence[dict], weight: float = 1.0) -> list[Leaf]:
    """The leaves of one tree. A node has `id`, and either `feature`, `threshold`, `left` and `right`
    (x <= threshold goes left) or `value`; the root's id is 0."""
    by_id = {n["id"]: n for n in nodes}
    out, open_boxes = [], [(0, {})]
    while open_boxes:
        at, box = open_boxes.pop()
        node = by_id[at]
        if node.get("feature") is None:
            names = sorted(box)
            ends = [box[f] for f in names]
            out.append(Leaf(tuple(names), tuple(e[0] for e in ends), tuple(e[1] for e in ends), weight * float(node["value"])))
            continue
        f, t = int(node["feature"]), float(node["threshold"])
        low, high = box.get(f, (-math.inf, math.inf))
        open_boxes.append((node["left"], {**box, f: (low, min(high, t))}))
        open_boxes.append((node["right"], {**box, f: (max(low, t), high)}))
    return [leaf for leaf in out if all(a < b for a, b in zip(leaf.low, leaf.high))]


def read_leaves(model, spark) -> tuple[list[Leaf], bool]:
    """Leaves of a fitted tree, forest or boosted model for two classes, and whether their sum is a
    margin m with probability 1 / (1 + exp(-2 m)) rather than the probability itself.

    The model is read back as the table it is saved as; its trees fit the driver, where it was fitted.
    """
    from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel

    if hasattr(model, "leaves"):
        return model.leaves(), True
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    one_tree, margin = isinstance(model, DecisionTreeClassificationModel), isinstance(model, GBTClassificationModel)
    rows = data.select(F.lit(0).alias("tree"), "*") if one_tree else data.select(F.col("treeID").alias("tree"), "nodeData.*")
    rows = rows.select(
        "tree", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex",
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "split.numCategories",
    )
    trees: dict[int, list[dict]] = {}
    for r in rows.collect():
        if r["leftChild"] >= 0 and r["numCategories"] >= 0:
            raise ValueError("splits over categories are not attributed; encode them first")
        stats = r["impurityStats"]
        leaf = {"id": r["id"], "value": r["prediction"] if margin else stats[1] / sum(stats)}
        inner = {"id": r["id"], "feature": r["featureIndex"], "threshold": r["threshold"], "left": r["leftChild"], "right": r["rightChild"]}
        trees.setdefault(r["tree"], []).append(inner if r["leftChild"] >= 0 else leaf)
    weights = list(model.treeWeights) if margin else [1.0 / len(trees)] * len(trees)
    return [leaf for t, nodes in sorted(trees.items()) for leaf in leaves_of(nodes, weights[t])], margin


def _shares(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of s features that only the row meets and t that only the background meets: what one of the
    former gains, (s-1)! t! / (s+t)!, and what one of the latter takes, s! (t-1)! / (s+t)!."""
    gain, loss = np.zeros((size + 1, size + 1)), np.zeros((size + 1, size + 1))
    for s in range(size + 1):
        for t in range(size + 1 - s):
            if s:
                gain[s, t] = 1.0 / (s * math.comb(s + t, s))
            if t:
                loss[s, t] = 1.0 / (t * math.comb(s + t, t))
    return gain, loss


def _game(leaf: Leaf, a: np.ndarray, b: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """Values by (mask of a row, mask of a background row, feature of the leaf)."""
    size = len(leaf.features)
    a, b = a[:, None], b[None, :]
    only_a, only_b = a & ~b, b & ~a
    s, t = np.bitwise_count(only_a), np.bitwise_count(only_b)
    scale = np.where((a | b) == (1 << size) - 1, leaf.value, 0.0)
    up, down = scale * gain[s, t], scale * loss[s, t]
    return np.stack([(only_a >> j & 1) * up - (only_b >> j & 1) * down for j in range(size)], axis=2)


class _Attribution:
    """Values of batches of rows. Rows are cut at the trees' thresholds first, so a leaf compares
    small whole numbers; what depends on leaf and background alone is computed once."""

    def __init__(self, leaves: Sequence[Leaf], background: np.ndarray, dims: int, margin: bool):
        self.leaves = [leaf for leaf in leaves if leaf.features]
        self.flat = float(sum(leaf.value for leaf in leaves if not leaf.features))
        self.background, self.dims, self.margin = background, dims, margin
        self.gain, self.loss = _shares(dims)
        ends = [set() for _ in range(dims)]
        for leaf in self.leaves:
            for f, *both in zip(leaf.features, leaf.low, leaf.high):
                ends[f].update(t for t in both if math.isfinite(t))
        self.cuts = [np.array(sorted(e)) for e in ends]
        at = [{t: i for i, t in enumerate(c)} | {-math.inf: -1, math.inf: len(c)} for c in self.cuts]
        self.spans = [[(f, at[f][a] + 1, at[f][b]) for f, a, b in zip(leaf.features, leaf.low, leaf.high)] for leaf in self.leaves]
        other = self.codes(background)
        self.known = [np.unique(self.masks(span, other), return_inverse=True, return_counts=True) for span in self.spans]
        self.means = [] if margin else [self._mean(leaf, k) for leaf, k in zip(self.leaves, self.known)]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """By feature, how many cuts lie below the value; one that is not a number lies above all,
        as a tree sends it right."""
        return [np.searchsorted(c, x[:, f], side="left").astype(np.int32) for f, c in enumerate(self.cuts)]

    @staticmethod
    def masks(span, codes: list[np.ndarray]) -> np.ndarray:
        """Bit j: the row meets the interval of the leaf's j-th feature."""
        out = np.zeros(len(codes[0]), np.int64)
        for j, (f, first, last) in enumerate(span):
            out |= ((codes[f] >= first) & (codes[f] <= last)).astype(np.int64) << j
        return out

    def _mean(self, leaf: Leaf, known) -> np.ndarray | None:
        """Values by every mask of a row, over the background; None for paths of many features."""
        if len(leaf.features) > 8:
            return None
        return self._over(leaf, np.arange(1 << len(leaf.features)), known)

    def _over(self, leaf: Leaf, a: np.ndarray, known) -> np.ndarray:
        b, _, counts = known
        return np.einsum("abj,b->aj", _game(leaf, a, b, self.gain, self.loss), counts / len(self.background))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, codes = np.full(len(x), self.flat), self.codes(x)
        for leaf, span in zip(self.leaves, self.spans):
            out += leaf.value * (self.masks(span, codes) == (1 << len(span)) - 1)
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        m = self.scores(x)
        return 1.0 / (1.0 + np.exp(-2.0 * m)) if self.margin else m

    def values(self, x: np.ndarray) -> np.ndarray:
        if self.margin:
            step = max(1, _TABLE_BYTES // (8 * len(self.background) * self.dims))
            return np.concatenate([self._by_pair(x[i : i + step]) for i in range(0, len(x), step)]) if len(x) else x
        out, codes = np.zeros((self.dims, len(x))), self.codes(x)
        for leaf, span, known, mean in zip(self.leaves, self.spans, self.known, self.means):
            own = self.masks(span, codes)
            if mean is None:
                a, own = np.unique(own, return_inverse=True)
                mean = self._over(leaf, a, known)
            for j, f in enumerate(leaf.features):
                out[f] += mean[own, j]
        return out.T

    def _by_pair(self, x: np.ndarray) -> np.ndarray:
        """Margins by pair of rows, each pair's scaled to its difference in probability."""
        out, codes = np.zeros((len(x), len(self.background), self.dims)), self.codes(x)
        for leaf, span, (b, other, _) in zip(self.leaves, self.spans, self.known):
            a, own = np.unique(self.masks(span, codes), return_inverse=True)
            out[:, :, leaf.features] += _game(leaf, a, b, self.gain, self.loss)[own[:, None], other[None, :]]
        m, z = self.scores(x)[:, None], self.scores(self.background)[None, :]
        p, q = 1.0 / (1.0 + np.exp(-2.0 * m)), 1.0 / (1.0 + np.exp(-2.0 * z))
        same = np.abs(m - z) < 1e-12
        slope = np.where(same, 2.0 * p * (1.0 - p), (p - q) / np.where(same, 1.0, m - z))
        return (out * slope[:, :, None]).mean(axis=1)


def tree_attribution(
    df: DataFrame,
    background: DataFrame,
    *,
    key: str,
    features: Sequence[str],
    leaves: Sequence[Leaf],
    margin: bool = False,
    max_background: int = 200,
    raw_prefix: str | None = "raw_",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exact Shapley values of the summed leaves, on the scale of probability.

    With `margin` the leaves sum to a margin: the values are exact for the margin of every pair of a
    row and a background row, and each pair's are scaled to its difference in probability, so that
    they add up as well. `background` holds at most `max_background` rows. Null features lie above
    every threshold. `carry` names columns to put beside the values.
    """
    features = list(features)
    limit = min(max_background, MAX_BACKGROUND)
    held = background.select(*[F.col(f).cast("double") for f in features]).limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"background holds more than {limit} rows; sample it first")
    if not held:
        raise ValueError("background is empty")
    ship_package(df.sparkSession)
    work = _Attribution(leaves, np.array([tuple(r) for r in held], np.float64), len(features), margin)
    base = float(work.outputs(work.background).mean())
    sent = df.sparkSession.sparkContext.broadcast(work)  # the model and its background

    @F.pandas_udf("array<double>")
    def values(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
        return pd.Series(list(sent.value.values(x)))

    rows = df.withColumn("__phi", values(F.array(*[F.col(f).cast("double") for f in features])))
    return _long(
        rows, key, {f: F.col("__phi")[i] for i, f in enumerate(features)}, F.lit(base),
        raw=_raw_columns(df, features, raw_prefix), model={f: F.col(f) for f in features}, carry=carry,
    )
