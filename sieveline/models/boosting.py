"""Gradient boosting over binned features, trees grown best leaf first (M6).

Features are cut into at most `max_bins` bins once, and rows are kept in blocks of small whole
numbers with their score so far. A pass over the blocks gives the gradient sums by (leaf, feature,
bin) of all leaves asked for; tasks add up their own blocks, and Spark the tasks. The driver picks
splits: always the open leaf with the largest gain, up to `max_leaf_nodes` leaves. A pass serves
every leaf that may be split next, and only the smaller child of a split is counted, the other one
being what is left of its parent, so a tree takes about as many passes as it has levels.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.trees import Leaf, leaves_of
from sieveline.session import ship_package, written

_BLOCK = 1 << 14
#: Trees after which the rows' scores are written anew; passes add the trees since then.
_KEEP = 10
#: Up to so many tasks their sums are added on the driver; beyond, Spark adds them first.
_FEW_TASKS = 32
_BLOCKS = "n int, bins binary, y binary, score binary"


def bin_edges(df: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Cuts by feature of the vectors in `x`: a value lies in the bin of the first cut it does not
    exceed. Columns of few values get one bin a value, others quantiles."""
    cols = [F.col("x")[i] for i in range(d)]
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(d) if row[f"n{i}"] <= max_bins * 1.1]
    sets = df.agg(*[F.array_sort(F.collect_set(cols[i])).alias(f"v{i}") for i in few]).first() if few else {}
    values = {i: np.array(sets[f"v{i}"]) for i in few}  # about max_bins each
    many = [i for i in range(d) if len(values.get(i, range(max_bins + 1))) > max_bins]
    if many:
        shares = [k / max_bins for k in range(1, max_bins)]
        found = df.agg(*[F.percentile_approx(cols[i], shares, 100 * max_bins).alias(f"q{i}") for i in many]).first()
        values |= {i: np.append(np.unique(found[f"q{i}"]), np.inf) for i in many}
    return [values[i][:-1].astype(np.float64) for i in range(d)]


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each entry, a row per feature. What is no number lies above all cuts."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


@dataclass
class Tree:
    """Nodes by position; `feature` is -1 in leaves. Bins up to `cut` go left."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(codes.shape[1], np.int64)
        rows = np.flatnonzero(feature[at] >= 0)
        while len(rows):
            here = at[rows]
            at[rows] = np.where(codes[feature[here], rows] <= cut[here], left[here], right[here])
            rows = rows[feature[at[rows]] >= 0]
        return at

    def add(self, codes: np.ndarray, score: np.ndarray) -> None:
        score += np.array(self.value)[self.leaf_of(codes)]


def _unpacked(batch, i: int, d: int):
    n = batch.column(0)[i].as_py()
    codes = np.frombuffer(batch.column(1)[i].as_py(), np.uint8).reshape(d, n)
    y, score = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in (2, 3))
    return codes, y, score


def _packed(codes, y, score) -> pa.RecordBatch:
    cells = [pa.array([b], pa.binary()) for b in (np.ascontiguousarray(codes).tobytes(), y.tobytes(), score.tobytes())]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *cells], names=["n", "bins", "y", "score"])


@dataclass
class _Grown:
    """A tree while it grows: sums by node and bin, and the best split of each."""

    tree: Tree
    sums: dict[int, np.ndarray]  # node -> (features, bins, [gradient, hessian, rows])
    split: dict[int, tuple[float, int, int] | None]


def _best_split(sums: np.ndarray, min_rows: int, min_hessian: float = 1e-3) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the best split; ties go to the first feature and cut."""
    left = sums.cumsum(axis=1)
    total = left[0, -1]
    right = total - left
    ok = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] > min_hessian) & (right[..., 1] > min_hessian)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[0] ** 2 / total[1]
    gain = np.round(np.where(ok, gain, -np.inf), 9)
    at = int(gain.argmax())
    feature, cut = divmod(at, sums.shape[1])
    return (float(gain.flat[at]), feature, cut) if gain.flat[at] > 0 else None


class Booster:
    """A fit over written blocks: `blocks` as in _BLOCKS, the start score, and how trees grow."""

    def __init__(self, blocks: DataFrame, d: int, bins: int, leaves: int, rate: float, min_rows: int):
        self.blocks, self.d, self.bins, self.tasks = blocks, d, bins, blocks.rdd.getNumPartitions()
        self.leaves, self.rate, self.min_rows = leaves, rate, min_rows
        self.trees: list[Tree] = []
        self.recent: list[Tree] = []

    def sums(self, tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        """Gradient, hessian and rows by (feature, bin) of the rows in `nodes` of `tree`: at most
        leaves x features x bins sums reach the driver."""
        d, bins, recent = self.d, self.bins, list(self.recent)
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))

        def run(batches):
            out = np.zeros((3, len(nodes) * d * bins))
            for batch in batches:
                for i in range(batch.num_rows):
                    codes, y, score = _unpacked(batch, i, d)
                    score = score.copy()
                    for t in recent:
                        t.add(codes, score)
                    own = place[tree.leaf_of(codes)]
                    rows = own >= 0
                    p = 1.0 / (1.0 + np.exp(-score[rows]))
                    parts = (p - y[rows], p * (1.0 - p), None)
                    for f in range(d):
                        cell = (own[rows] * d + f) * bins + codes[f, rows]
                        for k, part in enumerate(parts):
                            out[k] += np.bincount(cell, part, minlength=out.shape[1])
            there = np.flatnonzero(out[2])
            yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(v[there]) for v in out)], names=["i", "g", "h", "n"])

        found = self.blocks.mapInArrow(run, "i long, g double, h double, n double")
        if self.tasks > _FEW_TASKS:
            found = found.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        table = found.toArrow()
        out = np.zeros((len(nodes) * d * bins, 3))
        np.add.at(out, table.column("i").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("g", "h", "n")], axis=1))
        return dict(zip(nodes, out.reshape(len(nodes), d, bins, 3)))

    def grow(self) -> Tree | None:
        """The next tree, best leaf first; None if no split gains."""
        tree = Tree([-1], [0], [-1], [-1], [0.0])
        known = _Grown(tree, self.sums(tree, [0]), {})
        known.split[0] = _best_split(known.sums[0], self.min_rows)
        if known.split[0] is None:
            return None
        while True:
            chosen, waiting = self._chosen(known)
            if not waiting:
                break
            self._expand(known, waiting)
        return self._pruned(known, chosen)

    def _chosen(self, known: _Grown) -> tuple[set[int], list[int]]:
        """The nodes that best-first growth splits as far as it is known, and, where it meets one
        whose children are not counted yet, the open nodes to count: that one and the next best."""
        queue = [(-known.split[0][0], 0)]
        chosen: set[int] = set()
        while queue and len(chosen) < self.leaves - 1:
            room = self.leaves - 1 - len(chosen)
            if room > 1 and known.tree.left[queue[0][1]] < 0:
                return chosen, [node for _, node in heapq.nsmallest(room, queue) if known.tree.left[node] < 0]
            _, node = heapq.heappop(queue)
            chosen.add(node)
            if room == 1:  # nothing is split below it
                break
            for child in (known.tree.left[node], known.tree.right[node]):
                if known.split[child] is not None:
                    heapq.heappush(queue, (-known.split[child][0], child))
        return chosen, []

    def _expand(self, known: _Grown, nodes: list[int]) -> None:
        """Give `nodes` their children, with sums and best splits, in one pass."""
        tree, smaller = known.tree, {}
        for node in nodes:
            _, feature, cut = known.split[node]
            tree.feature[node], tree.cut[node] = feature, cut
            tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
            for values, empty in ((tree.feature, -1), (tree.cut, 0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0)):
                values += [empty, empty]
            rows = known.sums[node][feature, :, 2]
            smaller[node] = tree.left[node] if rows[: cut + 1].sum() * 2 <= rows.sum() else tree.right[node]
        counted = self.sums(tree, list(smaller.values()))
        for node, child in smaller.items():
            other = tree.left[node] + tree.right[node] - child
            known.sums[child], known.sums[other] = counted[child], known.sums[node] - counted[child]
            for c in (child, other):
                known.split[c] = _best_split(known.sums[c], self.min_rows)

    def _pruned(self, known: _Grown, chosen: set[int]) -> Tree:
        """The tree of the chosen splits, with leaf values."""
        out, tree = Tree([], [], [], [], []), known.tree

        def put(feature: int, cut: int, sums: np.ndarray) -> int:
            """A node, as a leaf of the rows with these sums."""
            for values, v in ((out.feature, feature), (out.cut, cut), (out.left, -1), (out.right, -1)):
                values.append(v)
            out.value.append(0.0 if feature >= 0 else float(-self.rate * sums[0] / sums[1]))
            return len(out.feature) - 1

        def copy(node: int) -> int:
            sums = known.sums[node]
            if node not in chosen:
                return put(-1, 0, sums[0].sum(axis=0))
            _, feature, cut = known.split[node]
            at = put(feature, cut, sums[0].sum(axis=0))
            if tree.left[node] >= 0:
                out.left[at], out.right[at] = copy(tree.left[node]), copy(tree.right[node])
            else:  # the last split, whose children were not counted
                parts = sums[feature, : cut + 1].sum(axis=0), sums[feature, cut + 1 :].sum(axis=0)
                out.left[at], out.right[at] = put(-1, 0, parts[0]), put(-1, 0, parts[1])
            return at

        copy(0)
        return out

    def step(self) -> bool:
        """One more tree; False if none helps."""
        tree = self.grow()
        if tree is None:
            return False
        self.trees.append(tree)
        self.recent.append(tree)
        if len(self.recent) == _KEEP:
            d, recent = self.d, list(self.recent)

            def run(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        codes, y, score = _unpacked(batch, i, d)
                        score = score.copy()
                        for t in recent:
                            t.add(codes, score)
                        yield _packed(codes, y, score)

            self.blocks = written(self.blocks.mapInArrow(run, _BLOCKS), "boost-blocks")
            self.recent = []
        return True


class HistBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Summed trees over cut values; probability 1 / (1 + exp(-score))."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "score before any tree", TypeConverters.toFloat)
    state = Param(Params._dummy(), "state", "cuts and trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features")

    def parts(self) -> tuple[list[np.ndarray], list[Tree]]:
        state = json.loads(self.getOrDefault("state"))
        return [np.array(e, np.float64) for e in state["edges"]], [Tree(**t) for t in state["trees"]]

    def leaves(self) -> list[Leaf]:
        """Boxes whose sum is half the score, the margin m of probability 1 / (1 + exp(-2 m))."""
        edges, trees = self.parts()
        out = [Leaf((), (), (), self.getOrDefault("start") / 2.0)]
        for t in trees:
            inner = lambda i, t=t: {"feature": t.feature[i], "threshold": edges[t.feature[i]][t.cut[i]], "left": t.left[i], "right": t.right[i]}
            nodes = [{"id": i, **(inner(i) if t.feature[i] >= 0 else {"value": t.value[i]})} for i in range(len(t.feature))]
            out += leaves_of(nodes, 0.5)
        return out

    def _transform(self, df):
        ship_package(df.sparkSession)
        (edges, trees), start = self.parts(), self.getOrDefault("start")

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            codes = _codes(np.stack([np.asarray(v, np.float64) for v in vectors]), edges)
            out = np.full(len(vectors), start)
            for t in trees:
                t.add(codes, out)
            return pd.Series(out)

        z = F.col("__z")
        p = 1.0 / (1.0 + F.exp(-z))
        out = df.withColumn("__z", score(vector_to_array(self.getOrDefault("featuresCol"))))
        return out.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-z, z)),
                "probability": array_to_vector(F.array(1.0 - p, p)),
                "prediction": F.when(z > 0, 1.0).otherwise(0.0),
            }
        ).drop("__z")


class HistBoosting(Estimator):
    """Log-loss boosting for labels 0 and 1, without row weights."""

    learningRate = Param(Params._dummy(), "learningRate", "share of a leaf's step that is taken", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    maxLeafNodes = Param(Params._dummy(), "maxLeafNodes", "leaves of a tree", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "rows of a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 255", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, learningRate=0.1, maxIter=100, maxLeafNodes=31, minRows=20, maxBins=255, featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(learningRate=0.1, maxIter=100, maxLeafNodes=31, minRows=20, maxBins=255, featuresCol="features", labelCol="label")

    def _fit(self, df):
        get = self.getOrDefault
        if not 2 <= get("maxBins") <= 255 or get("maxLeafNodes") < 2:
            raise ValueError("maxBins lies in 2..255, and a tree has two leaves at least")
        ship_package(df.sparkSession)
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y"))
        row = rows.agg(F.avg("y").alias("p"), F.max(F.size("x")).alias("d")).first()
        if row["p"] is None or not 0 < row["p"] < 1:
            raise ValueError("expected rows of both labels")
        d, start = row["d"], math.log(row["p"] / (1.0 - row["p"]))
        edges = bin_edges(rows, d, get("maxBins"))

        def pack(batches):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for at in range(0, len(x), _BLOCK):
                    part = y[at : at + _BLOCK]
                    yield _packed(_codes(x[at : at + _BLOCK], edges), part, np.full(len(part), start))

        blocks = written(rows.mapInArrow(pack, _BLOCKS), "boost-blocks")
        booster = Booster(blocks, d, max(len(e) for e in edges) + 1, get("maxLeafNodes"), get("learningRate"), get("minRows"))
        for _ in range(get("maxIter")):
            if not booster.step():
                break
        state = json.dumps({"edges": [e.tolist() for e in edges], "trees": [vars(t) for t in booster.trees]})
        return HistBoostingModel()._set(featuresCol=get("featuresCol"), start=start, state=state)
