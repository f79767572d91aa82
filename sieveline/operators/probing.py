"""Approximate k nearest neighbours by an inverted file of cells that queries probe.

Rows lie in cells around centroids. Coarse centroids are fitted on a bounded sample; a coarse cell
that holds more than `cell_rows` rows is split around centroids of its own, fitted from its rows, and
what is still crowded is split again, so the number of cells follows the data. A query ranks the
cells of its nearest coarse centroids and visits the nearest `probes` of all. The number of probes is
calibrated at build time: it is the least power of two with which the true neighbours of some of the
rows lie in visited cells as often as asked for. Every row is indexed. The exact search is
`operators.neighbors`.

Cells are cut into blocks and their visitors into chunks, a task returns its k best per query, and
the window that merges them cuts to k before its shuffle, so pairs are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline import config as C
from sieveline.functions.exprs import seeded_hash
from sieveline.operators.neighbors import DISTANCE_DIGITS, _best, _distances, _matrix
from sieveline.session import local_frame, ship_package, small, written

#: Bytes of the sample that coarse centroids are fitted on, and most coarse cells or parts of a cell.
SAMPLE_BYTES = 32 << 20
MOST_CELLS = 1024
#: Rows per centroid in a fit, steps of a fit, rounds of splitting, rows that calibrate the probes.
FIT_ROWS, FIT_STEPS, ROUNDS, CALIBRATED = 48, 8, 3, 128


@dataclass
class ProbeIndex:
    """rows: (t_id, t_vec, payload..., cell); cells: (coarse, cell, center, n); both written tables."""

    rows: DataFrame
    cells: DataFrame
    payload: list[str]
    want: int
    coarse: np.ndarray
    probes: int

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.cells.write.parquet(f"{path}/cells")
        about = [(self.want, self.probes, i, c.tolist()) for i, c in enumerate(self.coarse)]
        local_frame(self.rows.sparkSession, about, _COARSE).coalesce(1).write.parquet(f"{path}/coarse")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProbeIndex:
        rows = spark.read.parquet(f"{path}/rows")
        about = spark.read.schema(_COARSE).parquet(f"{path}/coarse").orderBy("coarse").collect()  # at most MOST_CELLS
        payload = [c for c in rows.columns if c not in ("t_id", "t_vec", "cell")]
        coarse = _matrix([r["center"] for r in about])
        return cls(rows, spark.read.parquet(f"{path}/cells"), payload, about[0]["want"], coarse, about[0]["probes"])


_COARSE = "want int, probes int, coarse int, center array<double>"


def centroids(rows: np.ndarray, k: int, seed: int = C.SEED, steps: int = FIT_STEPS) -> np.ndarray:
    """At most `k` centroids of `rows` by Lloyd's steps from spread-out starts; empty ones go."""
    rng = np.random.default_rng(seed)
    rows = rows[np.lexsort(rows.T[::-1])]  # whatever order the rows came in
    picks = [int(rng.integers(len(rows)))]
    gap = np.square(rows - rows[picks[0]]).sum(1)
    while len(picks) < min(k, len(rows)) and gap.max() > 0:
        picks.append(int(rng.choice(len(rows), p=gap / gap.sum())))
        gap = np.minimum(gap, np.square(rows - rows[picks[-1]]).sum(1))
    centers = rows[picks]
    for _ in range(steps):
        own = _nearest(rows, centers)
        sizes = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = sums[sizes > 0] / sizes[sizes > 0, None]
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Position of each row's nearest center."""
    own, squares = np.empty(len(rows), np.int64), np.square(centers).sum(1)
    step = max(1, 2_000_000 // len(centers))
    for i in range(0, len(rows), step):
        own[i : i + step] = (squares - 2.0 * rows[i : i + step] @ centers.T).argmin(1)
    return own


def _split(placed: DataFrame, sizes: DataFrame, cell_rows: int, seed: int) -> DataFrame:
    """`placed` with the cells in `sizes` (cell, n) split around centroids of their own rows."""
    columns = placed.columns
    parts = F.least(F.ceil(F.col("n") / cell_rows), F.lit(MOST_CELLS)).cast("int")
    sizes = sizes.select("cell", parts.alias("parts"), F.ceil(F.col("n") / (16 * cell_rows)).cast("int").alias("shares"))
    sizes = small(sizes)
    crowded = placed.join(sizes, "cell")
    order = Window.partitionBy("cell").orderBy(seeded_hash(seed, F.col("t_id")), "t_id")
    sample = crowded.withColumn("i", F.row_number().over(order)).where(F.col("i") <= MOST_CELLS * FIT_ROWS)
    sample = sample.where(F.col("i") <= F.col("parts") * FIT_ROWS).select("cell", "parts", "t_vec")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        found = centroids(_matrix(group["t_vec"]), int(group["parts"].iloc[0]), seed)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "centers": [[c.tolist() for c in found]]})

    centers = sample.groupBy("cell").applyInPandas(fitted, "cell string, centers array<array<double>>")
    centers = written(centers, "probe-centers").join(sizes, "cell")
    centers = centers.select("cell", "centers", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = crowded.withColumn("share", F.pmod(F.xxhash64("t_id"), F.col("shares")).cast("int")).drop("parts", "shares")

    def assigned(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(rows):
            near = _nearest(_matrix(rows["t_vec"]), _matrix(own["centers"].iloc[0]))
            rows = rows.assign(cell=[f"{c}.{i}" for c, i in zip(rows["cell"], near)])
        return rows[columns]

    moved = dealt.groupBy("cell", "share").cogroup(centers.groupBy("cell", "share")).applyInPandas(assigned, placed.schema)
    return placed.join(sizes, "cell", "left_anti").select(columns).union(moved)


def build_index(
    train: DataFrame,
    *,
    want: int,
    train_id: str,
    vector: str,
    payload: Sequence[str] = (),
    cell_rows: int = 1024,
    recall: float = 0.95,
    probes: int | None = None,
    seed: int = C.SEED,
) -> ProbeIndex:
    """Index for searches of up to `want` rows; with `probes` None they are calibrated to `recall`.

    Of equal vectors only the `want` smallest ids can be neighbours and are kept. Rows with a null
    vector are left out. ValueError without rows.
    """
    spark = train.sparkSession
    ship_package(spark)
    payload = list(payload)
    train = train.select(F.col(train_id).alias("t_id"), F.col(vector).cast("array<double>").alias("t_vec"), *payload)
    copies = Window.partitionBy("t_vec").orderBy("t_id")
    train = train.where("t_vec is not null").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= want)
    train = written(train.drop("copy"), "probe-train")
    first = train.select(F.size("t_vec").alias("d")).first()
    if first is None:
        raise ValueError("no training rows")
    n = train.count()
    limit = max(1, SAMPLE_BYTES // (8 * max(1, first["d"])))
    m = max(1, min(MOST_CELLS, limit // FIT_ROWS, math.ceil(math.sqrt(n / cell_rows))))
    sample = train.select("t_vec", seeded_hash(seed, F.col("t_id")).alias("h"), "t_id").orderBy("h", "t_id").limit(m * FIT_ROWS)
    coarse = centroids(_matrix([r["t_vec"] for r in sample.collect()]), m, seed)  # SAMPLE_BYTES at most

    @F.pandas_udf("string")
    def place(vectors: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_matrix(vectors), coarse).astype(str))

    placed = written(train.select("t_id", "t_vec", *payload, place("t_vec").alias("cell")), "probe-rows")
    for turn in range(ROUNDS):
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        sizes = written(sizes.where(F.col("n") > cell_rows * (1 if turn == 0 else 4)), "probe-crowded")
        if sizes.isEmpty():
            break
        placed = written(_split(placed, sizes, cell_rows, seed + turn), "probe-rows")

    # the centers of the cells as they are now: means of their rows, entry by entry
    by_entry = placed.select("cell", F.posexplode("t_vec").alias("i", "v")).groupBy("cell", "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    center = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    cells = by_entry.groupBy("cell").agg(center.alias("center"), F.max("n").alias("n"))
    coarse_of = F.substring_index("cell", ".", 1).cast("int")
    cells = written(cells.select(coarse_of.alias("coarse"), "cell", "center", "n"), "probe-cells")
    index = ProbeIndex(placed, cells, payload, want, coarse, probes or 1)
    if probes is None:
        _calibrate(index, recall, seed)
    return index


def _calibrate(index: ProbeIndex, recall: float, seed: int) -> None:
    """Set the probes with which true neighbours of CALIBRATED rows lie in visited cells."""
    chosen = index.rows.select("t_id", "t_vec", seeded_hash(seed + 1, F.col("t_id")).alias("h")).orderBy("h", "t_id").limit(CALIBRATED)
    kind = index.rows.schema["t_id"].dataType.simpleString()
    rows = chosen.select("t_id", "t_vec").collect()  # CALIBRATED rows at most
    q_ids, q_vecs, want = [r["t_id"] for r in rows], _matrix([r["t_vec"] for r in rows]), index.want

    def scanned(batches):
        for batch in batches:
            if len(batch):
                t_ids, cells = batch["t_id"].to_numpy(), batch["cell"].to_numpy()
                for q, dist in zip(q_ids, _distances(q_vecs, _matrix(batch["t_vec"]))):
                    pick = _best(dist, t_ids, want + 1)
                    yield pd.DataFrame({"q_id": q, "t_id": t_ids[pick], "cell": cells[pick], "distance": dist[pick]})

    best = index.rows.select("t_id", "t_vec", "cell").mapInPandas(scanned, f"q_id {kind}, t_id {kind}, cell string, distance double")
    place = Window.partitionBy("q_id").orderBy(F.round("distance", DISTANCE_DIGITS), "t_id")
    best = best.where("q_id <> t_id").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= want)
    truth = written(best.select("q_id", "cell"), "probe-truth")
    total, all_cells = truth.count(), index.cells.count()
    asked = local_frame(index.rows.sparkSession, [(i, v.tolist()) for i, v in zip(q_ids, q_vecs)], f"q_id {kind}, q_vec array<double>")
    probes = 1
    while probes < all_cells:
        met = truth.join(_visits(asked, index, probes).select("q_id", "cell"), ["q_id", "cell"], "left_semi").count()
        if met >= recall * total:
            break
        probes *= 2
    index.probes = min(probes, all_cells)


def _visits(asked: DataFrame, index: ProbeIndex, probes: int, chunk_rows: int = 4096) -> DataFrame:
    """(q_id, q_vec, cell) of the cells that each of `asked` (q_id, q_vec) visits."""
    coarse = index.coarse
    reach = min(len(coarse), probes)

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        order = np.argsort(_distances(_matrix(vectors), coarse), axis=1, kind="stable")[:, :reach]
        return pd.Series(list(order.astype("int32")))

    spark = asked.sparkSession
    dealt = written(asked.select("q_id", "q_vec", F.explode(near("q_vec")).alias("coarse")), "probe-asked")
    chunks = dealt.groupBy("coarse").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")).collect()
    plan = F.broadcast(local_frame(spark, [tuple(r) for r in chunks], "coarse int, chunks int"))  # a row per coarse cell
    left = dealt.join(plan, "coarse").withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.col("chunks")).cast("int")).drop("chunks")
    right = index.cells.join(plan, "coarse").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    kind = asked.schema["q_id"].dataType.simpleString()

    def ranked(qs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cells.empty:
            return pd.DataFrame({"q_id": [], "q_vec": [], "cell": [], "gap": []})
        dist = _distances(_matrix(qs["q_vec"]), _matrix(cells["center"]))
        order = np.argsort(dist, axis=1, kind="stable")[:, :probes]
        rows = np.repeat(np.arange(len(qs)), order.shape[1])
        out = qs[["q_id", "q_vec"]].iloc[rows].reset_index(drop=True)
        return out.assign(cell=cells["cell"].to_numpy()[order.ravel()], gap=np.take_along_axis(dist, order, 1).ravel())

    met = left.groupBy("coarse", "chunk").cogroup(right.groupBy("coarse", "chunk")).applyInPandas(
        ranked, f"q_id {kind}, q_vec array<double>, cell string, gap double"
    )
    place = Window.partitionBy("q_id").orderBy("gap", "cell")
    return met.withColumn("i", F.row_number().over(place)).where(F.col("i") <= probes).select("q_id", "q_vec", "cell")


def search(
    queries: DataFrame,
    index: ProbeIndex,
    *,
    k: int,
    query_id: str,
    vector: str,
    exclude_same_id: bool = False,
    probes: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """(query_id, neighbor_id, distance, rank, payload...) with ties by neighbour id, among the rows
    of the visited cells. Query ids are unique; queries with a null vector have no rows."""
    ship_package(queries.sparkSession)
    want = k + 1 if exclude_same_id else k
    if want > index.want:
        raise ValueError(f"the index serves searches of {index.want} rows, not {want}")
    asked = queries.select(F.col(query_id).alias("q_id"), F.col(vector).cast("array<double>").alias("q_vec")).where("q_vec is not null")
    visits = written(_visits(asked, index, probes or index.probes), "probe-visits")
    visitors = visits.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    plan = visitors.join(index.cells.select("cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "cell")
    plan = small(written(plan, "probe-plan"))  # a row per visited cell, which grows with the data
    one_of = lambda column, total: F.pmod(F.xxhash64(column), F.col(total)).cast("int")
    all_of = lambda total: F.explode(F.sequence(F.lit(0), F.col(total) - 1))
    payload = index.payload
    left = visits.join(plan, "cell").select("q_id", "q_vec", "cell", one_of("q_id", "chunks").alias("chunk"), all_of("blocks").alias("block"))
    right = index.rows.join(plan, "cell").select("t_id", "t_vec", *payload, "cell", one_of("t_id", "blocks").alias("block"), all_of("chunks").alias("chunk"))
    kinds = dict(index.rows.dtypes)
    schema = ", ".join([f"q_id {visits.schema['q_id'].dataType.simpleString()}", f"t_id {kinds['t_id']}", "distance double", *(f"{c} {kinds[c]}" for c in payload)])

    def block_best(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ts.empty:
            return pd.DataFrame({c: [] for c in ["q_id", "t_id", "distance", *payload]})
        t_ids, dist = ts["t_id"].to_numpy(), _distances(_matrix(qs["q_vec"]), _matrix(ts["t_vec"]))
        picks = [_best(d, t_ids, want) for d in dist]
        rows = np.concatenate(picks)
        hits = ts[["t_id", *payload]].iloc[rows].reset_index(drop=True)
        owner = np.repeat(np.arange(len(qs)), [len(p) for p in picks])
        hits.insert(0, "q_id", qs["q_id"].to_numpy()[owner])
        hits["distance"] = dist[owner, rows]
        return hits[["q_id", "t_id", "distance", *payload]]

    keys = ["cell", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_best, schema)
    if exclude_same_id:
        found = found.where(F.col("q_id") != F.col("t_id"))
    place = Window.partitionBy("q_id").orderBy(F.round("distance", DISTANCE_DIGITS), "t_id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select(F.col("q_id").alias(query_id), F.col("t_id").alias("neighbor_id"), "distance", "rank", *payload)


def recall(found: DataFrame, truth: DataFrame, *, query_id: str) -> DataFrame:
    """One row: n_queries and n_true of the `truth`, n_met of them in `found`, and their share."""
    met = F.lit(1).alias("met")
    both = truth.select(query_id, "neighbor_id").join(found.select(query_id, "neighbor_id", met), [query_id, "neighbor_id"], "left")
    return both.agg(
        F.countDistinct(query_id).alias("n_queries"), F.count("*").alias("n_true"), F.count("met").alias("n_met"),
        (F.count("met") / F.count("*")).alias("recall"),
    )
