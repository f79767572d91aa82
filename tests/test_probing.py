"""Neighbours by probing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.models.knn import KnnClassifier, KnnModel
from sieveline.operators import neighbors, probing


def clustered(n, d, centers, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, d)) * 4
    return middle[rng.integers(centers, size=n)] + rng.normal(size=(n, d))


def frame(spark, vectors, first=0):
    rows = [(first + i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int")


def truth(rows, query, k):
    """Positions of the k nearest by (rounded distance, position)."""
    dist = np.round(np.sqrt(((rows - query) ** 2).sum(axis=1)), 9)
    return np.lexsort((np.arange(len(rows)), dist))[:k].tolist()


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor_id"])
    return out


def test_recall_over_split_cells(spark):
    rows = clustered(3000, 12, 25)
    index = probing.build_index(frame(spark, rows), want=11, train_id="id", vector="v", payload=["y"], cell_rows=40)
    sizes = index.cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.countDistinct("coarse").alias("coarse")).first()
    assert sizes["n"] == index.rows.count() == 3000 and sizes["cells"] > 40 and 1 < sizes["coarse"] == len(index.coarse)
    assert 1 <= index.probes < sizes["cells"] / 3
    queries = frame(spark, rows).where("id % 50 = 0")
    got = found(probing.search(queries, index, k=10, query_id="id", vector="v", exclude_same_id=True))

    assert len(got) == 60 and all(len(x) == 10 for x in got.values())
    hits = sum(len((set(truth(rows, rows[i], 11)) - {i}) & set(got[i])) for i in got)
    assert hits / 600 >= 0.9


def test_all_probes_are_exact(spark):
    rows = clustered(400, 4, 6, seed=2)
    rows[50:190] = rows[50]  # a third of the rows are one vector
    index = probing.build_index(frame(spark, rows), want=6, train_id="id", vector="v", cell_rows=16, probes=1)
    asked = np.vstack([clustered(30, 4, 6, seed=3), rows[50:51]])
    cells = index.cells.count()
    got = found(probing.search(frame(spark, asked), index, k=6, query_id="id", vector="v", probes=cells, block_rows=7))
    assert got == {i: truth(rows, q, 6) for i, q in enumerate(asked)}
    assert index.rows.count() == 400 - 140 + 6
    wide = probing.search(frame(spark, asked), index, k=2, query_id="id", vector="v", probes=cells)
    assert found(wide) == {i: t[:2] for i, t in ((i, truth(rows, q, 6)) for i, q in enumerate(asked))}


def test_distances_ranks_and_recall(spark):
    rows = clustered(200, 3, 4, seed=4)
    table = frame(spark, rows)
    index = probing.build_index(table, want=4, train_id="id", vector="v", cell_rows=20, recall=1.0)
    got = probing.search(table, index, k=3, query_id="id", vector="v", exclude_same_id=True)
    exact = neighbors.nearest(table, table, k=3, query_id="id", train_id="id", vector="v", exclude_same_id=True)
    counted = probing.recall(got, exact, query_id="id").first()
    assert counted["n_queries"] == 200 and counted["n_true"] == 600 and counted["recall"] >= 0.95
    for r in got.collect():
        assert r["distance"] == pytest.approx(np.linalg.norm(rows[r["id"]] - rows[r["neighbor_id"]]))
    with pytest.raises(ValueError):
        probing.search(table, index, k=9, query_id="id", vector="v")


def test_null_vectors_few_rows_and_no_rows(spark):
    table = spark.createDataFrame([(1, [0.0]), (2, None), (3, [5.0])], "id long, v array<double>")
    index = probing.build_index(table, want=3, train_id="id", vector="v")
    assert found(probing.search(table, index, k=3, query_id="id", vector="v")) == {1: [1, 3], 3: [3, 1]}
    assert probing.search(table.limit(0), index, k=3, query_id="id", vector="v").count() == 0
    with pytest.raises(ValueError):
        probing.build_index(table.limit(0), want=3, train_id="id", vector="v")


def test_equal_vectors_cannot_be_split(spark):
    rows = np.repeat([[1.0, 2.0], [3.0, 4.0]], 60, axis=0)
    index = probing.build_index(frame(spark, rows), want=50, train_id="id", vector="v", cell_rows=4)
    got = found(probing.search(frame(spark, rows[:1]), index, k=5, query_id="id", vector="v", block_rows=3))
    assert got == {0: [0, 1, 2, 3, 4]} and index.cells.count() == 2


def test_index_and_classifier_are_saved(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = clustered(300, 3, 5, seed=5)
    table = frame(spark, rows).select(F.col("id").alias("row_id"), array_to_vector("v").alias("features"), F.col("y").alias("label"))
    for mode in ("exact", "approximate"):
        model = KnnClassifier(k=5, weights="distance", mode=mode, recall=0.99).fit(table)
        model.write().overwrite().save(f"{tmp_path}/{mode}")
        back = KnnModel.load(f"{tmp_path}/{mode}")
        one, two = ({r["row_id"]: r["probability"][1] for r in m.transform(table).collect()} for m in (model, back))
        assert one == two and len(one) == 300
        assert all(p == (i % 2) for i, p in one.items())  # an exact match takes all the weight
    with pytest.raises(ValueError):
        KnnClassifier(mode="other").fit(table)
