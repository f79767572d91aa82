"""Whitening against the eigenvectors of the covariance, computed whole."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import whitening
from sieveline.llm.common import Scratch
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, components=16):
    """n, per-row deviations, variances, components (rows) and trace, from exact whole numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    rows = sorted(set(map(tuple, x)))
    n, total = len(rows), [sum(c) for c in zip(*rows)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, total)] for r in rows])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    each = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, total)] for r in x])
    return n, deviation, values[order], vectors[:, order].T, values.sum(), each


def check(got, vectors, ids, components=16):
    n, deviation, values, vecs, trace, centred = plain(vectors, components)
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(rows) == set(ids)
    want = centred @ (vecs / np.sqrt(values)[:, None]).T
    k = len(values)
    y = np.array([[rows[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((y * want).sum(0))
    assert np.allclose(y * signs, want, atol=1e-8)
    for i, d in zip(ids, deviation):
        r = rows[i]
        assert set(r) == set(range(1, k + 1))
        assert {(x["n"], x["deviation"]) for x in r.values()} == {(n, d)}
        assert all(abs(r[c + 1]["explained"] - values[c] / trace) <= 1e-9 * values[c] / trace for c in range(k))
        assert all(x["identity_error"] < 1e-9 for x in r.values())


def test_query_matches_eigenvectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(QUERIES["op13_whitening"](spark, sf).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("n,d,spread", [(300, 20, 1.0), (50, 5, 30.0), (400, 24, 1000.0)])
def test_random_vectors(spark, n, d, spread):
    rng = np.random.default_rng(d)
    data = (rng.standard_normal((n, d)) * np.geomspace(1, spread, d) + rng.standard_normal(d)).astype(np.float32)
    frame = local_frame(spark, [(i, v.tolist()) for i, v in enumerate(data)], SCHEMA).repartition(5)
    check(whitening.whitened(frame, Scratch(spark)).collect(), data.tolist(), range(n))


def test_repeated_null_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((40, 6)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(data)] + [(100 + i, data[0]) for i in range(60)]
    odd = [(900, None), (901, []), (902, [None] + data[1][1:]), (903, [float("nan")] + data[1][1:]), (904, [float("inf")] + data[1][1:])]
    frame = local_frame(spark, rows + odd, SCHEMA).select("*", F.lit("a").alias("x"), F.lit(1).alias("n"), F.lit(2).alias("component"))
    got = whitening.whitened(frame, Scratch(spark), components=4).collect()
    check(got, [v for _, v in rows], [i for i, _ in rows], components=4)
    assert whitening.whitened(frame.limit(0), Scratch(spark)).count() == 0
    assert whitening.whitened(frame.where("vec_id >= 100 and vec_id < 900"), Scratch(spark)).count() == 0  # one distinct vector
    with pytest.raises(ValueError):
        whitening.whitened(local_frame(spark, [(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), Scratch(spark))


def test_null_and_repeated_ids(spark):
    frame = local_frame(spark, [(None, [1.0, 2.0]), (1, [2.0, 5.0]), (1, [3.0, 1.0])], SCHEMA)
    got = whitening.whitened(frame, Scratch(spark)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, (200, 3))
    data = (base @ np.array([[1, 0, 0, 1, 2], [0, 1, 0, 1, -1], [0, 0, 1, 0, 1]])).astype(float)
    frame = local_frame(spark, [(i, v.tolist()) for i, v in enumerate(data)], SCHEMA)
    got = whitening.whitened(frame, Scratch(spark)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-9
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-9


def test_large_numbers_have_exact_deviations(spark):
    big = [[1e12, 0.0], [-1e12, 3.0], [5.0, 7.0]]
    frame = local_frame(spark, list(enumerate(big)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame, Scratch(spark)).collect()}
    assert got[0] is None and got[2] is not None


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 1, 1], [3, 2, 1, 0, 0, 0], [1e6, 1, 1e-3, 1e-4, 1e-5, 1e-5], [0] * 6, list(range(40, 0, -1))])
def test_bidiagonalisation_with_equal_and_missing_values(values):
    rng = np.random.default_rng(3)
    d = len(values)
    x = np.linalg.qr(rng.standard_normal((90, d)))[0] * np.array(values, float) @ np.linalg.qr(rng.standard_normal((d, d)))[0]

    def multiply(q):
        u = x @ q
        return x.T @ u, float(u @ u)

    right, singular, steps = whitening.bidiagonalise(multiply, d, d)
    assert np.allclose(singular, values, atol=1e-9 * max(1, max(values)))
    assert np.allclose(right @ right.T, np.eye(d), atol=1e-10) and steps <= d
    first, few, steps = whitening.bidiagonalise(multiply, d, 3)
    assert np.allclose(few[:3], sorted(values)[::-1][:3], atol=1e-8 * max(1, max(values)))
