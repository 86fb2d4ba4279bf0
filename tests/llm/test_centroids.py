"""Clustering with bounds against assignments by all distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import centroids


def by_hand(rows, clusters, rounds):
    """``[(id, cluster, distance)]`` and centroids, in Python's integers."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [list(x) for _, x in first]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for _ in range(rounds):
        members = [[] for _ in c]
        for _, x in rows:
            members[min(range(len(c)), key=lambda j: (far(x, c[j]), j))].append(x)
        c = [[sum(v) // len(m) for v in zip(*m, strict=True)] if m else old for m, old in zip(members, c, strict=True)]
    out = []
    for i, x in rows:
        j = min(range(len(c)), key=lambda j: (far(x, c[j]), j))
        out.append((i, j, far(x, c[j])))
    return out, c


def table(spark, rows):
    return spark.createDataFrame([(i, list(x)) for i, x in rows], "vec_id long, x array<int>").repartition(3)


def some_rows(kind, dims, n):
    rng = random.Random(n + dims)
    size = {"lattice": 2, "wide": 300, "extreme": centroids.MOST}[kind]
    return [(i, [rng.choice([-size, size, rng.randint(-size, size)]) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("kind", "dims", "n", "clusters", "bounds"), [("lattice", 2, 120, 8, None), ("lattice", 3, 150, 9, 5), ("wide", 4, 200, 12, 4), ("extreme", 64, 40, 5, 1), ("wide", 1, 90, 6, 0), ("lattice", 2, 5, 8, None)])
def test_bounds_change_no_assignment(spark, kind, dims, n, clusters, bounds):
    """On lattices most distances tie, so anything but exact order shows."""
    rows = some_rows(kind, dims, n)
    want, c = by_hand(rows, clusters, 6)
    found, got = centroids.clustered(table(spark, rows), clusters, 6, bounds)
    assert got.tolist() == c
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(want)


def test_bounds_hold_while_centroids_move():
    """After any moves, each bound is below its distance, and settling finds the nearest."""
    rng = np.random.default_rng(4)
    for trial in range(40):
        k, dims = int(rng.integers(2, 12)), int(rng.integers(1, 5))
        b = int(rng.integers(0, k))
        c, x = rng.integers(-9, 10, (k, dims)), rng.integers(-9, 10, (60, dims))
        held = centroids.Bounded.scanned(x, c, b)
        for _ in range(8):
            more = c + rng.integers(-1, 2, c.shape) * (rng.random((k, 1)) < 0.4)
            way, c = centroids._above(((more - c) ** 2).sum(axis=1)), more
            held.moved(way)
            d = np.sqrt(centroids.distances(x, c))
            rest = np.ones(d.shape, bool)
            np.put_along_axis(rest, held.near.astype(int), False, axis=1)
            assert (held.upper >= np.take_along_axis(d, held.near[:, :1].astype(int), axis=1)[:, 0]).all()
            assert (held.lower[:, :-1] <= np.take_along_axis(d, held.near[:, 1:].astype(int), axis=1)).all()
            assert (held.lower[:, -1:] <= np.where(rest, d, np.inf)).all()
            held.settled(c)
            assert (held.near[:, 0] == np.argmin(centroids.distances(x, c), axis=1)).all()
            if trial % 2:
                held.kept(max(0, held.near.shape[1] - 2))


def test_vectors_that_stay_need_no_distance(monkeypatch):
    rng = np.random.default_rng(1)
    c = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    x = c[rng.integers(0, 4, 500)] + rng.integers(-20, 20, (500, 2))
    held = centroids.Bounded.scanned(x, c, 1)
    held.moved(np.full(4, 5.0))
    measured = []
    monkeypatch.setattr(centroids, "own_distances", lambda *a: measured.append(1))
    monkeypatch.setattr(centroids, "distances", lambda *a: measured.append(1))
    assert held.settled(c + 3) == 0 and not measured


def test_bounds_adapt_and_state_takes_two_paths(spark, monkeypatch):
    rows = some_rows("wide", 3, 300)
    asked, paths = [], set()
    passed, stored = centroids.passed, centroids._stored
    monkeypatch.setattr(centroids, "passed", lambda *a: asked.append(a[3]) or passed(*a))
    monkeypatch.setattr(centroids, "_stored", lambda df, path: paths.add(path) or stored(df, path))
    centroids.clustered(table(spark, rows), 16, 6, 9)
    assert asked[0] == 9 and asked == sorted(asked, reverse=True) and min(asked) >= 2 and len(paths) == 2


def test_whole_vectors_are_scaled_and_others_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, -0.0001, 1.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, -inf, 0.0]), (None, [-1.00001, 3e38, -3e38]), (1, [0.5, -0.0001, 1.0])]
    given = spark.createDataFrame([(i, v, "clash", 1) for i, v in vectors], "vec_id long, embedding array<float>, x string, cluster int")
    found = centroids.scaled(given, dims=3)
    want = lambda v: [max(-centroids.MOST, min(centroids.MOST, math.floor(1024 * float(np.float32(e))))) for e in v]
    assert sorted((str(r.vec_id), r.x) for r in found.collect()) == sorted((str(vectors[k][0]), want(vectors[k][1])) for k in (0, 6, 7))
    # Repeated rows and a null id are vectors of their own.
    assert centroids.clustered(found, 8, 2)[0].count() == 3


def test_no_vectors_no_clusters(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, c = centroids.clustered(centroids.scaled(none))
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and len(c) == 0


def test_the_query_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = centroids.op12_centroid_clustering(spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0
