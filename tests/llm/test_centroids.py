"""Clustering against Lloyd's rounds over all vectors in Python's whole numbers, and against SQL."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lethe.llm import centroids as C

from ..support import TESTDATA, duck

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters, rounds, components):
    kept = [(i, tuple(math.floor(float(np.float32(x)) * C.SCALE) for x in e)) for i, e in rows
            if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:clusters]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    if not c:
        return []
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for k in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            if own:
                c[k] = tuple(sum(x) // len(own) for x in zip(*own))
    out = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, k, d in out:
        inertia[k] += d
    return [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in out]


def vectors(n, components, seed, scale=2.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(components)]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(n // 2)]  # a third of all rows are copies of three vectors
    odd = [(9001, None), (9002, [1.0] * (components - 1)), (9003, [1.0] * (components - 1) + [None]), (9004, [float("nan")] * components),
           (9005, [float("inf")] + [0.0] * (components - 1)), (None, [0.5] * components), (7, rows[min(7, n - 1)][1])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)


@pytest.mark.parametrize("hot_share", [C.HOT_SHARE, 3])
def test_clusters_equal_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(C, "HOT_SHARE", hot_share)
    rows = vectors(60, 5, 1)
    got = C.cluster(frame(spark, rows), 4, 6, components=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, 4, 6, 5), key=str)


@pytest.mark.parametrize("scale", [1e5, 1e9])
def test_large_components_are_exact(spark, scale):
    rows = [(i, [x * scale for x in e]) for i, e in vectors(12, 3, 2)[:12]]
    assert sorted(map(tuple, C.cluster(frame(spark, rows), 3, 4, components=3).collect())) == [
        (*r[:2], *(min(x, C.LARGEST) for x in r[2:5]), r[5]) for r in sorted(brute(rows, 3, 4, 3))]


def test_few_and_no_vectors(spark):
    two = C.cluster(frame(spark, vectors(2, 4, 3)[:2]), components=4).collect()
    assert sorted((r.vec_id, r.distance) for r in two) == [(0, 0), (1, 0)] and {r.cluster for r in two} == {0, 1}
    none = C.cluster(frame(spark, []), components=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert C.cluster(frame(spark, vectors(5, 4, 4)).withColumnRenamed("label", "cluster"), components=4).count() == 9


def test_query_equals_sql(spark):
    names, rows = duck(TESTDATA, C.OP13_SQL)
    got = C.op13_centroids(spark, TESTDATA)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))
