"""Clustering of distinct vectors against Lloyd's rounds on all of them."""

import hashlib
import math
import random

import pytest

from docsect.llm import centroids as C


def naive(rows, k, rounds, seed, size, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in order[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    near = lambda q: min(range(len(centroids)), key=lambda c: (far(q, centroids[c]), c))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, q in kept:
            mine[near(q)].append(q)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    rows = [(i, near(q), far(q, centroids[near(q)])) for i, q in kept]
    total = sum(d for *_, d in rows)
    return [(i, c, d, sum(x for _, e, x in rows if e == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in rows]


def test_clusters_are_those_of_all_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice((-0.5, 0.25, rng.gauss(0, 1))) for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [rows[7], rows[7], (7, [0.0] * 4)]
    rows += [(1, None), (2, [1.0]), (3, [1.0, None, 1.0, 1.0]), (4, [float("nan")] * 4), (5, [float("inf")] * 4), (None, [0.5, 0.5, 0.5, 0.5]), (None, [9000.0, -9000.0, 1e5, -1e5])]
    rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, q string").repartition(3)
    for k, rounds in ((6, 3), (1, 1), (12, 0)):
        got = sorted(map(tuple, C.cluster(df, k, rounds, 2, 4, 256)[0].collect()), key=repr)
        assert got == sorted(naive(rows, k, rounds, 2, 4, 256), key=repr)


def test_few_none_and_too_large(spark):
    kind = "vec_id long, embedding array<float>"
    assert C.cluster(spark.createDataFrame([], kind), size=2)[0].collect() == []
    assert C.cluster(spark.createDataFrame([(1, [1.0])], kind), size=2)[0].collect() == []
    (row,) = C.cluster(spark.createDataFrame([(1, [1.0, 2.0])], kind), size=2)[0].collect()
    assert (row["vec_id"], row["cluster"], row["distance"], row["inertia"]) == (1, 0, 0, 0)
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e30, 2.0])], kind), size=2)
