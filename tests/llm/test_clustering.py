"""Clusters against a plain loop over whole numbers; the dictionaries hold what they were given."""

import hashlib
import math
import random

import numpy as np
import pytest

from turnlab.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, label int"


def plain(rows, clusters, rounds, dimensions):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(v))) for v in x]) for i, x in rows
            if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    kept.sort(key=lambda r: (name(r[0]), r[1]))
    centroids = [x for _, x in kept[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(v) // len(v) for v in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    last = [(i, *nearest(x)) for i, x in kept]
    total = {k: sum(d for _, d, c in last if c == k) for k in range(clusters)}
    return sorted(((i, c, d, total[c], sum(total.values()),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in last), key=str)


@pytest.mark.parametrize("dimensions, width, chunk", [(64, 2, 16_384), (6, 4, 5), (5, 1, 3)])
def test_clusters_by_plain_loop(spark, dimensions, width, chunk):
    order = random.Random(dimensions)
    values = [-0.5, -0.25, 0.0, 0.125, 1 / 3] if dimensions < 64 else None
    rows = [(i, [order.choice(values) if values else order.gauss(0, 0.1) for _ in range(dimensions)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(7, rows[8][1]), (None, rows[9][1])]  # copies, repeated and null ids
    rows += [(300, None), (301, []), (302, [0.1] * (dimensions + 1)), (303, [float("nan")] * dimensions),
             (304, [None] + [0.1] * (dimensions - 1)), (305, [float("inf")] * dimensions)]
    docs = spark.createDataFrame([(i, x, 9, 1) for i, x in rows], SCHEMA)
    for n in (8, 1):
        found = clustering.digest(clustering.cluster(docs, clusters=n, rounds=4, dimensions=dimensions, width=width, chunk=chunk))
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, n, 4, dimensions)


def test_few_none_and_too_large(spark):
    one = spark.createDataFrame([(1, [0.5] * 64, 0, 0)], SCHEMA)
    row = clustering.cluster(one).first()
    assert (row.cluster, row.distance, row.inertia, row.centroid) == (0, 0, 0, [512] * 64)
    assert clustering.digest(clustering.cluster(one.limit(0))).count() == 0
    with pytest.raises(Exception, match="larger than"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, 0)], SCHEMA)).count()


def test_dictionaries_lose_nothing():
    order = np.random.default_rng(1)
    for shape, width in (((50, 7), 3), ((1, 4), 2), ((300, 2), 1)):
        matrix = order.integers(-5, 5, shape)
        codes, sizes, words = clustering.encode(matrix, width)
        assert (clustering.decode(codes, sizes, words, shape[1], width) == matrix).all()
        centroids = order.integers(-5, 5, (4, shape[1]))
        want = ((matrix[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (clustering.distances(codes, sizes, words, centroids, width) == want).all()
