"""Centroid clustering against plain numpy."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from evalmart.llm import centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        T.StructField("q", T.StringType()), T.StructField("cluster", T.StringType()), T.StructField("distance", T.StringType())])


def vectors(size: int) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for i in range(150):
        at = rng.choice([-1.0, 0.0, 1.0])
        rows.append((i, [float(np.float32(at + rng.uniform(-0.3, 0.3))) for _ in range(size)]))
    rows += [(200, None), (201, [0.5] * (size - 1)), (202, [0.5] * (size + 1)), (203, []), (204, [None] + [0.5] * (size - 1)), (205, [math.nan] * size), (206, [math.inf] + [0.0] * (size - 1))]
    rows += [(7, rows[7][1])] * 3 + [(None, [0.25] * size), (300, [0.0] * size), (301, [-0.0] * size), (302, [1e30] * size)]
    return rows


def brute(rows: list[tuple], clusters: int, rounds: int, size: int) -> list[tuple]:
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, np.array([math.floor(max(-(2**24), min(2**24, 64 * float(np.float32(x))))) for x in v], np.int64)))
    mark = lambda k: hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest()
    cents = [v.tolist() for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1].tolist()))[:clusters]]
    assign = lambda v: min((int(((v - np.array(c, np.int64)) ** 2).sum()), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        cents = [[int(s) // len(groups[k]) for s in np.sum(groups[k], axis=0)] if k in groups else c for k, c in enumerate(cents)]
    placed = [(vec_id, *assign(v)) for vec_id, v in kept]
    total = sum(d for _, d, _ in placed)
    return [(vec_id, k, d, sum(x for _, x, j in placed if j == k), total, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for vec_id, d, k in placed]


@pytest.mark.parametrize(("clusters", "size"), [(5, 4), (16, 8), (170, 2)])
def test_clusters_equal_brute_force(spark, clusters, size):
    rows = vectors(size)
    df = spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], VECTORS).repartition(3)
    got = centroids.cluster(df, clusters=clusters, size=size)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(rows, clusters, 3, size)))


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([([0, 0], 0)], "q array<bigint>, qq bigint")
    assert df.select(centroids.nearest([[1, 0], [0, 1], [5, 5]])["cluster"]).first()[0] == 0
    assert df.select(centroids.nearest([[3, 0], [0, 1], [1, 0]])["cluster"]).first()[0] == 1


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    only_bad = spark.createDataFrame([(1, None, 1, "x", "x", "x")], VECTORS)
    assert centroids.cluster(only_bad).count() == 0
