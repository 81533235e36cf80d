"""Centroid clusters against plain loops over Python's integers."""

import hashlib
import math
import random

import pytest

from landstream.llm.centroid_clusters import Bisectors, cluster, op13_centroid_clusters


def plain(rows, k=8, rounds=10, dims=64):
    """(id, vector) rows -> sorted result rows."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) if math.isfinite(1024 * x) else int(x) * 1024 for x in v]))
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    fits = lambda n: n if n < 1 << 63 else None
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), sha[c]) for i, d, c in found), key=repr)


def of(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, inertia string, __x int")
    return sorted(map(tuple, cluster(df).collect()), key=repr)


def test_query_by_plain_loops(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op13_centroid_clusters(spark, sf_dir).collect()), key=repr)
    assert got == plain(rows)


def test_odd_rows(spark):
    """Other lengths, nulls and non-finite components go; null ids, repeated rows, ties and empty clusters are defined."""
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.25, 0.0, 0.25)) for _ in range(64)], None, 1) for i in range(60)]
    rows += [(3, rows[3][1], "x", 1), (3, rows[3][1], "y", 2), (None, rows[5][1], None, 3), (None, [9.0] * 64, None, 3)]
    rows += [(100, None, None, 0), (101, [], None, 0), (102, [1.0] * 63, None, 0), (103, [1.0] * 65, None, 0)]
    rows += [(104, [1.0] * 63 + [None], None, 0), (105, [1.0] * 63 + [math.nan], None, 0), (106, [1.0] * 63 + [-math.inf], None, 0)]
    assert of(spark, rows) == plain([r[:2] for r in rows])
    assert of(spark, rows, "float") == plain([r[:2] for r in rows])


def test_very_large_components(spark):
    """Beyond 64 bits everything is still exact, and what no long holds is null."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice((0, 6, 9, 20, 100, 307)) for _ in range(64)], None, 1) for i in range(30)]
    rows += [(50 + i, [rng.uniform(-1e6, 1e6) for _ in range(64)], None, 1) for i in range(30)]
    assert of(spark, rows) == plain([r[:2] for r in rows])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [i / 7] * 64, None, 1) for i in range(n)]
    assert of(spark, rows) == plain([r[:2] for r in rows])


def test_zero_favours_the_smaller_number():
    b = Bisectors([[0, 0], [2, 0], [0, 2], [2, 2]])
    import numpy as np

    best, far = b.assign(np.array([[1, 1], [1, 2], [2, 1], [0, 1], [2, 2]], np.int64))
    assert best.tolist() == [0, 2, 1, 0, 3] and far.tolist() == [2, 1, 1, 1, 0]
