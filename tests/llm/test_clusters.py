import hashlib
import math
import random

import numpy as np
import pytest

clusters = pytest.importorskip("lodeframe.llm.clusters")


def brute(rows, k, rounds, seed, scale, dims):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[q for _, q in kept if near(q)[1] == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centroids, strict=True)]
    out = [(i, *near(q)) for i, q in kept]
    per = [sum(d for _, d, n in out if n == c) for c in range(len(centroids))]
    return sorted((str(i), n, d, per[n], sum(per), sha(",".join(map(str, centroids[n])))) for i, d, n in out)


def test_equals_lloyd_by_hand(spark):
    rng = random.Random(2)
    hot = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, hot if i % 3 == 0 else [round(rng.gauss(0, 0.2), rng.choice([1, 6])) for _ in range(64)]) for i in range(400)]
    rows += [(1000, None), (1001, [0.1] * 63), (1002, [0.1] * 63 + [None]), (1003, [0.1] * 63 + [float("nan")]), (1004, [float("inf")] * 64), (None, [0.3] * 64), (5, [0.3] * 64), (5, [-0.3] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, q int").repartition(5)
    got = clusters.cluster(df).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, 8, 10, 3, 1024, 64)


def test_chunks_and_copies(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, -2.5, 0.25]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = clusters.cluster(df, clusters=3, rounds=4, dims=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, 3, 4, 3, 1024, 4)


def test_dictionaries_lose_nothing_and_hold_copies_once():
    rng = np.random.default_rng(0)
    for q in (rng.integers(-500, 500, (300, 64)), np.repeat(rng.integers(-9, 9, (3, 64)), 100, axis=0), rng.integers(-(2**26), 2**26, (50, 64)), np.zeros((1, 64), np.int64)):
        width, dictionaries, codes = clusters.encoded(q)
        assert (clusters.decoded(width, dictionaries, codes) == q).all()
    width, dictionaries, _ = clusters.encoded(np.repeat(rng.integers(-9, 9, (3, 64)), 1000, axis=0))
    assert width == 16 and all(len(d) <= 3 for d in dictionaries)


def test_ties_go_to_the_smaller_cluster_and_fewer_vectors_than_clusters(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert {r.cluster for r in clusters.cluster(df, dims=2).collect()} == {0}
    assert clusters.cluster(df.limit(0), dims=2).count() == 0
    assert clusters.cluster(df, dims=3).count() == 0


def test_numbers_that_a_long_cannot_hold_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(df, dims=2).collect()
