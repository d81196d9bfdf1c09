import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattisect.llm import clusters


def brute(rows, components, k, rounds):
    """k-means over (id, vector) in plain Python."""
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for c in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            centroids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    return [(i, near(v), apart(v, centroids[near(v)])) for i, v in kept], centroids


def some(n, components, seed, spread=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(components)] for _ in range(spread)]
    return [(i, [rng.gauss(m, 0.4) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "rounds", "block"), [(700, 8, 6, 100), (300, 16, 3, 8192), (5, 8, 3, 2), (40, 1, 3, 16)])
def test_against_plain_k_means(spark, n, k, rounds, block):
    rows = some(n, 5, n)
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>").repartition(3)
    found, centroids = clusters.clustered(df, "vec_id", "v", 5, k, rounds, block=block)
    want, final = brute(rows, 5, k, rounds)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert [tuple(c) for c in centroids.tolist()] == final


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1e6, -1e6]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [-inf, 0.0]), (6, [None, 1.0]), (7, None), (8, [1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (None, [0.5, -0.5]), (11, [-0.001, 0.001])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>").withColumns({"id": F.lit("x"), "x": F.lit(1), "cluster": F.lit(2), "odd.name": F.lit(3)})
    found, _ = clusters.clustered(df, "vec_id", "v", 2, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows, 2, 3, 3)[0], key=key)
    assert clusters.clustered(df.limit(0), "vec_id", "v", 2)[0].count() == 0 == clusters.digest(df, "vec_id", "v").count()  # none has 64
    with pytest.raises(Exception, match="supported"):
        clusters.clustered(spark.createDataFrame([(1, [1e300, 0.0])], "id bigint, v array<double>"), "id", "v", 2)


def test_only_expired_vectors_are_compared():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 3, (400, 8)) for m in (-40, 0, 40)]).astype(np.int8)
    rng.shuffle(x)
    centroids = x[:3].astype(np.int64)
    block, spent, compared = clusters.Block(x, np.full(len(x), -1, np.int32), np.zeros(len(x)), [[] for _ in range(3)]), np.zeros(3), []
    expired = np.arange(len(x))
    for _ in range(12):
        block.assigned(centroids, spent, expired)
        assert (block.own == clusters.distances(x.astype(np.int64), centroids).argmin(axis=1)).all()
        block = clusters.Block.of(block.x, *block.row())
        for heap in block.heaps:
            assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
        after = np.array([x[block.own == c].astype(np.int64).sum(axis=0) // max(1, (block.own == c).sum()) for c in range(3)])
        drift = np.sqrt(((after - centroids) ** 2).sum(axis=1))
        spent = spent + drift + [np.delete(drift, c).max() for c in range(3)]
        centroids = after
        expired = block.expired(spent)
        compared.append(len(expired))
    assert compared[-1] == 0 and sum(compared) < 4 * len(x)


def test_distances_beyond_exact_floating_point():
    x = np.array([[clusters.LARGEST, -clusters.LARGEST, 3]], np.int64)
    assert clusters.distances(x, -x)[0, 0] == 2 * (2 * clusters.LARGEST) ** 2 + 36


def test_digest(spark):
    rows = [(i, (v * 13)[:64]) for i, v in some(60, 5, 9)]
    got = {r.vec_id: r for r in clusters.digest(spark.createDataFrame(rows, "vec_id bigint, e array<float>"), "vec_id", "e").collect()}
    want, centroids = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 64, 16, 3)
    assert len(got) == 60
    for i, c, d in want:
        r = got[i]
        assert (r.cluster, r.distance) == (c, d) and r.inertia == sum(x[2] for x in want) and r.cluster_inertia == sum(x[2] for x in want if x[1] == c)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
