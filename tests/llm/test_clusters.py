"""Dimension-sharded Lloyd rounds against a plain loop over vectors."""

import hashlib
import math

import pytest

from numberboard.llm.clusters import Lloyd, cluster, cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, chunk long, distance string, ids string"


def rows(n, seed=3, size=6):
    out, x = [], seed
    for i in range(n):
        v = []
        for _ in range(size):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            v.append(((x >> 33) % 2001 - 1000) / 500)
        out.append((i, v))
    return out


def table(spark, found):
    return spark.createDataFrame([(i, v, 1, 2, 3, "d", "i") for i, v in found], SCHEMA).repartition(3)


def plain(found, p):
    """(vec_id, cluster, distance) and centroids, one vector at a time."""
    kept = [(i, [math.floor(p.scale * x) for x in v], v) for i, v in found if v is not None and len(v) == p.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = [(i is None, hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, _, v in kept]
    cent = [kept[k][1] for k in sorted(range(len(kept)), key=name.__getitem__)[: p.centroids]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cent))

    for _ in range(p.rounds):
        at = [near(v)[1] for _, v, _ in kept]
        for k in range(len(cent)):
            own = [v for (_, v, _), c in zip(kept, at) if c == k]
            if own:
                cent[k] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, near(v)[1], near(v)[0]) for i, v, _ in kept], cent


@pytest.mark.parametrize("width,chunk", [(6, 7), (4, 3), (1, 1000)])
def test_equals_a_plain_loop(spark, width, chunk):
    p = Lloyd(dimensions=6, scale=8, centroids=5, shard_width=width, chunk_rows=chunk)
    same = [(i % 50, v) for i, v in rows(40)] + [(500 + k, rows(1)[0][1]) for k in range(60)]  # a third and more alike
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [math.nan] * 6), (905, [math.inf] + [0.0] * 5)]
    odd += [(None, [0.5] * 6), (None, [-0.5] * 6), (7, [0.01, -0.01, -0.0, 3.0, -3.0, 0.0]), (7, [0.01, -0.01, -0.0, 3.0, -3.0, 0.0])]
    expected, cent = plain(same + odd, p)
    found, centroids = cluster(table(spark, same + odd), p)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert centroids.tolist() == cent
    whole = cluster_vectors(table(spark, same + odd), p).collect()
    assert {r["inertia"] for r in whole} == {sum(d for _, _, d in expected)}
    for r in whole:
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cent[r["cluster"]])).encode()).hexdigest()


def test_ties_few_and_no_vectors(spark):
    p = Lloyd(dimensions=2, scale=1, centroids=16, shard_width=1)
    two = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]
    expected, _ = plain(two, p)
    assert sorted(map(tuple, cluster(table(spark, two), p)[0].collect())) == sorted(expected)
    empty = cluster_vectors(table(spark, two).where("vec_id < 0"), p)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(table(spark, [(1, [1e300] * 64)])).count()
