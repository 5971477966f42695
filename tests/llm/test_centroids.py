import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import centroids as c


def nearest_by_hand(vectors, centers):
    distances = ((vectors[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    return distances.argmin(axis=1), distances.min(axis=1)  # argmin takes the first of equals


@pytest.mark.parametrize("seed", range(5))
def test_threshold_walk_equals_all_distances(seed):
    pick = np.random.default_rng(seed)
    k, dims = int(pick.integers(1, 30)), int(pick.integers(1, 12))
    centers = pick.integers(-4, 5, (k, dims))  # many ties
    vectors = pick.integers(-6, 7, (200, dims))
    vectors[:k] = centers
    label, best = c.CentroidLists(centers.astype(np.int64)).nearest(vectors.astype(np.int64))
    want, distance = nearest_by_hand(vectors, centers)
    assert label.tolist() == want.tolist() and best.tolist() == distance.tolist()


def test_the_walk_stops_before_it_has_met_all():
    centers = np.arange(0, 5000, 100, dtype=np.int64)[:, None] * np.ones(3, np.int64)
    lists = c.CentroidLists(centers)
    measured = []
    plain = lists._measure
    lists._measure = lambda walking, seen, *rest: (measured.append(seen.size), plain(walking, seen, *rest))
    label, best = lists.nearest(np.array([[2010, 1990, 2000]], np.int64))
    assert (label.tolist(), best.tolist()) == ([20], [200])
    assert sum(measured) <= 9  # three lists, and few steps of each


def by_hand(rows, k, dims, rounds, scale, salt):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda row: (row[0] is None, hashlib.sha256(f"{salt}{row[0]}".encode()).hexdigest(), row[1].tolist()))
    centers = np.array([v for _, v in order[:k]])
    data = np.array([v for _, v in kept])
    for _ in range(rounds):
        label, _ = nearest_by_hand(data, centers)
        for n in range(len(centers)):
            if (label == n).any():
                centers[n] = [int(s) // int((label == n).sum()) for s in data[label == n].sum(axis=0)]
    label, distance = nearest_by_hand(data, centers)
    return sorted(((-1 if i is None else i), int(n), int(d)) for (i, _), n, d in zip(kept, label, distance)), centers


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, cluster string, id string").repartition(3)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_plain_rounds(spark, seed):
    pick = np.random.default_rng(seed)
    rows = [(n, pick.normal(size=4).astype(np.float32).tolist()) for n in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.5, 0.5, 0.5, 0.5]), (100, None), (101, [1.0] * 3), (102, [1.0, None, 1.0, 1.0]),
             (103, [float("nan")] * 4), (104, [float("inf")] * 4), (105, [])]
    found, centers = c.cluster(frame(spark, rows), k=6, dimensions=4, rounds=3)
    want, wanted_centers = by_hand(rows, 6, 4, 3, c.SCALE, c.SALT)
    assert centers.tolist() == wanted_centers.tolist()
    assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in found.collect()) == want


def test_few_equal_and_huge_vectors(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [3e38, -3e38])]
    found, centers = c.cluster(frame(spark, rows), k=5, dimensions=2, rounds=2)
    got = {r.id: (r.cluster, r.distance) for r in found.collect()}
    assert got[1] == got[2] and got[3][1] == 0 and len(centers) == 3
    assert [c.BOUND, -c.BOUND] in centers.tolist()
    found, centers = c.cluster(frame(spark, rows[:0]), k=5, dimensions=2)
    assert found.collect() == [] and centers.shape == (0, 2)


def test_query_digests(spark, folder):
    pick = np.random.default_rng(4)
    rows = [(n, pick.normal(size=64).astype(np.float32).tolist()) for n in range(90)] + [(500, None), (501, [1.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    found = c.op13_centroid_clusters(spark, folder).collect()
    want, centers = by_hand(rows, c.K, 64, c.ROUNDS, c.SCALE, c.SALT)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == want
    for r in found:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster].tolist())).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)


def test_query_on_an_empty_table(spark, folder):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    assert c.op13_centroid_clusters(spark, folder).filter(F.lit(True)).collect() == []
