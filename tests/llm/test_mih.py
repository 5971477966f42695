import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import mih


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(rows, query, k=10):
    own, vector = query
    apart = [(float(np.sqrt(((np.array(v, np.float64) - np.array(vector, np.float64)) ** 2).sum())), n) for n, v in rows if n != own]
    return sorted(apart)[:k]


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    return [(k, (centres[k % 20] + 0.3 * rng.standard_normal(d)).astype("f4").tolist()) for k in range(n)]


def test_probing_finds_every_code_within_the_radius():
    words = np.random.default_rng(1).integers(0, 1 << 16, (500, 3)).astype("<u2")
    words[100:200] = words[0] ^ (1 << np.random.default_rng(2).integers(0, 16, (100, 3))).astype("<u2")
    tables = mih.Tables(words)
    for radius in (0, 1, 3, 5, 14, 20, 24, 60):
        want = np.flatnonzero(np.bitwise_count(words ^ words[0]).sum(axis=1) <= radius)
        assert tables.within(words[0], radius).tolist() == want.tolist()


def test_rotations_stay_rotations():
    x = np.random.default_rng(3).standard_normal((300, 16))
    r = mih.learn_rotation(x - x.mean(0), np.random.default_rng(4))
    assert np.allclose(r @ r.T, np.eye(16))


def test_recall_and_scores(spark):
    rows = clustered(3000, 24, 5)
    found = {}
    for row in mih.nearest(vectors(spark, rows), F.col("id") % 100 == 0).collect():
        found.setdefault(row.query_id, {})[row.rank] = (row.score, row.vec_id)
    hits = 0
    for query in rows[::100]:
        want, got = exact(rows, query), found[query[0]]
        assert sorted(got) == list(range(1, 11)) and [got[r] for r in sorted(got)] == sorted(got.values())
        hits += len({n for _, n in want} & {n for _, n in got.values()})
        true = dict((n, s) for s, n in exact(rows, query, 3000))
        assert all(abs(true[n] - s) < 1e-12 for s, n in got.values())
    assert hits / (10 * len(rows[::100])) >= 0.9


@pytest.mark.parametrize("blocks", [7, 4096])
def test_odd_vectors_ties_and_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(mih, "BLOCK", blocks)
    same = [1.0, 2.0, 3.0]
    rows = [(n, same) for n in range(30)] + [(100, [1.0, 2.0, 4.0]), (200, None), (300, []), (400, [0.0, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0]),
                                             (600, [1.0, None, 0.0]), (700, [1.0, 2.0]), (800, [float("inf"), 1.0, 1.0]), (None, same), (0, same)]
    found = mih.nearest(vectors(spark, rows), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {row.query_id for row in found} == {0, 100}
    assert [(row.vec_id, row.score) for row in found if row.query_id == 0] == [(n, 0.0) for n in range(1, 11)]
    assert [row.vec_id for row in found if row.query_id == 100] == [0, 0, *range(1, 9)]


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [-5.0, 0.1]), (2, [0.0, 9.0])]
    found = mih.nearest(vectors(spark, rows), F.col("id") == 0).orderBy("rank").collect()
    assert [(row.rank, row.vec_id) for row in found] == [(1, 1), (2, 2)]
    none = mih.nearest(vectors(spark, rows).filter("false"), F.col("id") == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("blocks", [7, 4096])
def test_different_vectors_of_one_query_id_are_merged(spark, monkeypatch, blocks):
    monkeypatch.setattr(mih, "BLOCK", blocks)
    near = [(n, [1.0 + n / 64, 0.0, 0.0]) for n in range(1, 8)] + [(n, [0.0, 1.0 + n / 64, 0.0]) for n in range(8, 15)]
    rows = near + [(100, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.1])]
    own = [np.array(v) for n, v in rows if n == 100]
    want = sorted((min(float(np.sqrt(((np.array(v, np.float32) - np.array(o, np.float32)).astype(float) ** 2).sum())) for o in own), n) for n, v in near)[:10]
    found = mih.nearest(vectors(spark, rows), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [row.rank for row in found] == list(range(1, 11))
    assert [row.vec_id for row in found] == [n for _, n in want]
    assert all(abs(row.score - score) < 1e-6 for row, (score, _) in zip(found, want))
