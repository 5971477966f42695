"""Centroid clustering in whole numbers, nearest centroids by the threshold algorithm.

For every dimension the centroids are listed by their component.  A vector looks up its own
component in each list and walks outward from there: each step takes, in every dimension, the
next nearest centroid of that list, and measures those it has not met before exactly.  The
squared distances at the lists' frontiers add up to a lower bound for every centroid not met
yet; the walk stops when that sum strictly exceeds the best exact distance, so that ties are
still met and go to the smaller number.  Many vectors walk at once, as arrays.

Components become integers ``floor(scale * x)``, so distances, sums and centroids are exact and
do not depend on the order of rows.  A round reads the stored vectors once and sends one row of
sums per task and cluster; only the centroids, of fixed size, come to the driver.

Vectors of another length, or with null or non-finite components, take no part, nor do null
vectors.  Integers beyond 2^27 either way count as that bound, which keeps distances within 64
bits.  Rows without id come last among the first centroids and are clustered like others;
repeated rows count as often as they occur.  With fewer vectors than ``k`` each of them starts
a centroid; an empty table gives an empty result.  A centroid that attracts no vector stays.
Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from aerolith.llm.common import fields
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

#: Fixed by the contract: centroids, components, rounds, factor, and the prefix of the hashed id.
K, DIMENSIONS, ROUNDS, SCALE, SALT = 40, 64, 5, 256, "2:"
BOUND = 1 << 27
#: Vectors that walk at once; their state is ``AT_ONCE * dimensions`` and ``AT_ONCE * k`` numbers.
AT_ONCE = 2048


class CentroidLists:
    """Per dimension the centroids in order of their component."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dims = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension, place
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller number of equals, and the squared distance."""
        n = len(vectors)
        best, label = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        met = np.zeros((n, self.k), bool)
        right = np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in range(self.dims)], axis=1)
        left = right - 1
        walking, dims = np.arange(n), np.arange(self.dims)
        while len(walking):
            own = vectors[walking]
            low, high = left[walking], right[walking]
            below = np.where(low >= 0, own - self.values[dims, np.maximum(low, 0)], np.iinfo(np.int64).max)
            above = np.where(high < self.k, self.values[dims, np.minimum(high, self.k - 1)] - own, np.iinfo(np.int64).max)
            down = below <= above
            frontier = np.where(down, below, above)  # all lists have k entries, so none ends before all are met
            self._measure(walking, self.order[dims, np.where(down, low, high)], vectors, met, best, label)
            left[walking], right[walking] = low - down, high + ~down
            going = ((frontier * frontier).sum(axis=1) <= best[walking]) & ~met[walking].all(axis=1)
            walking = walking[going]
        return label, best

    def _measure(self, walking: np.ndarray, seen: np.ndarray, vectors: np.ndarray, met: np.ndarray, best: np.ndarray, label: np.ndarray) -> None:
        """Exact distances of the centroids that the walking vectors meet for the first time."""
        new = np.zeros((len(walking), self.k), bool)
        new[np.arange(len(walking))[:, None], seen] = True
        new &= ~met[walking]
        met[walking] |= new
        for centroid in range(self.k):  # in order, so that an equal distance keeps the smaller number
            rows = walking[new[:, centroid]]
            if not len(rows):
                continue
            apart = vectors[rows] - self.centroids[centroid]
            distance = (apart * apart).sum(axis=1)
            better = (distance < best[rows]) | (distance == best[rows]) & (centroid < label[rows])
            best[rows[better]], label[rows[better]] = distance[better], centroid


def _walked(batches: Iterator[pa.RecordBatch], lists) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches with their vectors, labels and distances."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            vectors = part.column("vector").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
            yield part, vectors, *lists.value.nearest(vectors)


_SUMS = fields(cluster=IntegerType(), count=LongType(), sums=ArrayType(LongType()))


def _summer(lists):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lists.value.centroids.shape, np.int64)
        count = np.zeros(len(total), np.int64)
        for _, vectors, label, _ in _walked(batches, lists):
            np.add.at(total, label, vectors)
            count += np.bincount(label, minlength=len(count))
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(held, pa.int32()), "count": pa.array(count[held]), "sums": pa.array(total[held].tolist(), pa.list_(pa.int64()))})

    return sums


_ASSIGNED = fields(id=LongType(), cluster=IntegerType(), distance=LongType())


def _assigner(lists):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, label, distance in _walked(batches, lists):
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "cluster": pa.array(label, pa.int32()), "distance": pa.array(distance)})

    return assign


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part, components as integers."""
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(ArrayType(DoubleType())).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(scale * x, F.lit(1e15)), F.lit(-1e15))), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    return given.filter(F.col("x").isNotNull() & (F.size("x") == dimensions) & finite).select("id", whole.alias("vector"))


def next_centroids(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid; a centroid without any stays."""
    lists = stored.sparkSession.sparkContext.broadcast(CentroidLists(centroids))
    parts = stored.mapInArrow(_summer(lists), _SUMS)
    # Summed by place: one short row per cluster and dimension, combined before the shuffle.
    placed = parts.select("cluster", "count", F.posexplode("sums").alias("place", "part"))
    found = placed.groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("count").alias("count"))
    out = centroids.copy()
    for row in found.collect():  # k * dimensions rows
        out[row.cluster, row.place] = row.total // row["count"]
    lists.unpersist()
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS,
            rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """Rows ``id``, ``cluster``, ``distance`` (written), and the final centroids.

    The first centroids are the vectors with the least hashes of their id, in that order.
    """
    stored = settle(whole_vectors(vectors, vec_id, vector, dimensions, scale), "whole-vectors")
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    first = stored.orderBy(hashed.asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.array([row.vector for row in first], np.int64).reshape(len(first), dimensions)
    if not len(first):
        return stored.sparkSession.createDataFrame([], _ASSIGNED), centroids
    for _ in range(rounds):
        centroids = next_centroids(stored, centroids)
    lists = stored.sparkSession.sparkContext.broadcast(CentroidLists(centroids))
    return settle(stored.mapInArrow(_assigner(lists), _ASSIGNED), "assigned"), centroids


def _sql() -> str:
    """The same in SQL: every vector against every centroid, round after round."""
    distance = "list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, x, (min(d * 64 + c) % 64)::INT AS c, (min(d * 64 + c) // 64)::BIGINT AS d
  FROM (SELECT v.vec_id, v.x, m.c, {distance}::HUGEINT AS d FROM kept v, c{n} m) GROUP BY vec_id, x)""")
        if n < ROUNDS:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT c, list(q ORDER BY i) AS x FROM (
    SELECT c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS q FROM a{n}, range(1, {DIMENSIONS + 1}) AS r(i) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1)::INT AS c, x FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) <= {K}
), {", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} m ON m.c = a.c
"""


@query("op13_centroid_clusters", _sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [(n, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for n, row in enumerate(centroids)]
    digest = spark.createDataFrame(digests, fields(cluster=IntegerType(), centroid_sha256=StringType()))
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    of_cluster = own.join(digest, "cluster").join(F.broadcast(total))  # one row of totals beside one row a cluster
    return found.join(F.broadcast(of_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
