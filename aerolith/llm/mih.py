"""Nearest neighbours by multi-index hashing over learned binary codes.

A code is the signs of a vector under several rotations, each learned by iterative
quantisation (alternately take signs, and turn the rotation towards them).  A vector has
``ROTATIONS`` bits per dimension.  Codes are cut into substrings of 16 bits, and a block of
the index has a table of each substring: its values, and the vectors behind each.
If two codes differ in at most r bits, then among m substrings one differs in at most
r // m (one less for those beyond the remainder).  A query probes each table within that many bits, which
retrieves every code within r; those are kept by their whole distance and reranked by
the Euclidean distance of the original vectors in double precision.

The rotations, and r, are learned from at most ``SAMPLE`` vectors, those of the least hash
of id and vector, copies counted once.  r is the quantile ``REACH`` of the code distances between ``SAMPLE_QUERIES`` of them
and their k nearest in the sample, whose neighbours are farther off than those in all data.
Every row is indexed.  A query that finds fewer than k goes through all of the index again,
with r the length of a code.

Rows and queries are dealt into blocks of a bounded size and every block of queries meets
every block of rows in a task of its own; of each pair of blocks only the k nearest per
query are passed on, however many vectors are equal.

Vectors take no part that are null, empty, zero, hold a null or a non-finite component, or
have another dimension than most of the sample.  A query's own row is any row with its
id.  Rows without an id are candidates with a null id, after others of equal distance.
Repeated rows are repeated candidates.  Without valid vectors the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType

from aerolith.llm.common import fields
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

ROTATIONS = 4
SUBSTRING = 16
SAMPLE, SAMPLE_QUERIES = 20_000, 400
REACH = 0.98
#: Rows, and queries, of a block.
BLOCK = 4096
K = 10


@dataclass(frozen=True)
class Codes:
    """What is learned: the centre, the rotations side by side, and the radius."""

    centre: np.ndarray
    rotations: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One row of 16-bit substrings per vector; the last is filled up with zeros."""
        signs = (vectors - self.centre) @ self.rotations > 0
        signs = np.pad(signs, ((0, 0), (0, -self.bits % SUBSTRING)))
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")


def learn_rotation(centred: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    d = centred.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(rounds):
        signs = np.where(centred @ rotation > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(centred.T @ signs)
        rotation = u @ v
    return rotation


def distances(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    apart = vectors - one
    return np.sqrt((apart * apart).sum(axis=1))


def learn(sample: np.ndarray, k: int = K, reach: float = REACH, queries: int = SAMPLE_QUERIES, seed: int = 7) -> Codes:
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    rotations = np.hstack([learn_rotation(sample - centre, rng) for _ in range(ROTATIONS)])
    codes = Codes(centre, rotations, 0)
    words = codes.encode(sample)
    apart: list[np.ndarray] = []
    for n in range(min(queries, len(sample))):
        near = distances(sample, sample[n])
        near[n] = np.inf
        first = np.argsort(near, kind="stable")[:min(k, len(sample) - 1)]
        apart.append(np.bitwise_count(words[first] ^ words[n]).sum(axis=1, dtype=np.int64))
    radius = int(np.quantile(np.concatenate(apart), reach, method="higher")) if len(sample) > 1 else codes.bits
    return Codes(centre, rotations, radius)


class Tables:
    """The substring tables of a block of codes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.values, self.rows, self.starts = [], [], []
        for n in range(words.shape[1]):
            rows = np.argsort(words[:, n], kind="stable")
            values, starts = np.unique(words[rows, n], return_index=True)
            self.values.append(values)
            self.rows.append(rows)
            self.starts.append(np.append(starts, len(rows)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        parts = len(code)
        least, beyond = divmod(radius, parts)
        found = np.zeros(len(self.words), bool)
        for n in range(parts):
            flips = least if n <= beyond else least - 1
            if flips < 0:
                continue
            hit = np.flatnonzero(np.bitwise_count(self.values[n] ^ code[n]) <= flips)
            if len(hit) == len(self.values[n]):
                found[:] = True
                break
            starts, ends = self.starts[n][hit], self.starts[n][hit + 1]
            sizes = ends - starts
            found[self.rows[n][np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.words[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def valid(vector: Column, dimension: int | None = None) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    good = good if dimension is None else good & (F.size(vector) == dimension)
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def learn_codes(vectors: DataFrame, k: int = K) -> Codes | None:
    """From at most ``SAMPLE`` vectors ``id``, ``vector``, which come to the driver; None if there are none."""
    hashed = vectors.filter(valid(F.col("vector"))).select("vector", F.xxhash64("id", "vector").alias("h"))
    # The least of all would come to the driver from every partition: first those below a bound with about twice as many.
    different = hashed.agg(F.approx_count_distinct("h")).first()[0]
    least = hashed.filter(F.col("h") / 2.0**64 + 0.5 <= F.lit(2 * SAMPLE / max(different, 1)))
    sample = least.groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").limit(SAMPLE).select("vector").collect()
    if not sample:
        return None
    sizes = [len(row[0]) for row in sample]
    dimension = max(sorted(set(sizes)), key=sizes.count)
    return learn(np.array([row[0] for row in sample if len(row[0]) == dimension], np.float64), k)


def build_index(vectors: DataFrame, codes: Codes) -> DataFrame:
    """All valid vectors with their codes, as a stored table of ``id``, ``vector``, ``code`` and the row's own ``place``."""

    @F.pandas_udf(BinaryType())
    def encode(vectors: pd.Series) -> pd.Series:
        words = codes.encode(_matrix(vectors)) if len(vectors) else []
        return pd.Series([row.tobytes() for row in words], dtype=object)

    # Only rows that pass reach the code: the function is applied to a stored table.
    good = settle(vectors.filter(valid(F.col("vector"), len(codes.centre))), "vectors")
    return settle(good.select("id", "vector", encode("vector").alias("code"), F.monotonically_increasing_id().alias("place")), "vector-index")


_FOUND = fields(query_id=LongType(), id=LongType(), score=DoubleType(), place=LongType())


def _searcher(radius: int, k: int):
    def search(_, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "place": []}).astype({"query_id": "int64", "id": "Int64", "place": "int64"})
        tables = Tables(np.stack([np.frombuffer(code, "<u2") for code in block["code"]]))
        vectors, ids = _matrix(block["vector"]), block["id"].astype("Int64")
        missing = ids.isna().to_numpy()
        plain, places = ids.fillna(0).to_numpy(np.int64), block["place"].to_numpy(np.int64)
        out = []
        for own, vector, code in zip(asked["id"].astype("int64"), _matrix(asked["vector"]), asked["code"]):
            rows = tables.within(np.frombuffer(code, "<u2"), radius)
            rows = rows[missing[rows] | (plain[rows] != own)]
            score = distances(vectors[rows], vector)
            best = np.lexsort((plain[rows], missing[rows], score))[:k]
            out.append(pd.DataFrame({"query_id": own, "id": ids.iloc[rows[best]].to_numpy(), "score": score[best], "place": places[rows[best]]}))
        return pd.concat(out).astype({"query_id": "int64", "id": "Int64"})

    return search


def _search(index: DataFrame, queries: DataFrame, radius: int, k: int) -> DataFrame:
    """``queries`` against all of the index, block by block; both are stored tables."""
    row_blocks = max(1, ceil(index.count() / BLOCK))
    query_blocks = max(1, ceil(queries.count() / BLOCK))

    def dealt(df: DataFrame, blocks: int, own: str, others: int, other: str) -> DataFrame:
        # The place of a row in its stored file deals out repeated rows as well.
        place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    rows = dealt(index, row_blocks, "i", query_blocks, "q")
    asked = dealt(queries, query_blocks, "q", row_blocks, "i")
    found = asked.groupBy("i", "q").cogroup(rows.groupBy("i", "q")).applyInPandas(_searcher(radius, k), _FOUND)
    # A row that several vectors of one query id have found counts once, at its least distance.
    found = found.groupBy("query_id", "place").agg(F.first("id").alias("id"), F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` nearest found of each row that ``queries`` selects: ``query_id``, ``rank``, ``vec_id`` and ``score``.

    ``queries`` is a condition on ``id``.  Different vectors of the same id are all searched and their results merged.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(ArrayType(DoubleType())).alias("vector"))
    codes = learn_codes(rows, k)
    if codes is None:
        empty = fields(query_id=LongType(), id=LongType(), score=DoubleType())
        found = vectors.sparkSession.createDataFrame([], empty).withColumn("rank", F.lit(1))
    else:
        index = build_index(rows, codes)
        # Copies of a query's row are one query; other vectors of the same id are searched too.
        asked = settle(index.filter(queries & F.col("id").isNotNull()).dropDuplicates(["id", "vector"]), "vector-queries")
        found = settle(_search(index, asked, codes.radius, k), "vector-found")
        full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = settle(asked.join(full, "id", "left_anti"), "vector-short")
        if not short.isEmpty():
            again = _search(index, short, codes.bits + SUBSTRING, k)
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op10_nearest_vectors")
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
