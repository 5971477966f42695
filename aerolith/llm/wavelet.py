"""Token ids on disk as wavelet matrices.

Documents are encoded in ascending order of their id, each followed by an end id, and cut
into shards of about ``SHARD_IDS`` ids.  A shard is one row of a Parquet table: a wavelet
matrix of its ids (one bit plane per bit of an id, each with a rank directory) and the
documents it holds.  A token at a position, the number of times an id occurs before a
position, and the position of its k-th occurrence are answered from the planes; the
sequence itself is stored nowhere else.  Spark writes the table, so that a lost executor
leaves no half-written shard, and any file system Spark knows will do.

Null text counts as empty: its document is the end id alone.  Documents with a null id
come first, and equal ids are ordered by a hash of the text; exact copies are
interchangeable.  An empty table gives an empty one.  A shard ends after the document that
fills it, so a long document makes a longer shard and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType
from tokenizers import Tokenizer

from aerolith.llm.common import fields, shuffle_parts
from aerolith.llm.registry import query
from aerolith.llm.unit_groups import GroupEncoder
from aerolith.session import scratch_dir
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARD_IDS = 1 << 18
#: Bits a rank directory counts at a time.
BLOCK = 512


class WaveletMatrix:
    """A sequence of ids as bit planes.

    Plane 0 holds the highest bit of every id.  Each next plane holds the next bit, of the
    ids in the order that puts those with a 0 in the plane before first, else unchanged.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(plane, np.uint8) for plane in planes]
        self.ranks = [np.frombuffer(rank, "<u4") for rank in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for shift in range(bits - 1, -1, -1):
            ones = (ids & (1 << shift)) != 0
            packed = np.packbits(ones, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            counts = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype="<u4")
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            low = ids.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
        return cls(len(ids), zeros, planes, ranks)

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones in a plane before each of the given positions."""
        at = np.asarray(at, np.int64)
        if not self.n:
            return np.zeros_like(at)
        block = at // BLOCK
        found = self.ranks[level][block].astype(np.int64)
        words = self.planes[level].view("<u8")
        first = block * (BLOCK // 64)
        inside = at - block * BLOCK
        for word in range(BLOCK // 64):
            bits = np.clip(inside - 64 * word, 0, 64)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
            found += np.bitwise_count(words[np.minimum(first + word, len(words) - 1)] & mask)
        return found

    def access(self, at) -> np.ndarray:
        """The ids at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones_before(level, at)
            bit = self.planes[level][at >> 3] >> (at & 7) & 1
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before ``end`` lie below the last plane."""
        span = np.array([0, end], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones_before(level, span)
            span = zeros + ones if token >> (len(self.zeros) - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before position ``end``."""
        first, last = self._range(token, end)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of an id, from 0; -1 if there are fewer."""
        first, last = self._range(token, self.n)
        if not 0 <= k < last - first:
            return -1
        at = first + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def _select(self, level: int, k: int, one: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        if not one:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        part = self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8]
        places = np.flatnonzero(np.unpackbits(part, bitorder="little") == one)
        return block * BLOCK + int(places[k - ranks[block]])

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes are undone from the last to the first."""
        kind = np.dtype("<u2") if len(self.zeros) <= 16 else np.dtype("<u4")
        ids = np.zeros(self.n, kind)
        for shift, level in enumerate(range(len(self.zeros) - 1, -1, -1)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            ids[self.zeros[level]:] |= kind.type(1 << shift)
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[:self.zeros[level]]
            above[np.flatnonzero(ones)] = ids[self.zeros[level]:]
            ids = above
        return ids.astype("<u4")


SHARD = fields(
    part=IntegerType(), seq=IntegerType(), n_ids=LongType(), doc_ids=ArrayType(LongType()), lengths=ArrayType(LongType()),
    zeros=ArrayType(LongType()), planes=ArrayType(BinaryType()), ranks=ArrayType(BinaryType()),
)


@lru_cache(2)
def encoder(path: str) -> GroupEncoder:
    return GroupEncoder(Tokenizer.from_file(path), public_tokenizers.PATTERN)


def _shards(path: str, end_id: int, bits: int, shard_ids: int):
    kind = np.dtype("<u2") if bits <= 16 else np.dtype("<u4")

    def shard(part: int, seq: int, doc_ids: list, docs: list[np.ndarray]) -> pd.DataFrame:
        lengths = np.array([len(doc) for doc in docs])
        ids = np.insert(np.concatenate(docs).astype(kind), np.cumsum(lengths), end_id)
        matrix = WaveletMatrix.build(ids, bits)
        return pd.DataFrame([{
            "part": part, "seq": seq, "n_ids": matrix.n, "doc_ids": doc_ids, "lengths": lengths + 1,
            "zeros": matrix.zeros, "planes": [plane.tobytes() for plane in matrix.planes],
            "ranks": [rank.tobytes() for rank in matrix.ranks],
        }])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, n, doc_ids, docs = 0, 0, 0, [], []
        for batch in batches:
            for part, doc_id, ids in zip(batch["part"], batch["doc_id"], encoder(path).encode(batch["text"])):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                docs.append(ids)
                n += len(ids) + 1
                if n >= shard_ids:
                    yield shard(part, seq, doc_ids, docs)
                    seq, n, doc_ids, docs = seq + 1, 0, [], []
        if docs:
            yield shard(part, seq, doc_ids, docs)

    return write


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                 end_id: int = 0, bits: int = 16, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents to ``folder``, a new one.

    ``bits`` is the length of an id: 16 for a vocabulary of up to 65,536.
    One shuffle brings the documents into order; ranges are cut by id and text hash.
    """
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_parts(docs), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    (
        ordered.mapInPandas(_shards(tokenizer, end_id, bits, shard_ids), SHARD).write
        .option("compression", "zstd")
        # Rows are large: measure them one by one, and keep row groups small.
        .options(**{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1,
                    "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1})
        .parquet(folder)
    )


def _documents(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        for shard in batch.itertuples(index=False):
            ids = WaveletMatrix(shard.n_ids, list(shard.zeros), list(shard.planes), list(shard.ranks)).decode()
            ends = np.cumsum(shard.lengths)
            yield pd.DataFrame({
                "part": shard.part, "seq": shard.seq, "doc_id": pd.array(
                    [None if pd.isna(doc_id) else int(doc_id) for doc_id in shard.doc_ids], "Int64"),
                "offset": ends - shard.lengths, "n_tokens": shard.lengths,
                "ids": [ids[end - length:end].tobytes() for end, length in zip(ends, shard.lengths)],
            })


READ = fields(part=IntegerType(), seq=IntegerType(), doc_id=LongType(), offset=LongType(), n_tokens=LongType(), ids=BinaryType())


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents back from the planes: ``doc_id``, shard, ``offset`` in it, ``n_tokens`` and packed ``ids``."""
    return spark.read.parquet(folder).mapInPandas(_documents, READ)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The number of ids before each shard.

    Sizes are summed inside each part and then over the parts, of which there are as many
    as the write had tasks.
    """
    shards = spark.read.parquet(folder).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within"))
    return shards.join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("start"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """How often each shard holds an id, and where it stands first; only planes are read, nothing is decoded."""

    def look(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for shard in batch.itertuples(index=False):
                matrix = WaveletMatrix(shard.n_ids, list(shard.zeros), list(shard.planes), list(shard.ranks))
                yield pd.DataFrame([{"part": shard.part, "seq": shard.seq, "n": matrix.count(token), "first": matrix.select(token, 0)}])

    kind = fields(part=IntegerType(), seq=IntegerType(), n=LongType(), first=LongType())
    return spark.read.parquet(folder).select("part", "seq", "n_ids", "zeros", "planes", "ranks").mapInPandas(look, kind)


@query("op5_wavelet_ids")
def op5_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark, 'wavelet')}/ids"
    write_shards(table(spark, sf_dir, "documents"), folder)
    docs = read_documents(spark, folder).withColumn("ids_crc32", F.crc32("ids"))
    starts = settle(shard_starts(spark, folder), "wavelet-starts")
    return docs.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
