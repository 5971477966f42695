"""Unique tests of batches against all that was loaded before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from aerolith.sources.versioned import KIND, PART, Folder, VersionedFolder, bucket
from aerolith.sources.writers import settle

KEYS, BITS = "keys", "bits"
_CELL_BITS = 1 << 15  # bits in one value of Spark's bitmap functions
_BITS = StructType([StructField("cell", LongType()), StructField("bitmap", BinaryType())])


class KeyIndex:
    """The keys of a table in buckets, and a Bloom filter of them.

    A key sets two bits of ``1 << size``.  A batch looks its different keys up in the filter; only
    those whose bits are both set can be known, and only the buckets of these are read to
    find out.  So a batch of new keys reads the filter and none of the keys.  The filter's cells
    are joined by number like any table, and grow with nothing but ``size``.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str], buckets: int = 64, size: int = 27):
        self.files, self.columns, self.buckets, self.size = VersionedFolder(spark, root), columns, buckets, size

    def _bits(self) -> Column:
        hashed = F.xxhash64(*self.columns)
        return F.array(F.shiftrightunsigned(hashed, 64 - self.size), hashed.bitwiseAND(F.lit((1 << self.size) - 1)))

    def _counted(self, rows: DataFrame) -> DataFrame:
        """Whole keys and how often they occur, combined before the shuffle."""
        return rows.select(*self.columns).na.drop(how="any").groupBy(*self.columns).agg(F.count(F.lit(1)).alias("occurrences"))

    def likely(self, keys: DataFrame) -> DataFrame:
        """Keys whose bits are all set."""
        base = self.files.latest()
        if BITS not in base.schemas:
            return keys.limit(0)
        bit = F.col("bit")
        asked = keys.withColumn("bit", F.explode(self._bits())).withColumn("cell", bit.bitwiseAND(F.lit(-_CELL_BITS)) / _CELL_BITS)
        asked = asked.withColumn("cell", F.col("cell").cast("long"))
        place = F.col("bit") % _CELL_BITS
        byte = F.conv(F.hex(F.substr(F.col("bitmap"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << n)) for n in range(8)]), (place % 8).cast("int")) != 0
        cells = self.files.read(base, BITS)
        return asked.join(cells, "cell").filter(is_set).groupBy(*self.columns).agg(
            F.first("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("_set")).filter("_set = 2").drop("_set")

    def check(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch that occur more than once in it and all before, with their number."""
        keys = settle(self._counted(batch), "batch-keys")
        hits = settle(self.likely(keys).withColumn(PART, bucket(self.columns, self.buckets).cast("string")), "likely-keys")
        base = self.files.latest()
        parts = [row[0] for row in hits.select(PART).distinct().collect()]  # at most as many as there are buckets
        known = self.files.read(base, KEYS, parts, keys.schema).join(hits.select(*self.columns), self.columns, "left_semi")
        both = keys.unionByName(known).groupBy(*self.columns).agg(F.sum("occurrences").alias("occurrences"))
        return both.filter("occurrences > 1")

    def add(self, batch: DataFrame) -> int:
        """Takes the batch's keys in; cells of the filter are or-ed and rewritten."""
        base = self.files.latest()
        keys = settle(self._counted(batch), "batch-keys")
        place = F.explode(self._bits()).alias("bit")
        # The bitmap functions count from 1.
        found = keys.select(place).groupBy((F.bitmap_bucket_number(F.col("bit") + 1) - 1).alias("cell")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))
        merged = self.files.read(base, BITS, schema=_BITS).unionByName(found).groupBy("cell").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        part = bucket(self.columns, self.buckets).cast("string")
        written = self.files.write(
            keys.withColumns({KIND: F.lit(KEYS), PART: part})
            .unionByName(merged.withColumns({KIND: F.lit(BITS), PART: F.lit("all")}), allowMissingColumns=True))
        folders = {
            name: [*(base.folders.get(name, []) if name.startswith(f"{KEYS}/") else []), Folder(path)] for name, path in written.items()
        }
        return self.files.commit(base, folders, {KEYS: keys.schema, BITS: _BITS}).number
