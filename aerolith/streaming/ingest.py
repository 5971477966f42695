"""Each new file in a folder is loaded once, as it lands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerolith.session import is_directory


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                max_file_age: str = "36500d") -> DataFrame:
    """Stream of Parquet files under ``path``, files already there included.

    ``path`` may also be a single file.  ``files_per_batch`` bounds a micro-batch,
    so a backlog of any size is worked off in pieces.  Files stamped more than
    ``max_file_age`` before the newest one are left out, so the default leaves out none;
    the source's list of files it has seen then grows with the folder.
    """
    reader = spark.readStream.schema(schema).option("maxFileAge", max_file_age)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not is_directory(spark, path):
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def delivered_once(stream: DataFrame, keys: list[str], within: str = "7 days") -> DataFrame:
    """A file stream without rows whose keys have come before, in whatever file.

    ``within`` says how long after a row a repeat of it may come.  It is measured on the time
    stamps of the files and not on those of the rows, so late rows are not lost; keys older than
    that leave the state, which bounds it.
    """
    arrived = "_arrived"
    stamped = stream.select("*", F.col("_metadata.file_modification_time").alias(arrived))
    return stamped.withWatermark(arrived, within).dropDuplicatesWithinWatermark(keys).drop(arrived)


def start_ingest(stream: DataFrame, target: str, checkpoint: str,
                 transform: Callable[[DataFrame], DataFrame] | None = None,
                 every: str | None = None) -> StreamingQuery:
    """Appends the stream to a Parquet folder, each file once.

    ``every`` ("1 minute") keeps it running; without it all waiting files are loaded
    and the query ends.  The checkpoint remembers what was loaded.
    """
    if transform:
        stream = transform(stream)
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_available(stream: DataFrame, target: str, checkpoint: str,
                     transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Loads what is waiting and returns the target table.

    The table has the columns of this load; in files of earlier loads without one of
    them it is null.
    """
    loaded = transform(stream) if transform else stream
    start_ingest(loaded, target, checkpoint).awaitTermination()
    schema = T.StructType([T.StructField(field.name, field.dataType) for field in loaded.schema])
    return stream.sparkSession.read.schema(schema).parquet(target)
