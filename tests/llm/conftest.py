import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns beyond the table's own whose names operators use themselves.
DOCS = StructType([StructField("doc_id", LongType()), *[
    StructField(name, StringType()) for name in ("text", "lang", "source", "row", "size", "fp", "n_words", "ids", "key", "host", "m", "e", "id")]])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text, source), with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, *["x"] * 10) for d, t, s in rows], DOCS)

    return make


PROSE = ("the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak near that quiet river bank "
         "and several children count their bright marbles under warm evening light before supper calls them home again "
         "with songs about distant mountains where silver trains carry letters between sleepy towns every single morning")


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{n % 977}x{n % 89}" for n in range(60_000))
    return make_docs([
        (1, PROSE, "a"), (1, PROSE, "a"), (2, PROSE + " indeed", None), (3, None, "a"), (4, "", "b"), (5, " \n\t", "b"),
        (None, PROSE.upper(), "b"), (None, None, None), (6, long_text, "c"), (7, "é" * 30_000, "c"), (8, "one two", "c"),
    ])
