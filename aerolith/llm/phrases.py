"""Collocations: phrases whose words occur together more often than their parts would by chance.

A phrase is a run of words inside a piece of text between separators; a candidate occurs at
least ``threshold`` times in its language.

* Counting candidates only: every task hashes the word runs it reads and sends one sorted
  summary (hashes, counts) per hash partition.  A hash partition merges its summaries in a
  Misra-Gries summary: counters beyond the capacity are evicted by subtracting the largest
  evicted count from all.  What is subtracted altogether is at most mass / (capacity + 1);
  the capacity is above ``slack * mass / threshold``, the mass being that of the hash partition,
  so every frequent run survives, and counter + subtracted < threshold proves a run rare.
* Single words and pairs go first.  A longer run is only looked at when all its pairs
  survived, since a phrase is never more frequent than its parts.
* The survivors' hashes set bits of a filter of fixed size.  The last pass over the texts
  counts every run that passes the filter by its words, again by hash partition, so counts are exact
  whatever the hashes and the filter let through; a full filter costs time, never a result.
* Inside a block of text a run is compared with the first one of equal hash word by word.

A candidate that lies inside a longer one of (nearly) the same frequency lies also inside one
that is a single word longer and at least as frequent, so only those are compared.

Null text counts as empty, a null language is ``und``.  Repeated rows count as often as they
occur.  A text of any length is read in blocks.  An empty table, or one without frequent
phrases, gives an empty result.  Equal scores are ordered by count, then by phrase.  Other columns
of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from aerolith.llm.common import fields, longs, shuffle_parts
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

#: Fixed by the contract: separators of pieces, words in a phrase, occurrences, rows a language.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
LONGEST, THRESHOLD, FIRST = 5, 100, 2000

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER + SEPARATORS, _UPPER.lower() + b"." * len(SEPARATORS))
#: Bytes of text made words at once, and runs that one summary holds.
BLOCK, CHUNK = 1 << 22, 1 << 22
#: Capacity of a summary over mass / threshold.
SLACK = 4
#: Text bytes per hash partition, and the least number of those.
PARTITION_BYTES, LEAST_PARTITIONS = 1 << 28, 256
#: The filter's size, 8 MB; broadcast, whatever the input's size.
FILTER_BITS = 26
_BITMAP = 1 << 15  # bits in one value of Spark's bitmap functions


def word_blocks(data: bytes, carry: int, block: int = BLOCK) -> Iterator[tuple[list[bytes], int]]:
    """Words of folded text, ``.`` between pieces, block by block.

    The first words of a block, as many as the number beside it says, repeat the last ones of
    the block before, so that a run across the edge is whole in one block.
    """
    at, tail = 0, []
    while at < len(data):
        end = at + block
        if end < len(data):
            cut = max(data.rfind(mark, at, end) for mark in (b".", b" ", b"\t"))
            if cut < 0:  # a word longer than a block
                cut = min((n for n in (data.find(mark, end) for mark in (b".", b" ", b"\t")) if n >= 0), default=len(data))
            end = cut + 1
        words = tail + data[at:end].replace(b".", b" . ").split()
        yield words, len(tail)
        tail, at = words[-carry:] if carry else [], end


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * np.uint64(0x9E3779B97F4A7C15) + right
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Runs:
    """The word runs of a block: where they start and what they hash to, by length."""

    def __init__(self, words: list[bytes], carried: int, seed: int):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy()
        hashes = np.fromiter((xxhash.xxh64_intdigest(word, seed) for word in known), np.uint64, len(known))
        stop = ids == (known.index(b".") if b"." in known else -1)
        inside = np.flatnonzero(~stop)
        self.known, self.ids, self.words = known, ids[inside], hashes[ids[inside]]
        self.piece, self.fresh = np.cumsum(stop)[inside], inside >= carried

    def starts(self, length: int) -> np.ndarray:
        """Starts of the runs that lie in one piece and end in this block's own words."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.piece[:n] == self.piece[length - 1:]) & self.fresh[length - 1:])

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = self.words[starts]
        for k in range(1, length):
            out = _mixed(out, self.words[starts + k])
        return out

    def of_frequent_pairs(self, pairs: "Filter", longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """Starts of runs of 3 words and more, all of whose pairs may be frequent, by length."""
        every = np.arange(max(len(self.ids) - 1, 0))
        frequent = pairs.may_hold(self.hashes(every, 2))
        good = frequent
        for length in range(3, longest + 1):
            good = good[:-1] & frequent[length - 2:]
            starts = self.starts(length)
            yield length, starts[good[starts]]

    def counted(self, starts: np.ndarray, length: int, hashes: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        """The different runs with their hash and how often they occur here, compared by their words."""
        if not len(starts):
            return
        keys, first, group, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        named = starts[first]
        other = np.zeros(len(starts), bool)
        for k in range(length):
            other |= self.ids[starts + k] != self.ids[named[group] + k]
        if other.any():  # another run of the same hash
            counts = counts - np.bincount(group[other], minlength=len(first))
            for key, at in zip(hashes[other].tolist(), starts[other].tolist()):
                yield key, self.text(at, length), 1
        for key, at, n in zip(keys.tolist(), named.tolist(), counts.tolist()):
            yield key, self.text(at, length), n

    def text(self, start: int, length: int) -> bytes:
        return b" ".join([self.known[n] for n in self.ids[start:start + length]])


def runs_of(batch: pd.DataFrame, longest: int, block: int = BLOCK) -> Iterator[tuple[str, Runs]]:
    """Runs of a batch with ``lang`` and ``text``, by language and block."""
    for lang, texts in batch.groupby("lang", sort=False)["text"]:
        seed = xxhash.xxh64_intdigest(lang.encode())
        held, size = [], 0
        for n, text in enumerate(texts, 1):
            held.append(text.encode())
            size += len(held[-1])
            if size >= block or n == len(texts):
                for words, carried in word_blocks(b".".join(held).translate(_FOLD), longest - 1, block):
                    yield lang, Runs(words, carried, seed)
                held, size = [], 0


# Summaries ---------------------------------------------------------------------------------


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and their counts."""
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(first, append=len(hashes))


class MisraGries:
    """A mergeable summary of at most ``capacity`` counters.

    A true count is at least its counter and at most counter + ``lost``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts[order], first)
        if len(keys) > self.capacity:
            at = len(keys) - self.capacity - 1
            evicted = np.partition(counts, at)[at]  # the largest count without a counter
            counts = counts - evicted
            kept = counts > 0
            keys, counts = keys[kept], counts[kept]
            self.lost += int(evicted)
        self.keys, self.counts = keys, counts

    def may_reach(self, threshold: int) -> np.ndarray:
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


_SUMMARY = fields(part=IntegerType(), kind=IntegerType(), mass=LongType(), keys=BinaryType(), counts=BinaryType())


def _summaries(hashes: np.ndarray, edges: np.ndarray, at_once: int = 64) -> Iterator[pd.DataFrame]:
    """Per hash partition a row with its mass (kind 0) and one with its summary (kind 1)."""
    keys, counts = counted(hashes)
    cuts = np.append(np.searchsorted(keys, edges), len(keys))
    for low in range(0, len(edges), at_once):
        out = []
        for part in range(low, min(low + at_once, len(edges))):
            mine = slice(cuts[part], cuts[part + 1])
            if mine.start < mine.stop:
                out.append((part, 0, int(counts[mine].sum()), None, None))
                out.append((part, 1, 0, keys[mine].tobytes(), counts[mine].astype("<u4").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_SUMMARY.names)


def _summariser(hashes_of: Callable[[Runs], Iterator[np.ndarray]], parts: int, longest: int, chunk: int):
    edges = np.array([-(-(n << 64) // parts) for n in range(parts)], np.uint64)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for _, runs in runs_of(batch, longest):
                for hashes in hashes_of(runs):
                    held.append(hashes)
                    n += len(hashes)
                if n >= chunk:
                    yield from _summaries(np.concatenate(held), edges)
                    held, n = [], 0
        if n:
            yield from _summaries(np.concatenate(held), edges)

    return summarise


def _merger(threshold: int, slack: int):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, mass, summary = None, 0, None

        def found() -> Iterator[pd.DataFrame]:
            if summary is not None:
                yield pd.DataFrame({"key": summary.may_reach(threshold).view("<i8")})

        for batch in batches:
            for here, kind, weight, keys, counts in batch.itertuples(index=False, name=None):
                if here != part:
                    yield from found()
                    part, mass, summary = here, 0, None
                if kind == 0:  # all masses of a partition come before its summaries
                    mass += weight
                    continue
                summary = summary or MisraGries(slack * mass // threshold + 1)
                summary.merge(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64))
        yield from found()

    return merge


def survivors(docs: DataFrame, hashes_of: Callable[[Runs], Iterator[np.ndarray]], hash_parts: int, longest: int = LONGEST,
              threshold: int = THRESHOLD, slack: int = SLACK, chunk: int = CHUNK) -> DataFrame:
    """``key``: hashes of all runs that occur ``threshold`` times, and of few others."""
    summaries = docs.mapInPandas(_summariser(hashes_of, hash_parts, longest, chunk), _SUMMARY)
    dealt = summaries.repartition(shuffle_parts(docs), "part").sortWithinPartitions("part", "kind")
    return dealt.mapInPandas(_merger(threshold, slack), longs("key"))


class Filter:
    """Two bits of a hash in a bitmap: no hash of the set is missed, few others pass."""

    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.bits = bitmap, bits

    @classmethod
    def of(cls, keys: DataFrame, bits: int = FILTER_BITS) -> "Filter":
        """Spark sets the bits; the bitmap, of one size at any number of keys, comes to the driver."""
        high = F.shiftrightunsigned("key", 64 - bits)
        low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
        each = keys.select(F.explode(F.array(high + 1, low + 1)).alias("bit"))  # the functions count from 1
        found = each.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for bucket, part in found.collect():
            at = (bucket - 1) * _BITMAP // 8
            bitmap[at:at + len(part)] = np.frombuffer(part, np.uint8)[:len(bitmap) - at]
        return cls(bitmap, bits)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = self._set(hashes >> np.uint64(64 - self.bits))
        likely = np.flatnonzero(out)
        out[likely] = self._set(hashes[likely] & np.uint64((1 << self.bits) - 1))
        return out


# Exact counts and scores --------------------------------------------------------------------

_PACKED = fields(part=IntegerType(), runs=BinaryType(), counts=BinaryType())
_COUNTS = fields(lang=StringType(), phrase=StringType(), words=IntegerType(), a=LongType())


def _counter(short, long, longest: int, parts: int, held: int = 200_000):
    """Counts the runs that pass the filters, and sends one row per hash partition.

    A run is written as its language in hexadecimal digits, a line end and its words; a language alone stands for all its words.
    """

    def packed(counts: dict) -> pd.DataFrame:
        dealt: dict[int, list] = {}
        for (part, run), n in counts.items():
            dealt.setdefault(part, []).append((run, n))
        return pd.DataFrame([
            (part, b"\r".join([run for run, _ in found]), np.array([n for _, n in found], "<i8").tobytes()) for part, found in dealt.items()
        ], columns=_PACKED.names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}

        def add(lang: bytes, runs: Runs, starts: np.ndarray, length: int, kept: Filter) -> None:
            hashes = runs.hashes(starts, length)
            likely = kept.may_hold(hashes)
            for key, phrase, n in runs.counted(starts[likely], length, hashes[likely]):
                at = key * parts >> 64, lang + phrase
                counts[at] = counts.get(at, 0) + n

        for batch in batches:
            for lang, runs in runs_of(batch, longest):
                own = lang.encode().hex().encode() + b"\n"  # any name, without the marks used here
                every = xxhash.xxh64_intdigest(own) * parts >> 64, own
                counts[every] = counts.get(every, 0) + int(runs.fresh.sum())
                for length in (1, 2):
                    add(own, runs, runs.starts(length), length, short.value)
                for length, starts in runs.of_frequent_pairs(short.value, longest):
                    add(own, runs, starts, length, long.value)
                if len(counts) > held:
                    yield packed(counts)
                    counts = {}
        if counts:
            yield packed(counts)

    return count


def _adder(threshold: int):
    """Adds up the counts of a hash partition and keeps the frequent runs."""

    def frequent(counts: dict) -> pd.DataFrame:
        out = []
        for run, a in counts.items():
            lang, phrase = run.decode().split("\n")
            if not phrase or a >= threshold:
                out.append((bytes.fromhex(lang).decode(), phrase, phrase.count(" ") + 1 if phrase else 0, a))
        return pd.DataFrame(out, columns=_COUNTS.names)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, counts = None, {}
        for batch in batches:
            for here, runs, found in batch.itertuples(index=False, name=None):
                if here != part:
                    yield frequent(counts)
                    part, counts = here, {}
                for run, n in zip(runs.split(b"\r"), np.frombuffer(found, "<i8").tolist()):
                    counts[run] = counts.get(run, 0) + n
        yield frequent(counts)

    return add


def frequent_runs(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, chunk: int = CHUNK,
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``: exact counts of all frequent words and phrases.

    A row of no words holds the number of all words of the language.  ``docs`` has ``lang``
    and ``text`` without nulls and is read several times.
    """
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hash_parts = max(LEAST_PARTITIONS, size // PARTITION_BYTES)

    def short_runs(runs: Runs) -> Iterator[np.ndarray]:
        for length in (1, 2):
            yield runs.hashes(runs.starts(length), length)

    shorts = settle(survivors(docs, short_runs, hash_parts, longest, threshold, chunk=chunk), "short-runs")
    short = context.broadcast(Filter.of(shorts, filter_bits))

    def long_runs(runs: Runs) -> Iterator[np.ndarray]:
        for length, starts in runs.of_frequent_pairs(short.value, longest):
            yield runs.hashes(starts, length)

    longer = settle(survivors(docs, long_runs, hash_parts, longest, threshold, chunk=chunk), "long-runs")
    long = context.broadcast(Filter.of(longer, filter_bits))
    packed = docs.mapInPandas(_counter(short, long, longest, hash_parts), _PACKED)
    dealt = packed.repartition(shuffle_parts(docs), "part").sortWithinPartitions("part")
    return settle(dealt.mapInPandas(_adder(threshold), _COUNTS), "frequent-runs")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD,
                 share: int = 100, first: int = FIRST, chunk: int = CHUNK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    ``a``, ``l``, ``r`` count the phrase and the two parts of its weakest cut, ``n`` all words.
    A candidate inside a longer one that has ``share`` percent of its occurrences is left out.
    """
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = frequent_runs(given, longest, threshold, chunk, filter_bits)
    totals = runs.filter("words = 0").select("lang", F.col("a").alias("n"))
    parts = runs.filter("words > 0").select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = (
        runs.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " "))
    )
    # Products pass 64 bits; in 38 digits they are exact.
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .join(totals, "lang")
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    shorter = F.explode(F.array(F.array_join(F.slice(words, 2, F.col("words")), " "), F.array_join(F.slice(words, 1, F.col("words") - 1), " ")))
    inside = runs.filter("words > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("outer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = scored.join(covered, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l"), F.col("cut.r"), "n", F.col("cut.score").cast("long").alias("score"))


_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lines AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
  FROM lines, (VALUES (1), (2), (3), (4), (5)) AS t(words) WHERE len(w) >= words
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), counts AS (
  SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, words, phrase, a, k, array_to_string(s[1:k], ' ') AS lhs, array_to_string(s[k + 1:], ' ') AS rhs
  FROM (SELECT *, string_split(phrase, ' ') AS s FROM counts WHERE words > 1), (VALUES (1), (2), (3), (4)) AS t(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, t.n, c.k, x.a AS l, y.a AS r,
         (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals t USING (lang) JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM counts b WHERE b.lang = s.lang AND b.words > s.words AND 100 * b.a >= 100 * s.a
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM kept) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
