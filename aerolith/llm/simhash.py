"""Near-duplicate documents by SimHash, compared bit-sliced.

A document's fingerprint has 64 bits; a bit is set if it is set in over half the hashes of
the document's word shingles.  Documents link when their fingerprints differ in at most
``radius`` bits, and links join them into components.

* Equal fingerprints are one node, so copies cost nothing further.
* Two fingerprints that differ in three bits agree in at least one of four blocks, in one
  pair of five blocks, and so on: they share a bucket (table, bits of the chosen blocks).
  More blocks give longer keys and more tables; their number follows the count of
  fingerprints and changes the work, never the result.
* In a bucket, bit planes are stored vertically: a 64-bit word holds one bit of 64
  fingerprints.  A fingerprint is compared with 64 others at a time, plane by plane, in
  carry-save counters of two bits and an overflow; words in which all others have
  overflowed are abandoned.  What comes out is a spanning forest, not the pairs.
* A bucket above ``cap`` is dealt into chunks by hash, and every pair of chunks is compared
  in a task of its own.
* Components come from alternating large-star and small-star steps on a written table.

Null text counts as empty.  Documents without words have fingerprint zero and link like
any others.  Repeated rows are one node.  The component of documents that all lack an id
is null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from aerolith.llm.common import longs, pack, shuffle_parts, unpack
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

#: Fixed by the contract: words in a shingle, seed of the hash, differing bits of a link.
WORDS, SEED, RADIUS = 3, 42, 3
#: Members of a bucket that one task compares.
CAP = 1 << 14
PLANES_AT_ONCE = 8
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not found:
        return np.zeros(0, "<u8")
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[n:] for n in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    hashes = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(text) for text in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed long."""
    return _fingerprints(text)


class Counters:
    """Distances of pairs of a fingerprint and a word of 64 others, counted vertically."""

    def __init__(self, pairs: int):
        self.ones = np.zeros(pairs, np.uint64)
        self.twos = np.zeros(pairs, np.uint64)
        self.over = np.zeros(pairs, np.uint64)

    def add(self, differ: np.ndarray) -> None:
        carry = self.ones & differ
        self.ones ^= differ
        self.over |= self.twos & carry
        self.twos ^= carry

    def keep(self, alive: np.ndarray) -> None:
        self.ones, self.twos, self.over = self.ones[alive], self.twos[alive], self.over[alive]

    def within(self, radius: int) -> np.ndarray:
        beyond = [self.ones | self.twos, self.twos, self.ones & self.twos, np.uint64(0)][radius]
        return ~(self.over | beyond)


def bit_sliced(planes: np.ndarray, words: np.ndarray, fps: np.ndarray, lanes: np.ndarray, radius: int):
    """For pairs (fingerprint, word): which lanes lie within the radius.

    ``planes[bit, word]`` holds the bit of 64 fingerprints, ``lanes`` those that count.
    Returns the pairs with a hit, and their hits.
    """
    at = np.flatnonzero(lanes)
    words, fps, lanes = words[at], fps[at], lanes[at]
    counters = Counters(len(at))
    for bit in range(64):
        own = np.uint64(0) - (fps >> np.uint64(bit) & _ONE)  # all ones where the bit is set
        counters.add(planes[bit][words] ^ own)
        if bit % PLANES_AT_ONCE == PLANES_AT_ONCE - 1:
            alive = np.flatnonzero(lanes & ~counters.over)
            if len(alive) < len(at):
                at, words, fps, lanes = at[alive], words[alive], fps[alive], lanes[alive]
                counters.keep(alive)
            if not len(at):
                break
    hits = lanes & counters.within(radius)
    found = np.flatnonzero(hits)
    return at[found], hits[found]


def _planes(fps: np.ndarray, lane: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_or.reduceat((fps >> np.uint64(bit) & _ONE) << lane, starts) for bit in range(64)])


def link_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of up to 64, each in a word of its own: every member and the first it is joined with."""
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(fps)) - np.repeat(starts, sizes)
    lane = place.astype(np.uint64)
    full = ~np.uint64(0) >> (np.uint64(64) - sizes.astype(np.uint64))
    at, hits = bit_sliced(_planes(fps, lane, starts), word, fps, full[word] & ~(_ONE << lane), radius)
    if not len(at):
        return fps[:0], fps[:0]
    reach = _ONE << lane
    reach[at] |= hits
    rows = np.flatnonzero(np.isin(word, np.unique(word[at])))
    for k in range(int(sizes.max())):  # reached through member k
        through = rows[(reach[rows] >> np.uint64(k) & _ONE).astype(bool)]
        reach[through] |= reach[starts[word[through]] + k]
    lowest = np.bitwise_count((reach & (~reach + _ONE)) - _ONE).astype(np.int64)
    moved = np.flatnonzero(lowest != place)
    return fps[moved], fps[starts[word[moved]] + lowest[moved]]


def link_large(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``link_small``, for one group of any size: 64 members at a time against all words.

    Words whose members are all joined with the one that asks are left out, so a dense
    group costs little more than reading it once.
    """
    n = len(fps)
    lane = (np.arange(n) % 64).astype(np.uint64)
    starts = np.arange(0, n, 64)
    planes = _planes(fps, lane, starts)
    full = np.full(len(starts), ~np.uint64(0))
    full[-1] >>= np.uint64(len(starts) * 64 - n)
    label = np.arange(n)
    for first in starts:
        asks = np.arange(first, min(first + 64, n))
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        joined = (low == high)[None, :] & (low[None, :] == label[asks][:, None])
        # Earlier members have asked already.
        who, word = np.nonzero(~joined & (np.arange(len(starts)) >= first // 64)[None, :])
        lanes = full[word]
        own = word == first // 64
        lanes[own] &= ~(_ONE << lane[asks[who[own]]])
        at, hits = bit_sliced(planes, word, fps[asks[who]], lanes, radius)
        for member in np.unique(who[at]):
            mine = who[at] == member
            bits = np.unpackbits(hits[mine].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
            others = (word[at[mine]][:, None] * 64 + np.arange(64))[bits]
            merged = np.unique(np.append(label[others], label[asks[member]]))
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _linker(radius: int):
    def groups(buckets: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1]))
        sizes = np.diff(starts, append=len(buckets))
        a, b = [fps[:0]], [fps[:0]]
        small = (sizes > 1) & (sizes <= 64)
        if small.any():
            rows = np.flatnonzero(np.repeat(small, sizes))
            counts = sizes[small]
            found = link_small(fps[rows], np.cumsum(counts) - counts, counts, radius)
            a.append(found[0])
            b.append(found[1])
        for n in np.flatnonzero(sizes > 64):
            found = link_large(fps[starts[n]:starts[n] + sizes[n]], radius)
            a.append(found[0])
            b.append(found[1])
        return pd.DataFrame({"a": np.concatenate(a).view("<i8"), "b": np.concatenate(b).view("<i8")})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, fps = np.zeros(0, "<i8"), np.zeros(0, "<u8")
        for batch in batches:
            buckets = np.concatenate([buckets, batch["bucket"].to_numpy()])
            fps = np.concatenate([fps, batch["fp"].to_numpy().view("<u8")])
            whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0  # the last bucket may go on
            if whole:
                yield groups(buckets[:whole], fps[:whole])
                buckets, fps = buckets[whole:], fps[whole:]
        if len(fps):
            yield groups(buckets, fps)

    return link


def blocks_for(n: int, radius: int = RADIUS, least: int = 0) -> int:
    """Blocks that the bits are cut into, so that random fingerprints meet in short buckets."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 256 and blocks < 8:
        blocks += 1
    return max(blocks, least)


def _keys(fp: Column, blocks: int, radius: int) -> Column:
    """The tables' keys of a fingerprint: for each choice of blocks, its bits there."""
    edges = [64 * n // blocks for n in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    chosen = [sum(masks[n] for n in kept) for kept in combinations(range(blocks), blocks - radius)]
    assert len(chosen) == comb(blocks, radius)
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in chosen]
    return F.array(*[F.struct(F.lit(n).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("key")) for n, mask in enumerate(signed)])


def links(nodes: DataFrame, radius: int = RADIUS, cap: int = CAP, blocks: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints that together connect all that link, from distinct ``fp``.

    ``nodes`` is read several times: give a stored table.
    """
    parts = shuffle_parts(nodes)
    blocks = blocks or blocks_for(nodes.count(), radius)
    members = nodes.select("fp", F.explode(_keys(F.col("fp"), blocks, radius)).alias("at")).select("fp", "at.t", "at.key")
    large = settle(members.groupBy("t", "key").agg(F.count("*").alias("m")).filter(F.col("m") > cap), "large-buckets")
    whole = members
    dealt = None
    if not large.isEmpty():
        whole = members.join(large, ["t", "key"], "left_anti")
        chunks = F.ceil(F.col("m") / cap).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
        dealt = (
            members.join(large, ["t", "key"])
            .select("fp", "t", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
            .select("fp", "t", "key", "chunk", other)
            .select("fp", F.xxhash64("t", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("bucket"))
        )
    # Buckets that share a hash are compared together, which finds nothing that is no link.
    dealt_whole = whole.select("fp", F.xxhash64("t", "key").alias("bucket"))
    both = dealt_whole if dealt is None else dealt_whole.unionByName(dealt)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_linker(radius), longs("a", "b"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes but the roots.

    Large-star hangs a node's larger neighbours on the least one around it, small-star its
    smaller ones; every edge then points down, and what is stable is a star per component.
    """
    stars = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before, n_before = None, -1
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        hung = settle(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        low = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        stars = settle(low.filter("u <> v").distinct(), label)
        n = stars.count()
        if n == n_before and stars.join(before, ["u", "v"], "left_anti").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n_before = stars, n


def label_fingerprints(marked: DataFrame, radius: int = RADIUS, cap: int = CAP, blocks: int | None = None) -> DataFrame:
    """``fp``, its ``root``, its own least ``id`` and the ``component_id``, from stored rows of ``fp`` and ``id``."""
    nodes = settle(marked.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    found = components(links(nodes, radius, cap, blocks))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return settle(rooted.join(least, "root").select("fp", "root", "id", "component_id"), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    cap: int = CAP, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``."""
    marked = settle(docs.select(F.col(doc_id).alias("id"), fingerprint(F.col(text)).alias("fp")), "simhash")
    labels = label_fingerprints(marked, radius, cap, blocks).select("fp", "component_id")
    return marked.join(labels, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; of rows with that id, the one of least content hash."""
    rows = pack(docs, id=F.col(doc_id), fp=fingerprint(F.col(text)))
    # Stored with a number of their own, rows can be chosen without moving them: a group of copies
    # of any size, with or without ids, is combined before the shuffle.
    marked = settle(rows.withColumns({"hash": F.xxhash64("row"), "at": F.monotonically_increasing_id()}), "simhash-rows")
    labels = label_fingerprints(marked.select("id", "fp"), radius)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "at"))
    of_each = marked.groupBy("fp").agg(first.alias("first"))
    keepers = of_each.join(labels.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    # The rows kept grow with the table: they are shuffled to, never broadcast, at any size.
    return unpack(marked.join(keepers.select("first.at").hint("merge"), "at", "left_semi"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
