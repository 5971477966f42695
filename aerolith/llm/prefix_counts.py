"""Exact token counts of every prefix of a text, by dynamic programming.

For byte-level BPE the last token of a prefix decides everything: a token may end a
prefix if it may stand after the last token of what comes before it, and exactly one
does.  So the count of a prefix is the count of a shorter one plus one, and one pass over
a text gives the count the tokenizer would give for *each* of its prefixes.  The counts
are stored, and answer how much of a text fits a budget, what a prefix costs, and
whether a limit is passed, without encoding anything again.  A stored table holds the steps
from each count to the next in 16 bits, which compress well.

Texts are cut into units that do not influence each other (see ``units``), the table of a
unit is worked out once, and the tables of a text are joined.

Prefixes are counted in characters.  Null text counts as empty and has no prefix but the
empty one, of no tokens; an empty table gives an empty result.  A special string inside a text is one token, as the library has it;
a prefix that ends inside it is ordinary text.  Repeated rows get equal results.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import sub

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType
from tokenizers import Tokenizer

from aerolith.llm.common import fields, pack, small_batches, unpack
from aerolith.llm.registry import query
from aerolith.llm.units import LONGEST_KEPT, SLICE, WHITE_CHARS, UnitCache, UnitEncoder, as_chars, groups, slices
from aerolith.session import scratch_dir
from aerolith.workload.registry import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces of the split pattern whose own prefixes would be split in two (fixed by the pattern).
_SPLIT_INSIDE = ("'re", "'ve", "'ll")
#: Units, and pieces, that a worker keeps: some 200 bytes each, at most twice as many units.
CACHED = 400_000


class PairTest:
    """Whether two tokens can stand side by side.

    Each token is a tree of merges.  While both are built from their bytes, the symbols on
    either side of their border change at known ranks.  The tokens stay apart unless, at
    some time, the two symbols at the border could be merged before either is merged
    with its inner neighbour; of equal ranks the left one is merged first.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(merges)}
        #: By ``left << 32 | right``.
        self.known: dict[int, bool] = {}

    def border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one end of a token, the first one first, each with the rank that replaces it."""
        found, until = [], 1 << 60
        while token in self.parts:
            found.append((token, until))
            left, right, until = self.parts[token]
            token = right if side else left
        found.append((token, until))
        return found[::-1]

    def __call__(self, pair: int) -> bool:
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[pair] = found = self._apart(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def _apart(self, left: int, right: int) -> bool:
        ends, starts = self.border(left, 1), self.border(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if i + 1 == len(ends) and j + 1 == len(starts):
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1


def steps(counts: list[int]) -> bytes:
    """From each count to the next, as 16-bit integers."""
    return array("h", map(sub, counts, [0, *counts])).tobytes()


class PrefixCounter:
    """The prefix tables of one vocabulary, in a worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]]
        self.apart = PairTest(model["vocab"], merges)
        self.encoder = UnitEncoder(Tokenizer.from_file(path), pattern, CACHED)
        self.endings = ahocorasick.Automaton()
        made = self.apart.parts
        for token, rank in model["vocab"].items():
            if rank in made or len(token) == 1:
                self.endings.add_word(token, (rank, len(token), rank << 32))
        self.endings.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.units = UnitCache(self._tables, CACHED)
        #: The last piece and its counts and tokens, see ``_bytes``.
        self.before, self.count, self.last = "", [0], [0]

    def _bytes(self, raw: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, by bytes: the dynamic programme.

        What was found for the piece before holds for the beginning that both share, so
        pieces that come in order cost only what is new in them.
        """
        text, before, count, last = as_chars(raw), self.before, self.count, self.last
        shared = 0
        for a, b in zip(text, before):
            if a != b:
                break
            shared += 1
        # At each end: its count, and its last token shifted to be the left of a pair.
        del count[shared + 1:], last[shared + 1:]
        more = [0] * (len(text) - shared)
        count += more
        last += more
        known, apart = self.apart.known.get, self.apart
        for at, (token, length, left) in self.endings.iter(text):
            end = at + 1
            if count[end]:
                continue
            start = end - length
            if start:
                pair = last[start] | token
                fits = known(pair)
                if fits is False or fits is None and not apart(pair):
                    continue
            count[end] = count[start] + 1
            last[end] = left
        self.before = text
        return count

    def _piece(self, piece: str) -> list[int]:
        """Token counts of all prefixes of a piece but the empty one, by characters."""
        if piece in _SPLIT_INSIDE:
            return [1, 2, self._bytes(piece.encode())[-1]]
        raw = piece.encode()
        count = self._bytes(raw)
        if len(raw) == len(piece):
            return count[1:]
        return [n for n, byte in zip(count[1:], raw[1:] + b" ") if byte & 0xC0 != 0x80]

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Tables of new pieces, in an order in which neighbours begin alike."""
        for piece in sorted(pieces):
            self.pieces[piece] = steps(self._piece(piece))

    def _plain(self, unit: str) -> list[int]:
        """Token counts of all prefixes of a unit but the empty one, without special strings.

        Inside the white space at its start a prefix is one piece, whatever follows.
        """
        white = len(unit) - len(unit.lstrip(WHITE_CHARS))
        out, base = [], 0
        for piece in self.encoder.split(unit):
            found = self._piece(piece)
            out.extend([base + n for n in found])
            base += found[-1]
        if white > 1:
            out[:white] = self._piece(unit[:white]) if white < len(unit) else out
        return out

    def _counts(self, unit: str) -> list[int]:
        """As ``_plain``, with special strings."""
        found = [(unit.index(text), -len(text), text) for text in self.encoder.special if text in unit]
        if not found:
            return self._plain(unit)
        at, _, text = min(found)
        before = self._plain(unit[:at] + text)
        base = (before[at - 1] if at else 0) + 1
        rest = unit[at + len(text):]
        return before[:-1] + [base] + [base + n for n in (self._counts(rest) if rest else [])]

    def _tables(self, units: list[str]) -> list[bytes]:
        """Per unit the steps from each count to the next; those of plain units are those of their pieces."""
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        split, special = self.encoder.split, self.encoder.special
        special = [text for text in special if any(text in unit for unit in units)]
        cut = [
            None if unit[1:2] in WHITE_CHARS or special and any(text in unit for text in special) else split(unit) for unit in units
        ]
        self._learn_pieces({piece for pieces in cut if pieces for piece in pieces} - self.pieces.keys())
        known = self.pieces
        out = [steps(self._counts(unit)) if pieces is None else b"".join([known[piece] for piece in pieces]) for unit, pieces in zip(units, cut)]
        for piece in [piece for pieces in cut if pieces for piece in pieces if len(piece) > LONGEST_KEPT]:
            known.pop(piece, None)
        return out

    def table(self, text: str | None) -> bytes:
        """The steps from the count of each prefix to the next, as 16-bit integers."""
        return b"".join([b"".join(self.units.values(part)) for part in slices(text or "")])

    def counts(self, text: str | None) -> np.ndarray:
        """Token counts of all prefixes, the empty one first."""
        return counts_in(self.table(text))

    def tables(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``table`` of each text; new units are worked out for many texts at a time."""
        for group in groups(texts):
            self.units.learn(part for text in group if len(text) <= SLICE for part in slices(text))
            yield from map(self.table, group)


def counts_in(table: bytes) -> np.ndarray:
    """Token counts of all prefixes, the empty one first, from a stored table."""
    out = np.zeros(len(table) // 2 + 1, "<i4")
    np.cumsum(np.frombuffer(table, "<i2"), dtype="<i4", out=out[1:])
    return out


@lru_cache(2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _table_maker(path: str, pattern: str):
    @F.pandas_udf(BinaryType())
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = counter(path, pattern).tables
        for texts in batches:
            yield pd.Series(list(tables(texts)), dtype=object)

    return make


@F.pandas_udf(LongType())
def _fitting(tables: pd.Series, budgets: pd.Series) -> pd.Series:
    return pd.Series([longest_within(counts_in(t), b) for t, b in zip(tables, budgets)])


@F.pandas_udf(IntegerType())
def _cost(tables: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([int(counts_in(t)[max(0, min(c, len(t) // 2))]) for t, c in zip(tables, chars)])


_SUMMARY = fields(n_tokens=LongType(), fits_chars=LongType())


@F.pandas_udf(_SUMMARY)
def _summaries(tables: pd.Series, budgets: pd.Series) -> pd.DataFrame:
    rows = []
    for table_, budget in zip(tables, budgets):
        found = counts_in(table_)
        rows.append((int(found[-1]), longest_within(found, budget)))
    return pd.DataFrame(rows, columns=_SUMMARY.names)


def prefix_table(text: Column, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN) -> Column:
    """A binary column: the steps from the token count of each prefix to the next, as 16-bit integers."""
    return _table_maker(path, pattern)(text)


def fitting_chars(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix within a budget of tokens, from a stored table."""
    return _fitting(prefixes, budget.cast("long"))


def prefix_tokens(prefixes: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many characters, from a stored table; beyond the text, all its tokens."""
    return _cost(prefixes, chars.cast("long"))


def prefix_summary(prefixes: Column, budget: Column) -> Column:
    """``n_tokens`` of the whole text and ``fits_chars`` within a budget, from a stored table."""
    return _summaries(prefixes, budget.cast("long"))


def with_prefix_table(docs: DataFrame, text: str = "text", path: str = TOKENIZER,
                      pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the column ``prefix_tokens``, which replaces one of that name."""
    done = pack(docs, found=prefix_table(F.col(text), path, pattern))
    return unpack(done, prefix_tokens=F.col("found"))


LIMIT = 512


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables are written once, and every answer is read from them."""
    docs = small_batches(table(spark, sf_dir, "documents"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    folder = scratch_dir(spark, "prefixes") + "/table"
    docs.select("doc_id", size, prefix_table(F.col("text")).alias("prefixes")).write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder).withColumn("found", prefix_summary(F.col("prefixes"), F.lit(LIMIT)))
    return found.select("doc_id", "n_bytes", "found.n_tokens", (F.col("found.n_tokens") > LIMIT).alias("over_limit"), "found.fits_chars")
