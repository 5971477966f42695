"""Byte-level BPE: encoding with offsets, and decoding that survives split characters.

The vocabulary is a rank file (one token in base64 and its rank per line); the split
pattern and the file's path are parameters.  Merges are recovered from the ranks, bytes
are mapped to printable characters as the byte-level scheme does, and the tokenizers
library does the merging.  Ids, offsets and decoded text are columns; Arrow batches
carry the texts to the workers.

Null text counts as empty.  Special strings in a text are ordinary text.  Repeated rows
are encoded alike.  Decoding is by token bytes: a character whose bytes lie in several
tokens comes out whole, and bytes that are no valid text can be kept as bytes, replaced
or held back until the rest of the character arrives (``decode_stream``).
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from aerolith.llm.common import fields, pack, small_batches, unpack
from aerolith.llm.registry import query
from aerolith.llm.units import UnitCache, UnitEncoder, as_chars, slices
from aerolith.workload.registry import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by id."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks[rank] for rank in range(len(ranks))]


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """All that decoding needs."""
    return read_ranks(path)


def join_tokens(tokens: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair each token was merged from, in rank order.

    It is what is left of the token's bytes when only lower ranks have been merged.
    """
    rank_of = {token: rank for rank, token in enumerate(tokens)}
    found = []
    for rank, token in enumerate(tokens):
        parts = [token[n:n + 1] for n in range(len(token))]
        while len(parts) > 2:
            lowest, at = min((rank_of.get(a + b, rank), n) for n, (a, b) in enumerate(zip(parts, parts[1:])))
            if lowest >= rank:
                raise ValueError(f"token {rank} is not reached by merges")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found.append(tuple(parts))
    return found


class ByteBPE:
    """One vocabulary in a worker: a library tokenizer, token bytes, and a cache of encoded units."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        vocab = {as_chars(token): rank for rank, token in enumerate(self.tokens)}
        merges = [(as_chars(a), as_chars(b)) for a, b in merges_of(self.tokens)]
        self.tokenizer = Tokenizer(models.BPE(vocab, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        # Workers live on between stages, so what they keep is bounded well below an executor's memory.
        self.encode = UnitEncoder(self.tokenizer, pattern, 100_000).encode
        self.spans = UnitCache(self._spans, 50_000)

    def _spans(self, units: list[str]) -> list[np.ndarray]:
        """Per unit a matrix: id, first and past-the-last character of each token."""
        found = self.tokenizer.encode_batch(units, add_special_tokens=False)
        return [np.column_stack([np.array(e.ids, "<i4"), np.array(e.offsets, "<i4").reshape(-1, 2)]) for e in found]

    def encode_spans(self, text: str | None) -> np.ndarray:
        """Ids and character offsets in the whole text.

        A character whose bytes lie in several tokens is in the span of each of them.
        """
        out, start = [np.zeros((0, 3), "<i4")], 0
        for part in slices(text or ""):
            at = start
            for spans in self.spans.values(part):
                out.append(spans + np.array([0, at, at], "<i4"))
                at += int(spans[-1, 2])
            start += len(part)
        return np.concatenate(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return join_tokens(self.tokens, ids)


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    """Loaded once in each worker process."""
    return ByteBPE(path, pattern)


def decode_stream(bpe: ByteBPE, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
    """Text token by token; a character split over tokens comes with its last byte."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors)
    for token in ids:
        yield decoder.decode(bpe.tokens[token])
    yield decoder.decode(b"", final=True)


def _encoder(path: str, pattern: str):
    @F.pandas_udf(BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path, pattern)
        for texts in batches:
            yield texts.map(bpe.encode, na_action=None)

    return encode


def _span_encoder(path: str, pattern: str):
    kind = ArrayType(IntegerType())

    @F.pandas_udf(fields(ids=kind, starts=kind, ends=kind))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for texts in batches:
            found = [bpe.encode_spans(text) for text in texts]
            yield pd.DataFrame({name: [f[:, n] for f in found] for n, name in enumerate(("ids", "starts", "ends"))})

    return encode


def _decoder(path: str):
    @F.pandas_udf(BinaryType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = token_bytes(path)
        for rows in batches:
            yield rows.map(lambda ids: join_tokens(tokens, np.frombuffer(ids, "<u4").tolist()))

    return decode


def _checked_encoder(path: str, pattern: str):
    @F.pandas_udf(fields(ids=BinaryType(), intact=BooleanType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for texts in batches:
            ids = [bpe.encode(text) for text in texts]
            intact = [bpe.decode(np.frombuffer(packed, "<u4").tolist()) == (text or "").encode() for packed, text in zip(ids, texts)]
            yield pd.DataFrame({"ids": ids, "intact": intact})

    return encode


def _digester(path: str, pattern: str):
    @F.pandas_udf(fields(n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType()))
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for texts in batches:
            rows = []
            for text in texts:
                ids = bpe.encode(text)
                back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encoded(text: Column, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids as little-endian unsigned 32-bit integers in a binary column."""
    return _encoder(path, pattern)(text)


def encoded_spans(text: Column, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """A struct of ``ids`` and of each token's ``starts`` and ``ends`` in characters."""
    return _span_encoder(path, pattern)(text)


def decoded(ids: Column, path: str = RANKS) -> Column:
    """The bytes that packed ids stand for; null ids give null."""
    return F.when(ids.isNotNull(), _decoder(path)(F.coalesce(ids, F.lit(b""))))


def encoded_checked(text: Column, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """A struct of packed ``ids`` and of ``intact``, whether they decode to the text's bytes, in one pass."""
    return _checked_encoder(path, pattern)(text)


def round_trip(text: Column, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Encodes and decodes in one pass: ``n_tokens`` and the digests of the ids and of the decoded bytes."""
    return _digester(path, pattern)(text)


def encode_documents(docs: DataFrame, text: str = "text", path: str = RANKS,
                     pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``ids``, ``starts`` and ``ends``; columns of those names are replaced."""
    done = pack(docs, found=encoded_spans(F.col(text), path, pattern))
    return unpack(done, **{name: F.col(f"found.{name}") for name in ("ids", "starts", "ends")})


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", round_trip(F.col("text")).alias("found"))
    return docs.select("doc_id", "found.*")
