"""Prefix counts, byte-level BPE and wavelet shards against the tokenizers' own libraries."""

import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolith.llm import bpe, prefix_counts, unit_groups, units, wavelet

ALPHABET = list("ab '\n\t  sé中\U0001f600́!1\x85 d'l\x1c") + [
    "'ll", "'re", " the", "ing", "<|endoftext|>", "<|endo", "\n\n", "  ", "aaaa", "ーー", ", ", ". ", " word"]


def random_texts(n, most=12, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return array("I", ids).tobytes()


def test_every_prefix_has_the_library_count(library):
    counts = prefix_counts.counter(prefix_counts.TOKENIZER, public_tokenizers.PATTERN).counts
    for text in random_texts(400):
        prefixes = [text[:n] for n in range(len(text) + 1)]
        assert counts(text).tolist() == [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)], repr(text)


def test_prefix_tables_answer_budgets(spark, library, odd_docs):
    stored = prefix_counts.with_prefix_table(odd_docs)
    assert stored.columns == [*odd_docs.columns, "prefix_tokens"]
    asked = stored.select(
        "text", prefix_counts.fitting_chars(F.col("prefix_tokens"), F.lit(20)).alias("fits"),
        prefix_counts.prefix_tokens(F.col("prefix_tokens"), F.lit(5)).alias("five"))
    for text, fits, five in asked.collect():
        text = text or ""
        size = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids)
        assert five == size(5)
        assert size(fits) <= 20 and (fits == len(text) or all(size(n) > 20 for n in range(fits + 1, min(fits + 6, len(text) + 1))))


def test_a_cache_that_overflows_changes_nothing(library):
    encoder = units.UnitEncoder(library, public_tokenizers.PATTERN, limit=3)
    for text in random_texts(300, 30, seed=2):
        assert encoder.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_words_of_latin_letters_need_no_pattern(library, monkeypatch):
    encoder = units.UnitEncoder(library, public_tokenizers.PATTERN)
    for char in map(chr, range(33, 0x250)):
        for unit in (f" a{char}", f" {char}b,", f" {char}", f"\n{char}a"):
            if not units.all_plain(units.keys(unit)[1:]):
                continue
            assert encoder.split(unit) == encoder.findall(unit), repr(unit)
            ids = packed(library.encode(unit, add_special_tokens=False).ids)
            assert encoder.encode(unit) == ids and b"".join(encoder._fill([unit])) == ids, repr(unit)
    assert [units.as_chars(bytes([byte])) for byte in range(256)] == [units.byte_chars()[byte] for byte in range(256)]
    monkeypatch.setattr(encoder, "findall", None)
    assert encoder.split(" tzüß.") == [" tzüß", "."] and encoder.split(" laéoi") == [" laéoi"]


@pytest.mark.parametrize("limit,group", [(3, 1), (3, 500), (100, 5000), (600_000, 1 << 22)])
def test_groups_of_texts_have_the_library_ids(library, monkeypatch, limit, group):
    monkeypatch.setattr(unit_groups, "slices", lambda text: units.slices(text, 40))
    odd = ["\nWord", " tzüß.", " a×b", " \xa0", "\u3000", " \u2028 ", "\u205f ", "\u1680\t", "中 ", "\u0251", "\xff", "\x00", "''", ".,"]
    rng = random.Random(limit)
    texts = ["".join(rng.choice(ALPHABET + odd) for _ in range(rng.choice([0, 1, 5, 30, 100]))) for _ in range(600)]
    texts += [text.replace("<|endoftext|>", "") for text in texts] + [None]
    found = unit_groups.GroupEncoder(library, public_tokenizers.PATTERN, limit, group).encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_every_character_below_u0250_is_cut_as_by_the_library(library):
    texts = [text for char in map(chr, range(0x250)) for text in (char, f" a{char}", f" {char}b,", f"\n{char}a", f"a{char} b", f"{char}\n.")]
    found = unit_groups.GroupEncoder(library, public_tokenizers.PATTERN).encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_shards_have_each_distinct_piece_merged_once(monkeypatch):
    wavelet.encoder.cache_clear()
    encoder, merged = wavelet.encoder(wavelet.TOKENIZER), []
    merge = encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda pieces: merged.extend(pieces) or merge(pieces))
    texts = [" groß groß. groß,\ngroß!", "groß $$$ groß$$$ groß", None, " groß\t\tgroß? don't"] * 50
    list(encoder.encode(texts))
    assert sorted(merged) == sorted(set(merged)) and set(merged) == {
        piece.encode() for piece in ["groß", " groß", "\n", "\t", "$$$", " $$$", ".", ",", "!", "?", " don", "'t"]}
    list(encoder.encode(texts[:4]))
    assert len(merged) == 12
    wavelet.encoder.cache_clear()


def test_long_texts_are_cut_where_units_end():
    text = "".join(random_texts(400, 20, seed=3))
    assert "".join(units.slices(text, 50)) == text
    whole = [unit for unit in units.exact_keys(text)]
    assert "".join(map(units.unit_of, whole)) == text


def test_encoding_equals_the_rank_library(ranked):
    ours = bpe.vocabulary(bpe.RANKS, public_tokenizers.PATTERN)
    for text in random_texts(600, 30, seed=4):
        assert ours.encode(text) == packed(ranked.encode_ordinary(text)), repr(text)
        spans = ours.encode_spans(text)
        whole = ours.tokenizer.encode(text)
        assert spans[:, 0].tolist() == whole.ids
        assert [tuple(span) for span in spans[:, 1:].tolist()] == whole.offsets


def test_decoding_holds_split_characters_back():
    ours = bpe.vocabulary(bpe.RANKS, public_tokenizers.PATTERN)
    text = "a 中\U0001f600 é"
    ids = np.frombuffer(ours.encode(text), "<u4").tolist()
    parts = list(bpe.decode_stream(ours, ids))
    assert "".join(parts) == text and "�" not in "".join(parts)
    assert ours.decode(ids) == text.encode()
    assert list(bpe.decode_stream(ours, ids[:2]))[-1] in ("", "�")


def test_merges_rebuild_every_token():
    tokens = bpe.read_ranks(bpe.RANKS)
    assert [a + b for a, b in bpe.merges_of(tokens)] == [token for token in tokens if len(token) > 1]


def test_round_trip_of_odd_rows(odd_docs, ranked):
    done = bpe.encode_documents(odd_docs)
    assert done.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "starts", "ends"]
    for row in done.collect():
        assert row.ids == ranked.encode_ordinary(row.text or "") and len(row.starts) == len(row.ids)
    for row in odd_docs.select("text", bpe.round_trip(F.col("text")).alias("r")).collect():
        text = row.text or ""
        assert row.r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.r.ids_sha256 == hashlib.sha256(packed(ranked.encode_ordinary(text))).hexdigest()
    assert bpe.encode_documents(odd_docs.filter("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
def test_wavelet_matrix_answers_like_the_array(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 300).astype("<u2")
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert (matrix.decode() == ids).all() and matrix.n == n
    assert n == 0 or (matrix.access(np.arange(n)) == ids).all()
    for token in (0, 1, 2, 7, 299, 40_000):
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.rank(token, n // 2) == (ids[:n // 2] == token).sum()
        assert [matrix.select(token, k) for k in range(len(places))] == places.tolist()
        assert matrix.select(token, len(places)) == matrix.select(token, -1) == -1


def test_shards_hold_documents_in_order(spark, odd_docs, folder, library):
    wavelet.write_shards(odd_docs, f"{folder}/ids", shard_ids=200)
    starts = wavelet.shard_starts(spark, f"{folder}/ids")
    docs = wavelet.read_documents(spark, f"{folder}/ids").join(starts, ["part", "seq"])
    found = docs.selectExpr("start + offset AS at", "doc_id", "n_tokens", "crc32(ids) AS crc").orderBy("at").collect()
    texts = {}
    for row in odd_docs.collect():
        texts.setdefault(row.doc_id, []).append(row.text or "")
    assert [row.doc_id for row in found] == sorted([r.doc_id for r in odd_docs.collect()], key=lambda d: (d is not None, d or 0))
    at = 0
    for row in found:
        assert row["at"] == at
        at += row.n_tokens
        possible = [packed(library.encode(text, add_special_tokens=False).ids + [0]) for text in texts[row.doc_id]]
        assert row.crc in [zlib.crc32(ids) for ids in possible]
    assert sum(row.n for row in wavelet.occurrences(spark, f"{folder}/ids", 0).collect()) >= len(found)


def test_an_empty_table_makes_an_empty_file(spark, odd_docs, folder):
    wavelet.write_shards(odd_docs.filter("false"), f"{folder}/none")
    assert wavelet.read_documents(spark, f"{folder}/none").count() == 0
