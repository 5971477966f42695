"""The registered functions and the whole pipeline, against plain Python, the tokenizers' libraries and DuckDB."""

import base64
import hashlib
import random
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_simhash import by_definition, least_reachable
from tokenizers import Tokenizer

from aerolith.llm import bpe, html_blocks
from aerolith.llm.queries import ORACLES, QUERIES


def prose(pick, n):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("r", "nt", "ll", "st", "m")]
    return " ".join(pick.choices(words, k=n)) + "."


def planted(seed=11):
    """Clean documents, exact copies, near copies, rejects, odd texts; ids are unique."""
    pick = random.Random(seed)
    texts, sources = [], []
    for n in range(40):
        texts.append(prose(pick, pick.randrange(60, 220)))
        sources.append(pick.choice(["src1", "src2", "src3", None]))
    for n in range(8):
        texts.append(texts[n])  # exact copies
        words = texts[n + 8].split(" ")
        words[5] = "changed"  # near copies: a word of a long text
        texts.append(" ".join(words))
        sources += ["src1", "src2"]
    for bad in ("too short", "again and " * 60, "", None, "é" * 5000, "###### $$$$ " * 60, " \n\t "):
        texts.append(bad)
        sources.append("src4")
    return [(7 * n + 1, text, "en", source, len(text or "")) for n, (text, source) in enumerate(zip(texts, sources))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return array("I", ids).tobytes()


def test_op2(spark, corpus, library):
    folder, rows = corpus
    found = {row.doc_id: row for row in QUERIES["op2_token_counts"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[doc_id].n_bytes, found[doc_id].n_tokens, found[doc_id].over_limit) == (len((text or "").encode()), n, n > 512)
    assert len(found) == len(rows)


def test_op5(spark, corpus, library):
    folder, rows = corpus
    start, wanted = 0, []
    for doc_id, text, *_ in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    found = QUERIES["op5_wavelet_ids"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == wanted


def test_op8(spark, corpus, ranked):
    folder, rows = corpus
    found = {row.doc_id: row for row in QUERIES["op8_byte_bpe"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        ids = ranked.encode_ordinary(text or "")
        assert found[doc_id].n_tokens == len(ids)
        assert found[doc_id].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert found[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def groups(rows):
    fps = [by_definition(row[1]) for row in rows]
    return fps, least_reachable(fps, [row[0] for row in rows])


def test_op9(spark, corpus):
    folder, rows = corpus
    fps, least = groups(rows)
    found = {row.doc_id: (row.fingerprint, row.component_id) for row in QUERIES["op9_simhash"](spark, folder).collect()}
    assert found == {row[0]: (f"{fp & (1 << 64) - 1:016x}", one) for row, fp, one in zip(rows, fps, least)}
    assert len(set(least)) < len(rows) - 8  # exact and some near copies are in one group


def test_op10(spark, folder):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(12, 16))
    rows = [(n, (centres[n % 12] + 0.2 * pick.normal(size=16)).astype("f4").tolist()) for n in range(600)]
    rows += [(600, None), (700, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    data = np.array([v for _, v in rows[:600]], np.float64)
    hits, found = 0, {}
    for row in QUERIES["op10_nearest_vectors"](spark, folder).collect():
        found.setdefault(row.query_id, {})[row.rank] = (row.score, row.vec_id)
    assert sorted(found) == list(range(0, 600, 100))
    for query, ranks in found.items():
        apart = np.sqrt(((data - data[query]) ** 2).sum(axis=1))
        order = [n for n in np.lexsort((np.arange(600), apart)) if n != query][:10]
        assert sorted(ranks) == list(range(1, 11)) and [ranks[r] for r in range(1, 11)] == sorted(ranks.values())
        assert all(abs(apart[n] - score) < 1e-12 for score, n in ranks.values())
        hits += len(set(order) & {n for _, n in ranks.values()})
    assert hits >= 0.9 * 60


def test_op7(spark, folder):
    story = "This is the text of the story, and it was long enough to be good for all of the readers that have come here to read it."
    pages = {
        1: (f"<html><body><nav><a href=/>Home</a></nav><article><h1>On &amp; on</h1><p>{story}</p><p>End.</p></article><footer>{story}</footer>", f"On & on\n\n{story}\n\nEnd."),
        2: (f"<div class=content><h2>No marks</h2><p>{story}\n  {story}</p></div><ul><li><a href=x>{story}</a></ul>", f"No marks\n\n{story} {story}"),
        3: (None, ""), 4: ("", ""), 5: ("<p>" * 3, ""),
    }
    spark.createDataFrame([(n, f"http://x/{n}", html) for n, (html, _) in pages.items()], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    found = {row.page_id: row for row in QUERIES["op7_html_text"](spark, folder).collect()}
    assert {n: (row.text, row.n_chars, row.url) for n, row in found.items()} == {n: (text, len(text), f"http://x/{n}") for n, (_, text) in pages.items()}
    assert html_blocks.main_text(pages[1][0]) == pages[1][1]


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_token_counts", "op5_wavelet_ids", "op6_source_mix", "op8_byte_bpe", "op9_simhash", "op12_secret_spans"])
def test_empty_documents(spark, folder, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    assert QUERIES[name](spark, folder).collect() == []


# The pipeline -------------------------------------------------------------------------------


def pipeline_by_hand(rows, ranked):
    """Ids of the documents that come out, as often as they do: SQL for the rules and the mix, plain Python for the rest."""

    def sql(name, docs, columns):
        connection = duckdb.connect()
        connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        if docs:
            connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
        return connection.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()

    good = {doc_id for doc_id, kept in sql("op1_quality_rules", rows, "doc_id, kept") if kept}
    kept = [row for row in rows if row[0] in good]
    _, least = groups(kept)
    single = [row for row in kept if row[0] in set(least)]
    times = {doc_id: round(taken / size) for doc_id, size, taken in sql("op6_source_mix", single, "doc_id, size, taken")}
    texts = {row[0]: row[1] for row in single}
    return Counter({(doc_id, packed(ranked.encode_ordinary(texts[doc_id]))): n for doc_id, n in times.items() if n}), kept, single


def test_pipeline_equals_its_stages_by_hand(spark, corpus, ranked):
    import corpus_pipeline

    folder, rows = corpus
    wanted, kept, single = pipeline_by_hand(rows, ranked)
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((row.doc_id, bytes(row.ids)) for row in found) == wanted
    assert all(row.intact and row.n_tokens == len(row.ids) // 4 for row in found)
    # The fixture has something to do in every stage.
    assert len(kept) < len(rows) and len(single) < len(kept) and max(wanted.values()) > 1


def test_pipeline_without_copies_and_on_an_empty_table(spark, tmp_path, ranked):
    import corpus_pipeline

    rows = [row for row in planted(3)[:30]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert Counter((row.doc_id, bytes(row.ids)) for row in found) == pipeline_by_hand(data, ranked)[0]


def test_stages_are_named_in_order():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "source mix", "byte-level BPE"]
