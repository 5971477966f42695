import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import phrases


def by_hand(docs, longest=5, threshold=100, share=100, first=2000):
    """The contract, read literally."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for at in range(len(words) - n + 1):
                    counts[lang, tuple(words[at:at + n])] += 1
    frequent = {key: a for key, a in counts.items() if a >= threshold}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        inside = any(
            other_lang == lang and len(other) > len(words) and 100 * b >= share * a
            and any(other[i:i + len(words)] == words for i in range(len(other) - len(words) + 1))
            for (other_lang, other), b in frequent.items())
        if not inside:
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in sorted({row[0] for row in out}):
        best = sorted((row for row in out if row[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        ranked += [(lang, rank, *row[1:]) for rank, row in enumerate(best, 1)]
    return ranked


def found(spark, docs, **given):
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in docs], "lang string, text string, words string, k int").repartition(3)
    rows = phrases.collocations(df, filter_bits=18, **given).collect()
    return sorted(tuple(row) for row in rows)


def random_docs(seed, n=60):
    pick = random.Random(seed)
    words = ["new", "york", "New", "city", "é", "ß", "of", "the", "x\x0by", "a.b", "c!", "d\n", "e\t"]
    return [(pick.choice(["en", "de", None, "und"]), " ".join(pick.choices(words, [5, 4, 3, 3, 1, 1, 4, 6, 1, 1, 2, 2, 1], k=pick.randrange(40))))
            for _ in range(n)] + [("en", None), (None, ""), ("en", "the new york city of " * 30)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_counting_by_hand(spark, seed):
    docs = random_docs(seed)
    assert found(spark, docs, threshold=6) == by_hand(docs, threshold=6)
    assert found(spark, docs, threshold=4, share=80, first=5, longest=4) == by_hand(docs, threshold=4, share=80, first=5, longest=4)


def test_many_small_summaries_and_a_full_filter(spark):
    docs = random_docs(7, 120)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    rows = phrases.collocations(df, threshold=8, chunk=50, filter_bits=15).collect()  # every chunk sends a summary of its own
    assert sorted(tuple(row) for row in rows) == by_hand(docs, threshold=8)


def test_odd_rows(spark, odd_docs):
    rows = phrases.collocations(odd_docs.withColumn("lang", F.lit(None).cast("string")), threshold=2, filter_bits=18).collect()
    docs = [(None, row.text) for row in odd_docs.collect()]
    assert sorted(tuple(row) for row in rows) == by_hand(docs, threshold=2)
    assert phrases.collocations(odd_docs.filter("false"), filter_bits=18).collect() == []
    assert phrases.collocations(odd_docs, threshold=10**6, filter_bits=18).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_lose_no_run(block):
    data = b"aa bb cc. dd ee ff gg hh ii jj kk ll mmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmm nn\too pp.qq"
    whole, parts = Counter(), Counter()
    for size, into in ((1 << 20, whole), (block, parts)):
        for words, carried in phrases.word_blocks(data, 4, size):
            runs = phrases.Runs(words, carried, 1)
            for n in range(1, 6):
                into.update(runs.text(at, n) for at in runs.starts(n))
    assert whole == parts and whole[b"hh ii jj kk ll"] == 1 and whole[b"cc dd"] == 0


def test_summaries_keep_every_frequent_key():
    pick = np.random.default_rng(3)
    keys = np.minimum(pick.zipf(1.3, 60_000), 50_000).astype(np.uint64)
    threshold = 200
    summary = phrases.MisraGries(len(keys) // threshold + 1)
    for part in np.array_split(keys, 400):
        summary.merge(*phrases.counted(part))
        summary.n_waiting += 1 << 16  # settle often
    summary.settle()
    assert len(summary.keys) <= summary.capacity and summary.lost < threshold
    true = Counter(keys.tolist())
    counters = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    for key, n in true.items():
        assert counters.get(key, 0) <= n <= counters.get(key, 0) + summary.lost
    assert {key for key, n in true.items() if n >= threshold} <= set(summary.may_reach(threshold).tolist())


def test_runs_of_equal_hash_are_told_apart():
    runs = phrases.Runs(b"a b c a b d a b".split(), 0, 1)
    starts = runs.starts(2)
    same = np.zeros(len(starts), np.uint64)
    counts = Counter()
    for _, text, n in runs.counted(starts, 2, same):
        counts[text] += n
    assert counts == Counter({b"a b": 3, b"b c": 1, b"c a": 1, b"b d": 1, b"d a": 1})


def test_filter_misses_no_key(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 3000)
    made = phrases.Filter.of(spark.createDataFrame([(int(key),) for key in [*keys, 0, -1, 2**63 - 1, -2**63]], "key long"), 16)
    assert made.may_hold(keys.view(np.uint64)).all()
    assert made.may_hold(np.array([0, 2**64 - 1, 2**63 - 1, 2**63], np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    assert made.may_hold(others).mean() < 0.05


def test_exact_products_beyond_64_bits(spark):
    row = spark.sql("SELECT (cast(4000000000000000 as decimal(19,0)) * cast(9000000000000000 as decimal(19,0)) * 1000) "
                    "div (cast(7 as decimal(19,0)) * cast(9000000000000001 as decimal(19,0))) AS x").first()
    assert row.x == 4 * 10**15 * 9 * 10**15 * 1000 // (7 * 9000000000000001)
