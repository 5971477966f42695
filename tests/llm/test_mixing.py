import math
from collections import defaultdict

from pyspark.sql import functions as F

from aerolith.llm import mixing
from aerolith.sources.writers import settle


def mixed(docs, **options):
    rows = settle(mixing.sized(docs).drop("row"), "test-mix")
    return mixing.mix(rows, [], **options).collect(), rows.collect()


def test_targets_are_shared_again_until_none_is_above(spark):
    given = [("a", 10, 5.0), ("b", 1000, 2.0), ("c", 20, 1.0), ("d", 0, 5.0), (None, 500, 1.0)]
    weighted = settle(spark.createDataFrame(given, "source string, source_size long, weight double"), "test")
    found = {row.source: row.target for row in mixing.targets(weighted).collect()}
    assert math.isclose(sum(found.values()), 1530)
    assert found["a"] == 30 and found["d"] == 0 and found["c"] == 60
    assert math.isclose(found["b"], 2 * found[None])


def test_mix_by_brute_force(make_docs):
    docs = make_docs([(n, " ".join(["w"] * (1 + n % 37)) + " #" * (n % 3), f"s{n % 5}" if n % 7 else "s0") for n in range(900)])
    found, rows = mixed(docs)
    by_source = defaultdict(list)
    for row in rows:
        by_source[row.source].append(row)
    plan = {row.source_size: row for row in found}
    want = {}
    for members in by_source.values():
        own = plan[sum(m.size for m in members)]
        rest = max(own.target - own.epochs * own.source_size, 0)
        before = 0
        for m in sorted(members, key=lambda m: (m.e, m.id, m.size)):
            want[m.id] = own.epochs + (before + m.size / 2 <= rest)
            before += m.size
    assert {row.id: row.times for row in found} == want
    taken = defaultdict(int)
    for row in found:
        assert 0 <= row.times <= 3
        taken[row.source_size, row.target] += row.size * row.times
    for (_, target), words in taken.items():
        assert abs(words - target) <= 20


def test_good_documents_are_taken_first(make_docs):
    docs = make_docs([(n, "plain words here and more " * 4 if n % 2 else "pl#ain w$ords h%ere a&nd m|ore " * 4, "one" if n < 2000 else "two")
                      for n in range(2200)])
    found, _ = mixed(docs, weights=(1, 9))
    times = defaultdict(int)
    for row in found:
        if row.id < 2000:
            times[row.id % 2] += row.times
    assert times[1] > 1.5 * times[0]


def test_odd_rows_and_reruns(odd_docs):
    first, _ = mixed(odd_docs)
    again, _ = mixed(odd_docs.repartition(3, F.rand(5)))
    shape = lambda rows: sorted((row.id or 0, row.size, row.times) for row in rows)
    assert shape(first) == shape(again) and len(first) == odd_docs.count()
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(row.times for row in first)
    assert mixing.mixed_documents(odd_docs.filter("false")).count() == 0
