import numpy as np
import pytest
import xxhash

from aerolith.llm import simhash
from aerolith.sources.writers import settle


def by_definition(text):
    """The contract, bit by bit."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[n:n + 3]) for n in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def least_reachable(fps, ids, radius=3):
    fps = np.array(fps, np.int64).view(np.uint64)
    parent = list(range(len(fps)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n in range(len(fps)):
        for other in np.flatnonzero(np.bitwise_count(fps[n + 1:] ^ fps[n]) <= radius) + n + 1:
            parent[root(other)] = root(n)
    least = {}
    for n, one in enumerate(ids):
        least[root(n)] = min(least.get(root(n), one), one)
    return [least[root(n)] for n in range(len(fps))]


def clustered(n, centres, flips, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps = fps ^ np.where(rng.random(n) < 0.8, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return fps.view(np.int64)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "a b c", "É é A\xa0b c\x0bd e", "x " * 70_000])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint_of(text) == by_definition(text)


@pytest.mark.parametrize("n, centres, flips, cap, blocks", [
    (300, 3, 2, simhash.CAP, None), (700, 1, 5, simhash.CAP, None), (700, 2, 4, 60, None), (400, 2, 4, 50, 6), (300, 80, 4, simhash.CAP, 5)])
def test_components_by_brute_force(spark, n, centres, flips, cap, blocks):
    fps = clustered(n, centres, flips, n + flips)
    marked = settle(spark.createDataFrame([(k, int(fp)) for k, fp in enumerate(fps)], "id long, fp long"), "test")
    labels = simhash.label_fingerprints(marked, 3, cap, blocks).select("fp", "component_id")
    found = marked.join(labels, "fp").orderBy("id").select("component_id").collect()
    assert [row[0] for row in found] == least_reachable(fps, list(range(n)))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_groups_of_any_size_and_radius(radius):
    for seed, n in enumerate((2, 63, 64, 65, 130, 400)):
        fps = np.unique(clustered(n, 2, 4, seed)).view(np.uint64)
        want = least_reachable(fps.view(np.int64), list(range(len(fps))), radius)
        made = [simhash.link_large(fps, radius)]
        if len(fps) <= 64:
            made.append(simhash.link_small(fps, np.array([0]), np.array([len(fps)]), radius))
        for a, b in made:
            place = {fp: k for k, fp in enumerate(fps.tolist())}
            linked = list(range(len(fps)))
            for x, y in zip(a.tolist(), b.tolist()):
                linked[place[x]] = place[y]
            assert linked == want


def test_chains_of_links_are_one_component(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {row.node: row.root for row in simhash.components(edges).collect()}
    assert found == {n: 0 for n in range(1, 61)} | {101: 100}


def test_odd_rows(odd_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    component = {}
    for row in found:
        component.setdefault(row.doc_id, set()).add(row.component_id)
    assert component[1] == {1} and component[3] == component[4] == component[5] == {3}
    assert component[None] == {1, 3}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted({row.component_id for row in found})
    assert simhash.near_duplicates(odd_docs.filter("false")).count() == 0 == simhash.keep_one(odd_docs.filter("false")).count()


def test_documents_without_an_id(make_docs):
    docs = make_docs([(None, "a b c d e", "s"), (None, "a b c d e", "s"), (None, "v w x y z", "s")])
    assert [row.component_id for row in simhash.near_duplicates(docs).collect()] == [None] * 3
    assert sorted(row.text for row in simhash.keep_one(docs).collect()) == ["a b c d e", "v w x y z"]
