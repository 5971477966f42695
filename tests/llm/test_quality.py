import random

from aerolith.llm import quality
from aerolith.sources.writers import settle


def plain_repeats(words):
    """By definition: positions in windows that occur twice."""
    windows = [tuple(words[n:n + 3]) for n in range(len(words) - 2)]
    return len({n + k for n, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_repeated_words_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice(b"abc") for _ in range(rng.randint(0, 14))]
        assert quality.repeated_words(words) == plain_repeats(words)


def test_measures_of_one_text():
    assert quality.measure_text("a b\x0bc\n\n a#$ \nx\nx\n \nx") == (7, 9, 2, 5, 2, 0)
    assert quality.measure_text("no break\xa0here") == (2, 12, 0, 1, 0, 0)
    assert quality.measure_text(None) == quality.measure_text("") == (0,) * 6


def test_odd_rows_keep_their_columns(odd_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    found = sorted((row.doc_id or 0, row.source or "") for row in kept.collect())
    assert found == [(0, "b"), (1, "a"), (1, "a"), (2, ""), (6, "c")]
    assert {row.n_words for row in kept.collect()} == {"x"}


def test_empty_table(odd_docs):
    assert quality.keep_good(odd_docs.filter("false")).count() == 0


def test_hosts_decide_on_lone_failures(make_docs):
    prose = " ".join(f"word{n}" for n in range(80))
    noisy = " ".join(f"word{n}#$" for n in range(80))
    rows = [(n, prose, "clean") for n in range(400)] + [(1000, noisy, "clean")]
    rows += [(2000 + n, noisy if n % 4 == 0 else prose, "noisy") for n in range(200)]
    rows += [(3000 + n, noisy, "junk") for n in range(99)] + [(3999, prose, "junk")]
    judged = quality.judge(settle(quality.measure(make_docs(rows)), "test"))
    kept = {row.doc_id for row in judged.filter("kept").select("row.doc_id").collect()}
    assert 1000 in kept  # a lone failure on a clean host is forgiven
    assert kept >= set(range(400)) | {2001, 2002, 2003}
    assert not kept & {2000, 2004, 3000}
    assert 3999 not in kept  # a host that nearly always fails goes whole


def test_a_small_host_is_drawn_to_the_corpus(make_docs):
    prose = " ".join(f"word{n}" for n in range(80))
    noisy = " ".join(f"word{n}#$" for n in range(80))
    rows = [(10 * h + n, prose, f"h{h}") for h in range(60) for n in range(10)] + [(5000, noisy, "tiny")]
    rates = {row.host: row["any"] for row in quality.host_rates(settle(quality.measure(make_docs(rows)), "test")).collect()}
    assert rates["tiny"] < 0.9 and rates["h0"] < 0.01
