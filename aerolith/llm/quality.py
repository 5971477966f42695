"""Quality rules, judged together with the host a document comes from.

Every document is measured once.  Rule failures are counted by host, and the rate of
each rule is shrunk towards the corpus by a beta prior fitted to the hosts themselves,
so that a host of three documents cannot be condemned by one of them.  Verdicts on
hosts then go back to the documents:

* a document that breaks a base rule is rejected on any host;
* a host whose shrunk rate of a rule is above ``tolerance`` breaks it regularly: there
  the rule is enforced, elsewhere a lone failure is forgiven;
* a host whose shrunk rate of documents that fail anything is above ``drop_rate`` is
  rejected whole.

A document that fails no rule is thus only lost with its whole host.

Null text counts as empty (no words, so it breaks the base rule).  A null host is a
host of its own.  Repeated rows are counted and returned as often as they occur.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import SPACES, longs, pack, unpack
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        earlier = first.setdefault(window, at)
        if earlier != at:
            covered[at:at + 3] = covered[earlier:earlier + 3] = b"\1\1\1"
    return covered.count(1)


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(longs(*MEASURES))
def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure_text(text) for text in texts], columns=MEASURES)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 10
    max_dup_lines_percent: int = 30
    word_length: tuple[int, int] = (3, 10)
    tolerance: float = 0.01
    drop_rate: float = 0.9
    #: Strength of the prior, in documents.
    strength: tuple[float, float] = (2.0, 10_000.0)

    def base(self, m: Column) -> dict[str, Column]:
        return {
            "short": m["n_words"] < self.min_words,
            "repeats": 100 * m["n_repeat_words"] > self.max_repeat_percent * m["n_words"],
        }

    def soft(self, m: Column) -> dict[str, Column]:
        low, high = self.word_length
        return {
            "symbols": 100 * m["n_symbols"] > self.max_symbols_percent * m["n_words"],
            "dup_lines": 100 * m["n_dup_lines"] > self.max_dup_lines_percent * m["n_lines"],
            "word_length": (m["word_chars"] < low * m["n_words"]) | (m["word_chars"] > high * m["n_words"]),
        }


def measure(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``row``, ``host`` and the struct ``m`` of measures."""
    return pack(docs, host=F.col(host), m=_measured(F.col(text)))


def host_rates(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per host: its documents, and the shrunk rate of each soft rule and of any failure.

    The prior of a rate is a beta whose mean is the corpus rate and whose strength
    follows from how much more the hosts' rates vary than chance would make them.
    """
    m = F.col("m")
    soft = rules.soft(m)
    failed = soft | {"any": _any(list(rules.base(m).values()) + list(soft.values()))}
    hosts = settle(
        measured.groupBy("host").agg(
            F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in failed.items()]
        ), "hosts",
    )
    total = hosts.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), *[F.sum(name).alias(name) for name in failed],
        *[F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_square") for name in failed],
    ).first()
    return hosts.select("host", "n", *[
        ((F.col(name) + a) / (F.col("n") + a + b)).alias(name)
        for name, (a, b) in ((name, beta_prior(total, name, rules)) for name in failed)
    ])


def beta_prior(total, rule: str, rules: Rules) -> tuple[float, float]:
    n = total["n"] or 0
    if not n:
        return 1.0, 1.0
    mean = total[rule] / n
    chance = mean * (1 - mean)
    between = total[f"{rule}_square"] / n - mean * mean - chance * total["hosts"] / n
    low, high = rules.strength
    strength = min(max(chance / between - 1, low), high) if between > 0 else high
    return mean * strength, (1 - mean) * strength


def _any(columns: list[Column]) -> Column:
    found = columns[0]
    for column in columns[1:]:
        found = found | column
    return found


def judge(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``.

    ``measured`` is read twice: give a stored table.  The table of hosts is stored as
    well, so that Spark chooses the join by its real size.
    """
    m = F.col("m")
    soft = rules.soft(m)
    hosts = settle(host_rates(measured, rules).select(
        F.col("host").alias("of"), F.struct(*soft, "any").alias("rate")), "host-rates")
    rate = F.col("rate")
    base_failed = _any(list(rules.base(m).values()))
    enforced = _any([failed & (rate[name] > rules.tolerance) for name, failed in soft.items()])
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("of"))).select(
        *measured.columns, rate.alias("host_rate"), base_failed.alias("base_failed"),
        (~base_failed & ~enforced & (rate["any"] <= rules.drop_rate)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return unpack(judge(settle(measure(docs), "measured"), rules).filter("kept"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
v AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM p),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM v),
n AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n ON w.r = n.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words AS f1, 100 * n_dup_lines > 30 * n_lines AS f2,
    word_chars < 3 * n_words OR word_chars > 10 * n_words AS f3 FROM m),
l AS (SELECT r, source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, base_failed OR f1 OR f2 OR f3]) AS f FROM b),
h AS (SELECT source, k, count(*)::DOUBLE AS n, (count(*) FILTER (f))::DOUBLE AS x FROM l GROUP BY ALL),
t AS (SELECT k, sum(n) AS n, count(*) AS hosts, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) AS sq FROM h GROUP BY k),
g AS (SELECT k, mean, sq - mean * mean - mean * (1 - mean) * hosts / n AS between FROM t),
q AS (SELECT k, mean, CASE WHEN between > 0 THEN least(greatest(mean * (1 - mean) / between - 1, 2), 10000) ELSE 10000 END AS s FROM g),
e AS (SELECT source, k, (x + mean * s) / (n + s) AS rate FROM h JOIN q USING (k)),
o AS (SELECT source, max(rate) FILTER (k = 1) AS r1, max(rate) FILTER (k = 2) AS r2, max(rate) FILTER (k = 3) AS r3,
    max(rate) FILTER (k = 4) AS r4 FROM e GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (f1 AND r1 > 0.01 OR f2 AND r2 > 0.01 OR f3 AND r3 > 0.01) AND r4 <= 0.9 AS kept
FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source
"""


@query("op1_quality_rules", _SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = settle(measure(docs).select(F.struct("row.doc_id").alias("row"), "host", "m"), "measures")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(measured).select("row.doc_id", *[f"m.{name}" for name in shown], "base_failed", "kept")
