"""URLs accepted or rejected by rules, and beyond the rules by two character models.

Rules name a host and the start of a path; the longest that fits decides.  The URLs they
decide are the training data of two variable-order Markov models of characters, one of
accepted and one of rejected URLs.  Each model mixes its orders from 0 to 3 by
Witten-Bell smoothing.  A URL's score is the mean over its characters of the difference of
the models' log-likelihoods; it is accepted at or above a threshold.  The threshold is
calibrated on held-out scores: models of either half of the labelled URLs score the other
half, and it lies as many standard deviations below the mean of the accepted as above the
mean of the rejected.

Characters are mapped to 32 symbols, so there are at most 32^4 grams: that bounds the
model (about a million rows of a gram and three numbers), whatever the number of URLs, and
with it what is broadcast.  URLs with the same symbols are counted and scored once.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is
blocked.  Without labelled URLs of both kinds every score is compared with 0, an
untrained model giving 0.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import pack, unpack
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

ORDER = 3
#: Letters, one for all digits, three marks, one for all else, one for start and end.
SYMBOLS = 32
PAD = "^"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


#: Fixed by the contract.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, else a null struct."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.rule)):
        value = F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fits = rule.fits(host, path)
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def symbols(host: Column, path: Column) -> Column:
    """The URL in the models' alphabet."""
    text = F.translate(F.concat(host, path), ascii_uppercase + "123456789", ascii_lowercase + "000000000")
    return F.regexp_replace(text, "[^a-z0./-]", "*")


def grams(text: Column) -> Column:
    """Each symbol with the ``ORDER`` before it, and the end; none for an empty text."""
    signs = F.regexp_extract_all(F.concat(F.lit(PAD * ORDER), text, F.lit(PAD)), F.lit("."), F.lit(0))
    last = F.length(text) + ORDER
    ends = F.when(F.length(text) > 0, F.sequence(F.lit(ORDER), last)).otherwise(F.array().cast("array<int>"))
    # The outer array binds the signs, which would else be cut out anew for every gram.
    bound = F.transform(F.array(signs), lambda s: F.transform(ends, lambda i: F.concat(*[F.get(s, i - back) for back in range(ORDER, -1, -1)])))
    return F.get(bound, F.lit(0))


#: Models: of the first half, of the second half, of all labelled URLs.
_MODELS = (0, 1, 2)
_COUNTS = [f"{kind}{model}" for model in _MODELS for kind in ("a", "r")]


def gram_scores(texts: DataFrame) -> DataFrame:
    """``gram`` and, per model, ``s0`` to ``s2``: the difference of the log-probabilities of its last symbol.

    ``texts`` has ``text``, ``fold`` and the counts ``accepted`` and ``rejected``.  All grams of all texts get a score.
    """
    counted = texts.select("fold", "accepted", "rejected", F.explode(grams(F.col("text"))).alias("gram"))
    totals = []
    for model in _MODELS:
        own = F.lit(True) if model == 2 else F.col("fold") == model
        for kind, column in (("a", "accepted"), ("r", "rejected")):
            totals.append(F.sum(F.when(own, F.col(column)).otherwise(0)).alias(f"{kind}{model}"))
    counts = settle(counted.groupBy("gram").agg(*totals), "url-grams")
    lower = None
    for size in range(1, ORDER + 2):
        ends = F.expr(f"right(gram, {size})").alias("g")
        level = counts.groupBy(ends).agg(*[F.sum(name).alias(name) for name in _COUNTS])
        before = level.groupBy(F.expr(f"left(g, {size - 1})").alias("before")).agg(
            *[F.sum(name).alias(f"n_{name}") for name in _COUNTS], *[F.count_if(F.col(name) > 0).alias(f"t_{name}") for name in _COUNTS])
        joined = level.withColumn("before", F.expr(f"left(g, {size - 1})")).join(before, "before")
        if lower is not None:
            joined = joined.withColumn("shorter", F.expr(f"right(g, {size - 1})")).join(lower, "shorter")
        smoothed = []
        for name in _COUNTS:
            below = F.lit(1.0 / SYMBOLS) if lower is None else F.col(f"p_{name}")
            n, t = F.col(f"n_{name}"), F.col(f"t_{name}")
            smoothed.append(F.when(n > 0, (F.col(name) + t * below) / (n + t)).otherwise(below).alias(f"p_{name}"))
        lower = joined.select(F.col("g").alias("shorter"), *smoothed)
    scores = [(F.log(F.col(f"p_a{model}")) - F.log(F.col(f"p_r{model}"))).alias(f"s{model}") for model in _MODELS]
    return lower.select(F.col("shorter").alias("gram"), *scores)


def threshold(scored: DataFrame) -> float:
    """Calibrated on the held-out scores of the labelled URLs; one row comes to the driver."""
    held_out = F.when(F.col("fold") == 0, F.col("s1")).otherwise(F.col("s0"))
    sums = []
    for kind in ("accepted", "rejected"):
        sums += [F.sum(kind).alias(f"{kind}_n"), F.sum(F.col(kind) * held_out).alias(f"{kind}_x"),
                 F.sum(F.col(kind) * held_out * held_out).alias(f"{kind}_xx")]
    row = scored.agg(*sums).first()
    fitted = []
    for kind in ("accepted", "rejected"):
        n = row[f"{kind}_n"]
        if not n:
            return 0.0
        mean = row[f"{kind}_x"] / n
        fitted.append((mean, max(row[f"{kind}_xx"] / n - mean * mean, 0.0) ** 0.5))
    (high, high_spread), (low, low_spread) = fitted
    spread = high_spread + low_spread
    return (high * low_spread + low * high_spread) / spread if spread > 0 else (high + low) / 2


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``; columns of those names are replaced."""
    parsed = pack(pages, host=host_of(F.col(url)), path=path_of(F.col(url)))
    parsed = parsed.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "text", symbols(F.col("host"), F.col("path")))
    texts = settle(
        parsed.groupBy("text").agg(
            F.count_if(F.col("found.verdict") == "allow").alias("accepted"),
            F.count_if(F.col("found.verdict") == "block").alias("rejected"),
        ).withColumn("fold", F.conv(F.substring(F.md5("text"), 1, 1), 16, 10).cast("int") % 2), "url-texts",
    )
    # At most SYMBOLS ** (ORDER + 1) grams, however many URLs there are.
    model = F.broadcast(settle(gram_scores(texts), "url-model"))
    spread = texts.select("text", F.explode(grams(F.col("text"))).alias("gram"))
    means = spread.join(model, "gram").groupBy("text").agg(*[F.avg(f"s{n}").alias(f"s{n}") for n in _MODELS])
    scored = settle(texts.join(means, "text"), "url-scores")
    limit = threshold(scored)
    # Exactly one row per text: the join adds no rows.
    judged = parsed.join(scored.select("text", F.col("s2").alias("score")), "text", "left")
    by_model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return unpack(
        judged, host=F.col("host"), path=F.col("path"), rule=F.col("found.rule"),
        verdict=F.coalesce(F.col("found.verdict"), by_model), score=F.col("score"))


def _sql() -> str:
    levels = []
    for size in range(1, ORDER + 2):
        below = f"1.0 / {SYMBOLS}" if size == 1 else "{0}p"
        lower = "" if size == 1 else f" JOIN p{size - 1} b ON b.v = l.v AND b.g = right(l.g, {size - 1})"
        p = ", ".join(
            f"CASE WHEN n{k} > 0 THEN (l.{k} + t{k} * {below.format(f'b.{k}')}) / (n{k} + t{k}) ELSE {below.format(f'b.{k}')} END AS {k}p"
            for k in "ar")
        levels.append(f"""l{size} AS (SELECT v, right(gram, {size}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY ALL),
x{size} AS (SELECT v, left(g, {size - 1}) AS h, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr
    FROM l{size} GROUP BY ALL),
p{size} AS (SELECT l.v, l.g, {p} FROM l{size} l JOIN x{size} x ON x.v = l.v AND x.h = left(l.g, {size - 1}){lower})""")
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT *, '.' || host AS dotted, regexp_replace(translate(host || path, '{ascii_uppercase}123456789', '{ascii_lowercase}000000000'),
    '[^a-z0./-]', '*', 'g') AS text FROM u),
d AS (SELECT *, CASE
    WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM f),
e AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM d),
s AS (SELECT text, count(*) FILTER (ruled = 'allow') AS accepted, count(*) FILTER (ruled = 'block') AS rejected,
    ('0x' || md5(text)[1])::INT % 2 AS fold FROM e GROUP BY text),
g AS (SELECT text, accepted, rejected, fold, substr('{PAD * ORDER}' || text || '{PAD}', unnest(range(1, length(text) + 2)), {ORDER + 1}) AS gram
    FROM s WHERE text <> ''),
c AS (SELECT v, gram, sum(CASE WHEN v = 2 OR v = fold THEN accepted ELSE 0 END)::DOUBLE AS a,
    sum(CASE WHEN v = 2 OR v = fold THEN rejected ELSE 0 END)::DOUBLE AS r FROM g, (SELECT unnest([0, 1, 2]) AS v) GROUP BY ALL),
{', '.join(levels)},
m AS (SELECT text, v, any_value(accepted) AS n_a, any_value(rejected) AS n_r, any_value(fold) AS fold, avg(ln(ap) - ln(rp)) AS score
    FROM g JOIN p{ORDER + 1} p ON p.g = g.gram GROUP BY text, v),
h AS (SELECT sum(n_a) AS n_a, sum(n_r) AS n_r, sum(n_a * score) / sum(n_a) AS ma, sum(n_r * score) / sum(n_r) AS mr,
    sqrt(greatest(sum(n_a * score * score) / sum(n_a) - (sum(n_a * score) / sum(n_a)) ** 2, 0)) AS sa,
    sqrt(greatest(sum(n_r * score * score) / sum(n_r) - (sum(n_r * score) / sum(n_r)) ** 2, 0)) AS sr FROM m WHERE v = 1 - fold),
k AS (SELECT CASE WHEN coalesce(n_a, 0) = 0 OR coalesce(n_r, 0) = 0 THEN 0 WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr)
    ELSE (ma + mr) / 2 END AS level FROM h)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN m.score >= level THEN 'allow' ELSE 'block' END) AS verdict
FROM e CROSS JOIN k LEFT JOIN m ON m.text = e.text AND m.v = 2
"""


@query("op4_url_filter", _sql())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
