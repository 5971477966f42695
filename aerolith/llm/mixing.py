"""Mixing sources to target weights, by weighted sampling without replacement.

Each source gets a target in words: its share by weight of all words, but not more than
``max_epochs`` times what it has; what is cut off is shared again by weight among the
others until none is above.  A source is first taken whole as often as its target allows.
The rest of the target is filled by Efraimidis-Spirakis sampling: every document draws a
uniform u, and documents are taken in the order of -ln(u) / quality until their words
reach the rest.  The document at the border is taken if more than half of it lies inside.

u comes from a hash of the document, so reruns agree.  The order is never made whole:
keys are mapped to [0, 1) and cut into ``BUCKETS`` equal buckets, words are summed by
bucket (with map-side sums), and only the documents of the bucket at the border go on to
the next of ``LEVELS`` cuts.  At the end each source has a border bucket of
1/BUCKETS^LEVELS of the key range, and a window orders that alone.  A source with a third
of all rows is therefore never in one task.

Null text has no words.  A null source is a source of its own and the last in order.
Repeated rows draw the same key and are taken one after the other.  Documents without
words are taken with their source's whole epochs.  An empty table gives an empty mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.common import WORD, pack, unpack
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

BUCKETS, LEVELS = 4096, 2
MAX_EPOCHS = 3
SEED = "mix-1"
#: Weights of the sources in order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """From 1 for plain prose down to 1/8 for text with a symbol in every word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, 1 / (1 + 7 * F.least(symbols / size, F.lit(1.0)))).otherwise(1.0)


def uniform(*parts: Column) -> Column:
    """A repeatable uniform number inside (0, 1), from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(part.cast("string"), F.lit("-")) for part in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` and what the mix needs of it: ``id``, ``source``, ``size`` and the sampling key ``e``.

    The digest of the text tells rows of equal id apart.
    """
    rows = pack(docs, id=F.col(doc_id), source=F.col(source), size=word_count(F.col(text)), text=F.col(text))
    e = -F.log(uniform(F.col("id"), F.md5("text"))) / quality_weight(F.col("text"), F.col("size"))
    return rows.select("row", "id", "source", "size", e.alias("e"))


def ranked_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources with their size, weighted by their place in code point order, null last.

    One task orders the sources: a row each.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return sizes.select("source", "source_size", chosen.alias("weight"))


def targets(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size`` and ``target``; ``weighted`` (also with ``weight``) is read once per round.

    A round shares what the capped sources leave by weight and caps those above their
    limit.  It ends when a round caps no further source, after one or two rounds as a rule.
    """
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * float(max_epochs)
    level = 0.0  # words a unit of weight is worth
    while True:
        capped = limit <= F.col("weight") * level
        free = weighted.agg(
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.sum(F.when(capped, limit)).alias("capped")).first()
        if not free["weight"]:
            break
        higher = (total - (free["capped"] or 0.0)) / free["weight"]
        if higher <= level:
            break
        level = higher
    return weighted.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def _bucket(level: int) -> Column:
    """Digits of the key in [0, 1) that grows with ``e``, to the base ``BUCKETS``."""
    scaled = (1 - F.exp(-F.col("e"))) * float(BUCKETS**level)
    return F.least(F.floor(scaled).cast("long"), F.lit(BUCKETS**level - 1))


def sample(rows: DataFrame, rest: DataFrame, extra: list[str]) -> DataFrame:
    """Rows (``group``, ``size``, ``e``, ``tie``, ``extra``) with ``chosen``, filling ``rest`` words in each group.

    ``rows`` is read once per level: give a stored table.
    """
    left, done = rest, []
    open_rows = rows
    for level in range(1, LEVELS + 1):
        keyed = open_rows.withColumn("b", _bucket(level))
        sums = keyed.groupBy("group", "b").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("group").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = F.col("before") + F.col("n") <= F.col("rest")
        marked = sums.join(left, "group").filter(~inside & (F.col("before") <= F.col("rest")))
        border = settle(marked.groupBy("group").agg(F.min(F.struct("b", "before", "rest")).alias("m")).select(
            "group", F.col("m.b").alias("border"), (F.col("m.rest") - F.col("m.before")).alias("rest")), "mix-border")
        placed = keyed.join(border.select("group", "border"), "group", "left")
        # A group without a border fits whole.
        done.append(placed.filter("border IS NULL OR b <> border").select(
            "group", *extra, F.coalesce(F.col("b") < F.col("border"), F.lit(True)).alias("chosen")))
        open_rows = placed.filter("b = border").drop("b", "border")
        left = border.select("group", "rest")
    upto = Window.partitionBy("group").orderBy("e", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = open_rows.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(left, "group")
    done.append(last.select("group", *extra, (F.col("before") + F.col("size") / 2 <= F.col("rest")).alias("chosen")))
    return reduce(DataFrame.unionByName, done)


def mix(stored: DataFrame, extra: list[str], max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Stored ``sized`` rows with ``source_size``, ``target``, ``epochs`` and ``times``, how often each is taken."""
    sizes = settle(stored.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    shares = targets(settle(ranked_weights(sizes, weights), "source-weights"), max_epochs)
    # An epoch short of the target by rounding alone is complete.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = settle(shares.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).withColumn(
        "group", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())), "mix-plan")
    rows = stored.withColumn("group", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).withColumnRenamed("id", "tie")
    chosen = sample(rows, plan.select("group", "rest"), ["tie", "size", *extra])
    return chosen.join(plan.select("group", "source_size", "target", "epochs"), "group").select(
        F.col("tie").alias("id"), "size", *extra, "source_size", "target", "epochs",
        (F.col("epochs") + F.col("chosen").cast("long")).alias("times"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them, with their columns."""
    taken = mix(settle(sized(docs), "mix-rows"), ["row"]).filter("times > 0")
    return unpack(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")))


_SQL = r"""
WITH s AS (SELECT doc_id, source, text,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, '-'),
        coalesce(md5(text), '-'))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN text IS NULL OR size = 0 THEN 1.0
        ELSE 1 / (1 + 7 * least((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / size, 1.0)) END AS e FROM s),
z AS (SELECT source, sum(size)::DOUBLE AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM z),
o AS (SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
v AS (SELECT max((total - capped) / free) FILTER ((total - capped) / free <= ratio) AS level FROM o),
t AS (SELECT source, source_size, least(3 * source_size, weight * level) AS target FROM w, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, greatest(target - epochs * source_size, 0) AS rest FROM p),
c AS (SELECT k.*, r.source_size, r.target, r.epochs, r.rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    (size * (epochs + (before + size / 2 <= rest)::INT))::BIGINT AS taken FROM c
"""


@query("op6_source_mix", _SQL)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = settle(sized(docs).drop("row"), "mix-rows")
    return mix(rows, []).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
