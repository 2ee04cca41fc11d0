"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k from the Poisson distribution whose mean is the target repetition rate of
the source (target rows of the source / its rows).  k comes from inverting the distribution at a uniform number that
is a hash of seed and document, so a rerun, a retry or another partitioning draws the same; then every document is exploded
by its count and the copies are dealt to partitions, and ordered in them, by a second hash.

Only DataFrame functions run.  The table of sources (one row each) is joined by the size-checked choice of the optimizer; a
source with a third of all rows is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import partitions
from gapwise.scale import durable

#: exponent of the default target: weight of a source = rows ** ALPHA (1 keeps the mix, 0 makes all sources equal)
ALPHA = 0.5
SEED = "mix-1"
#: 52 bits of a digest make a uniform number
DIGITS, SCALE = 13, 2.0**52


def uniform(*parts: Column | str) -> Column:
    """Number in [0, 1) from the digest of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE)


def poisson_table(rate: Column) -> Column:
    """Array of P(count <= k), k = 0, 1, ..., as far as it can matter for 52-bit numbers."""
    last = F.ceil(rate + 9 * F.sqrt(rate) + 30).cast("int")
    # log of each probability, so that large rates don't underflow
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"),
        (acc["sum"] + F.exp(acc["log"] + F.log(rate) - F.log(k.cast("double")))).alias("sum"),
        F.concat(acc["all"], F.array(acc["sum"] + F.exp(acc["log"] + F.log(rate) - F.log(k.cast("double"))))).alias("all"),
    )
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """One row per source: ``source``, ``rows``, ``rate`` (mean number of copies of a document).

    ``weights`` maps sources to relative target weights, sources not named get 0; without it rows ** ``alpha``.  ``total``
    is the number of rows aimed at, as many as there are without it.  A null source is a source like any other, named
    by ``None`` in ``weights``.  If no weight is positive, all rates are 0.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.coalesce(
            *[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0)
        )
    counts = counts.withColumn("weight", weight)
    all_of = counts.agg(F.struct(F.sum("weight").alias("weight"), F.sum("rows").alias("rows"))).scalar()
    aim = F.lit(float(total)) if total is not None else all_of["rows"].cast("double")
    rate = F.when(all_of["weight"] > 0, F.col("weight") / all_of["weight"] * aim / F.col("rows")).otherwise(F.lit(0.0))
    return counts.select("source", "rows", rate.alias("rate"))


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None,
    alpha: float = ALPHA, total: int | None = None, seed: str = SEED, copy_col: str = "copy",
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as drawn, with the number of the copy (from 1), in random order.

    Rows that are equal in id draw the same count.  A row with a null id draws by its text.  Rows of a source with weight 0 go.
    An empty table gives an empty result.  If ``docs`` has a column called ``copy_col`` it keeps its own and gets no number.
    """
    names = docs.columns
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    packed = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("from"), key.alias("key"))
    table = rates(docs, source_col, weights, alpha, total)
    # written, so that its true size decides how it is joined, and the large side isn't shuffled for a few sources
    table = durable(table.where("rate > 0").select("source", poisson_table(F.col("rate")).alias("upto")))
    drawn = packed.join(table, packed["from"].eqNullSafe(table["source"]))
    count = F.size(F.filter("upto", lambda p: p <= F.col("drawn")))
    drawn = drawn.withColumn("drawn", uniform(seed, F.col("key"))).select("row", "key", count.alias("count"))
    copies = drawn.where("count > 0").select("row", "key", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), "key", "copy")
    copies = copies.withColumn("place", place).repartition(partitions(docs.sparkSession), "place").sortWithinPartitions("place")
    return copies.select("row.*", *([] if copy_col in names else [F.col("copy").alias(copy_col)]))


def mix_sql(alpha: float = ALPHA, seed: str = SEED) -> str:
    """The same in SQL over ``documents``."""
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
r AS (SELECT source, pow(rows::DOUBLE, {alpha}) / (SELECT sum(pow(rows::DOUBLE, {alpha})) FROM n) * (SELECT sum(rows)::DOUBLE FROM n) / rows AS rate FROM n),
p AS (SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS upto FROM r
  UNION ALL SELECT source, rate, k + 1, lg + ln(rate) - ln((k + 1)::DOUBLE), upto + exp(lg + ln(rate) - ln((k + 1)::DOUBLE))
  FROM p WHERE k < ceil(rate + 9 * sqrt(rate) + 30)),
t AS (SELECT source, list(upto ORDER BY k) AS upto FROM p GROUP BY source),
d AS (SELECT documents.*, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, {DIGITS}))::BIGINT::DOUBLE / {SCALE} AS u FROM documents),
c AS (SELECT d.*, len(list_filter(t.upto, lambda x: x <= d.u)) AS n_copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM c
"""
