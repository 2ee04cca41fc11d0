"""Phrase collocations by relational mining of sorted occurrence relations (SETM).

The words of all texts are a relation (bucket, pos, word).  Positions run on through the texts of a bucket and are left out
between two pieces and two texts, so adjacent positions lie in one piece.  It is written to a bucketed table in the order of
positions.  Occurrences of the next length come from a merge join of the relation with itself on adjacent positions, are counted
by group, and only occurrences of frequent groups are written for the length after.  Buckets hold whole texts, so joins on
(bucket, pos) move nothing.  What is shuffled are distinct groups per bucket with their counts: by group to add the counts up, where a group has
at most one row a bucket however often it occurs, and the frequent ones back to their buckets for the semi-join.

Everything is per language, as words are: the id of a frequent word belongs to a language and a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwise.llm.common import partitions
from gapwise.scale import durable

LEAST = 10
TOP = 2000
SHARE = 50  # per cent of a phrase's occurrences inside one longer phrase that drop it
MILLION = 1_000_000

PIECES = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the same ends of pieces one by one
ENDS = ".,;:!?\n\x0b\x0c\r"


#: joins whose sides are bucketed by one of their keys run bucket by bucket; a task writes its one bucket without sorting
LOCAL = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "4"}


@contextmanager
def _local_work(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in LOCAL}
    for name, value in LOCAL.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _bucket_names(spark: SparkSession, buckets: int) -> Column:
    """A number for each bucket that Spark's hash sends to a partition of its own, as an array."""
    names = spark.range(40 * buckets + 1000).select(F.col("id").cast("int").alias("name"))
    names = names.groupBy(F.pmod(F.hash("name"), F.lit(buckets)).alias("at")).agg(F.min("name").alias("name"))
    return F.array(*[F.lit(r["name"]) for r in sorted(names.collect())])


class _Relations:
    """Bucketed tables of the warehouse, dropped when what depends on them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.names = spark, partitions(spark), []

    def write(self, df: DataFrame) -> DataFrame:
        """Write a relation that lies in hash partitions of ``bucket``; every task writes the one file of its bucket."""
        self.names.append(f"gapwise_{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").bucketBy(self.buckets, "bucket").format("parquet").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def drop(self) -> None:
        while self.names:
            self.spark.sql(f"DROP TABLE {self.names.pop()}")


def _strips(docs: DataFrame, buckets: int) -> list[tuple[str, float, float]]:
    """Languages that fill a bucket or more, each with its share of the buckets: language, begin, width.

    They are at most as many as there are buckets.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    sizes = durable(docs.groupBy(lang).agg(F.sum(F.octet_length("text")).alias("size")).where("size > 0"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    found = sorted(sizes.where(F.col("size") * buckets >= total).collect(), key=lambda r: r["lang"])
    whole, out, before = sum(r["size"] for r in found), [], 0
    for r in found:
        out.append((r["lang"], before / whole, r["size"] / whole))
        before += r["size"]
    return out


def _texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Lower-cased texts by bucket, a line feed between spaces for the end of a piece.

    Texts of a large language lie in neighbouring buckets, so that a phrase is counted in few of them; all buckets get
    the same length of text.  ``start`` is the place of a text in its bucket: texts take more places there than they have words and ends of pieces.
    """
    plain = LOWER + "\n" * len(ENDS) + " "
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.replace(F.translate(F.coalesce("text", F.lit("")), UPPER + ENDS + "\t", plain), F.lit("\n"), F.lit(" \n ")).alias("text"),
    ).withColumn("row", F.monotonically_increasing_id())
    strips = docs.sparkSession.createDataFrame(_strips(docs, buckets), "lang string, begin double, width double")
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 32)) / (1 << 32)
    at = F.floor((F.coalesce("begin", F.lit(0.0)) + F.coalesce("width", F.lit(1.0)) * drawn) * buckets)
    bucket = F.element_at(_bucket_names(docs.sparkSession, buckets), F.least(at, F.lit(buckets - 1)).cast("int") + 1)
    rows = rows.where("text <> ''").join(F.broadcast(strips), "lang", "left").withColumn("bucket", bucket).repartition(buckets, "bucket")
    places = F.length("text").cast("long") + 2
    before = F.sum(places).over(Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("bucket", F.coalesce(before, F.lit(0)).alias("start"), "lang", "text")


def _occurrences(texts: DataFrame) -> DataFrame:
    """One row per word; a line feed stands for the end of a piece, is numbered and left out."""
    words = F.array_remove(F.split("text", " "), "")
    each = texts.select("bucket", "start", "lang", F.posexplode(words).alias("nth", "word"))
    return each.where("word <> '\n'").select("bucket", (F.col("start") + F.col("nth")).alias("pos"), "lang", "word")


def _frequent(local: DataFrame, group: list[str], least: int) -> DataFrame:
    """Frequent groups of ``local`` (bucket, group, n): one row per bucket that has them, with the total ``f``."""
    total = F.sum("n").over(Window.partitionBy(*group))
    return local.withColumn("f", total).where(F.col("f") >= least)


def _numbered(local: DataFrame, least: int) -> DataFrame:
    """Rows of frequent words with ``id``, numbered from 0 over all languages.

    Words are numbered within parts by hash, whose sizes give the first number of each part.
    """
    spark = local.sparkSession
    parts = partitions(spark)
    by = F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int")
    total = local.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("part", by)
    total = durable(total.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))))
    sizes = total.groupBy("part").agg(F.max("no").alias("size"))
    first = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("first"))
    total = total.join(first, "part").select("lang", "word", "f", (F.col("first") + F.col("no") - 1).alias("id"))
    return local.join(total.hint("shuffle_hash"), ["lang", "word"])


def _adjacent(left: DataFrame, right: DataFrame, columns: list[Column]) -> DataFrame:
    """Merge join of two occurrence relations on adjacent positions."""
    a, b = left.alias("a"), right.alias("b").hint("merge")
    same = (F.col("a.pos") + 1 == F.col("b.pos")) & (F.col("a.bucket") == F.col("b.bucket"))
    return a.join(b, same).select("a.bucket", "a.pos", *columns)


def _first(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def _second(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of two and three words of every language: lang, rank, phrase, a, l, r, n, score.

    Null texts have no words, a null language is ``und``.  Repeated rows count each.  Ties go by score, occurrences and the
    bytes of the phrase, so ranks are unique.  A table without a phrase of ``least`` occurrences gives an empty table.  More
    than 2^31 frequent words are refused.  Only ``lang`` and ``text`` are read.
    """
    spark = docs.sparkSession
    kept = _Relations(spark)
    with _local_work(spark):
        texts = kept.write(_texts(docs, kept.buckets))
        local = durable(_occurrences(texts).groupBy("bucket", "lang", "word").agg(F.count("*").alias("n")))
        sizes = local.groupBy("lang").agg(F.sum("n").alias("n"))
        words = durable(_numbered(local, least))
        if (words.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
            raise ValueError("more frequent words than 31 bits can number")
        known = words.select("bucket", "lang", "word", "id").hint("shuffle_hash")
        found = _occurrences(texts).join(known, ["bucket", "lang", "word"]).withColumn("id", F.col("id").cast("int"))
        earlier, kept = kept, _Relations(spark)
        one = kept.write(found.select("bucket", "pos", "id"))
        earlier.drop()
        pair = F.shiftleft(F.col("a.id").cast("long"), 32).bitwiseOR(F.col("b.id").cast("long")).alias("pair")
        two = _adjacent(one, one, [pair])
        pairs = durable(_frequent(two.groupBy("bucket", "pair").agg(F.count("*").alias("n")), ["pair"], least))
        two = two.join(pairs.select("bucket", "pair").hint("shuffle_hash"), ["bucket", "pair"], "left_semi")
        earlier, kept = kept, _Relations(spark)
        two = kept.write(two.select("bucket", "pos", "pair"))
        earlier.drop()
        three = _adjacent(two, two, [F.col("a.pair").alias("pair"), _second(F.col("b.pair")).alias("id")])
        triples = durable(_frequent(three.groupBy("bucket", "pair", "id").agg(F.count("*").alias("n")), ["pair", "id"], least))
        kept.drop()

    def groups(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.max("f").alias("f"))

    return _report(groups(words, "id", "lang", "word"), groups(pairs, "pair"), groups(triples, "pair", "id"), sizes, top)


def _with(df: DataFrame, table: DataFrame, key: Column, columns: dict[str, str]) -> DataFrame:
    """Add ``columns`` (name in ``table``: new name) of the row of ``table`` whose first column is ``key``."""
    own = table.select(F.col(table.columns[0]).alias("_k"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.withColumn("_key", key).join(own, F.col("_key") == F.col("_k")).drop("_key", "_k")


def _scored(df: DataFrame, name: str, left: str, right: str) -> DataFrame:
    """Add the exact whole part of 1000000 a^2 / (left right), in decimals of 38 digits."""

    def product(*factors: str) -> str:
        out = f"CAST({factors[0]} AS DECIMAL(38,0))"
        for f in factors[1:]:
            out = f"CAST({out} * CAST({f} AS DECIMAL(38,0)) AS DECIMAL(38,0))"
        return out

    return df.withColumn(name, F.expr(f"{product('a', 'a', str(MILLION))} div {product(left, right)}"))


def _report(words: DataFrame, pairs: DataFrame, triples: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    pairs, triples, words = durable(pairs), durable(triples), durable(words)
    first, second, pair = _first(F.col("pair")), _second(F.col("pair")), F.col("pair")
    # a longer phrase drops the phrases of its first and of its last words
    tail = F.shiftleft(second, 32).bitwiseOR(F.col("id"))
    longer = triples.select(F.explode(F.array(pair, tail)).alias("part"), "f").groupBy("part").agg(F.max("f").alias("inside"))
    two = pairs.withColumnRenamed("f", "a").join(longer, pair == F.col("part"), "left").drop("part")
    two = two.where(F.col("inside").isNull() | (100 * F.col("inside") < SHARE * F.col("a"))).drop("inside")
    two = _with(_with(two, words, first, {"lang": "lang", "f": "l"}), words, second, {"f": "r"})
    two = _scored(two, "score", "l", "r").select("lang", "pair", F.lit(None).cast("long").alias("id"), "a", "l", "r", "score")
    three = triples.withColumnRenamed("f", "a")
    three = _with(_with(three, words, first, {"lang": "lang", "f": "l1"}), pairs, tail, {"f": "r1"})
    three = _with(_with(three, pairs, pair, {"f": "l2"}), words, F.col("id"), {"f": "r2"})
    three = _scored(_scored(three, "s1", "l1", "r1"), "s2", "l2", "r2")
    early = F.col("s1") <= F.col("s2")
    cut = [F.when(early, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))]
    every = two.unionByName(three.select("lang", "pair", "id", "a", *cut))
    order = [F.desc("score"), F.desc("a")]
    place = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    # ties at the last place stay until their phrases are known
    every = durable(every.withColumn("place", place).where(F.col("place") <= top).drop("place"))
    names = {"word": "w1"}
    every = _with(_with(every, words, first, names), words, second, {"word": "w2"})
    third = words.select(F.col("id").alias("_k"), F.col("word").alias("w3"))
    every = every.join(third, F.col("id") == F.col("_k"), "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    found = every.withColumn("rank", rank).where(F.col("rank") <= top).join(sizes, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = LEAST, top: int = TOP) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{PIECES}') AS ps FROM documents WHERE text IS NOT NULL),
 p AS (SELECT row, lang, ps, unnest(range(1, len(ps) + 1)) AS pi FROM d),
 v AS (SELECT row, lang, pi, [x FOR x IN regexp_split_to_array(ps[pi], '[ \t]+') IF x <> ''] AS ws FROM p),
 u AS (SELECT row, lang, pi, ws, unnest(range(1, len(ws) + 1)) AS wi FROM v),
 w AS (SELECT lang, ws[wi] AS w1, ws[wi + 1] AS w2, ws[wi + 2] AS w3 FROM u),
 n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
 f1 AS (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
 f2 AS (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
 f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
 parts AS (SELECT lang, w1, w2, max(f) AS inside FROM
   (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
 c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r FROM f2
   JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
   LEFT JOIN parts ON parts.lang = f2.lang AND parts.w1 = f2.w1 AND parts.w2 = f2.w2
   WHERE parts.inside IS NULL OR 100 * parts.inside < {SHARE} * f2.f),
 c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, g.f AS r1, h.f AS l2, y.f AS r2,
     (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * g.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (h.f::HUGEINT * y.f) AS s2
   FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
   JOIN f2 g ON g.lang = f3.lang AND g.w1 = f3.w2 AND g.w2 = f3.w3 JOIN f2 h ON h.lang = f3.lang AND h.w1 = f3.w1 AND h.w2 = f3.w2),
 c AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c2
   UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c) JOIN n USING (lang) WHERE rank <= {top}"""
