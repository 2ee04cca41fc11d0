"""Benchmark decontamination: short test items inside long documents by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two of their distinct five-word shingles).  The MinHash of an item under function i is
its shingle of least hash; it occurs in a document with a chance equal to the containment of the item, however long the
document is.  (The document's own minima would tell its Jaccard similarity, next to nothing for a short item.)  So the
min-hash shingles of all items form the index, every shingle of every document is looked up in it once, and a document is a
candidate for an item if it holds as many of its ``FUNCTIONS`` minima as ``RECALL`` of documents at the threshold do, and
is not too short for the item's size class.  Candidates are verified by the exact share of the item's shingles.

Only DataFrame functions run.  Texts are not shuffled in the search: the index is broadcast if it has at most ``BROADCAST``
rows and else joined by shuffle.  Equal texts count once.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import SHINGLE, SIMILARITY, each_shingle, shingles
from gapwise.scale import durable

FUNCTIONS = 24
RECALL = 0.999999
#: most index rows (about 100 bytes each) sent to every executor
BROADCAST = 300_000


def text_key(text: Column | str) -> Column:
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the shingles of a text, repeated ones included."""
    return each_shingle(text, F.xxhash64, "array<bigint>")


def least_hits(containment: float, functions: int = FUNCTIONS, recall: float = RECALL) -> int:
    """Minima that a document with this containment holds with a chance of ``recall`` at least."""
    miss, k = 0.0, 0
    while True:
        miss += comb(functions, k) * containment**k * (1 - containment) ** (functions - k)
        if miss > 1 - recall:
            return max(1, k)
        k += 1


def index_items(items: DataFrame, text_col: str) -> DataFrame:
    """Rows (``hash``, ``item``, ``mask`` of the functions whose minimum it is, ``size_class``, ``least`` size in the class)."""
    sized = items.select(text_key(text_col).alias("item"), F.array_distinct(hashes(F.col(text_col))).alias("all")).where("size(all) > 0").dropDuplicates(["item"])
    sized = sized.withColumn("size_class", F.floor(F.log2(F.size("all"))).cast("int"))
    functions = F.explode(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)))
    minima = sized.select("item", "size_class", "all", functions.alias("function"))
    low = F.array_min(F.transform("all", lambda h: F.struct(F.xxhash64(h, F.col("function")).alias("rank"), h.alias("hash"))))
    minima = minima.select("item", "size_class", low["hash"].alias("hash"), F.expr("shiftleft(1L, function)").alias("bit"))
    return minima.groupBy("hash", "item", "size_class").agg(F.bit_or("bit").alias("mask")).withColumn("least", F.expr("shiftleft(1L, size_class)"))


def containments(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", containment: float = SIMILARITY) -> DataFrame:
    """Different texts that hold an item: ``key`` (digest of the text), ``item`` (digest of the item), ``n_item``, ``n_shared``.

    Shingles are runs of five words (runs of non-space, case counts), a shorter text is one; items and texts without a word
    have none and are in no result.
    """
    index = durable(index_items(items, item_text_col))
    index = F.broadcast(index) if index.count() <= BROADCAST else index
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    looked = texts.select("key", hashes(F.col("text")).alias("all")).select("key", F.size("all").alias("n"), F.explode("all").alias("hash"))
    hits = looked.join(index, "hash").where(F.col("n") >= F.lit(containment) * F.col("least") - F.lit(1e-9))
    hits = hits.groupBy("key", "item").agg(F.bit_or("mask").alias("mask"))
    found = durable(hits.where(F.bit_count("mask") >= least_hits(containment)).select("key", "item"))
    # verification on the shingles themselves, each text and item once
    exact = lambda text: F.array_distinct(shingles(text, SHINGLE))
    held = texts.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", exact(F.col("text")).alias("held"))
    asked = items.select(text_key(item_text_col).alias("item"), F.col(item_text_col).alias("text")).dropDuplicates(["item"]).select("item", exact(F.col("text")).alias("asked"))
    pairs = found.join(asked, "item").join(held, "key")
    pairs = pairs.select("key", "item", F.size("asked").alias("n_item"), F.size(F.array_intersect("asked", "held")).alias("n_shared"))
    return durable(pairs.where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - F.lit(1e-9)))


def find(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    containment: float = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs`` and item that it holds: both ids, ``n_item`` and ``n_shared`` shingles, ``containment``.

    Null and blank texts hold nothing.  Repeated documents and items, and those with null ids, give a row each.  Other
    columns are ignored.  Empty tables give an empty result.
    """
    found = containments(docs, items, text_col, item_text_col, containment)
    rows = docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("key")).join(found, "key")
    rows = rows.join(items.select(F.col(item_id_col).alias("__item"), text_key(item_text_col).alias("item")), "item")
    return rows.select(
        F.col("__id").alias(id_col), F.col("__item").alias(item_id_col), F.col("n_item").cast("long").alias("n_item"),
        F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", containment: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; null and blank texts stay."""
    dirty = containments(docs, items, text_col, item_text_col, containment).select("key").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), text_key(text_col).alias("key"))
    return packed.join(dirty, "key", "left_anti").select("row.*")


def find_sql(containment: float = SIMILARITY) -> str:
    """The same over ``documents`` and ``benchmark``, without an index."""
    cut = lambda name, key: f"""(SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}) WHERE len(w) > 0)"""  # noqa: E731
    return f"""
WITH d AS {cut("documents", "doc_id")}, i AS {cut("benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM p JOIN n USING (item_id)
WHERE n_shared >= {containment} * n_item - 1e-9
"""
