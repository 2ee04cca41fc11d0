"""Helpers shared by the training-data operators: words, shingles, tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.scale import durable, shared_folder

#: ASCII white space; a word is a longest run of other characters
SPACE = r"[\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable_text(df: DataFrame) -> DataFrame:
    """Like ``durable``, for tables that hold whole texts: written with the denser codec."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/gapwise/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and empty text have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row, also where ``then`` uses it inside a function of elements."""
    return F.element_at(F.transform(F.array(value), then), 1)


def each_shingle(text: Column, make: Callable[[Column], Column], empty: str, size: int = SHINGLE) -> Column:
    """Array of ``make(words of the shingle)``; a text shorter than ``size`` words is one shingle of all its words."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: make(F.slice(w, i, F.lit(size))))).otherwise(F.array().cast(empty))

    return once(words(text), of)


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Array of the ``size``-word shingles, their words joined by a space."""
    return each_shingle(text, lambda w: F.array_join(w, " "), "array<string>", size)


@lru_cache(maxsize=2**15)
def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text, empty if it has no word.

    A shingle's hash mixes the hashes of its words, each times an odd number for its place.
    """
    found = (text or "").encode().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    size = min(size, len(found))
    n = len(found) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += each[i : i + n] * np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    return np.unique(mix64(total))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that what a task derives from them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links in ``a`` and ``b``: one row (``id``, ``root``) per linked id, root the least id.

    Alternating large-star and small-star rounds: every id hands its larger, then its smaller neighbours to the least
    one it knows.  Each round is two joins over the links, written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.  No links give an empty table.
    """
    links = durable(_ordered(edges.select("a", "b")).distinct())
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = _ordered(large).distinct()
        # a > b holds now: the smaller neighbours of a
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
        new = durable(_ordered(small.select(F.col("e.a").alias("a"), F.col("e.low").alias("b"))).distinct())
        if _digest(new) == _digest(links):
            return new.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).unionByName(
                new.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )
        links = new


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
