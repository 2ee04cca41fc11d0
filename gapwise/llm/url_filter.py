"""URL filters: rules on host and path, and a block list held in a Bloom filter cascade.

The cascade is built for the complete key universe of the corpus: every host that occurs, and every domain above it.  Level 0 is a
Bloom filter of the listed keys, level 1 one of the unlisted keys of the universe that pass level 0, level 2 one of the listed keys
that pass level 1, and so on until none is wrong.  A key of the universe is listed if the first level that rejects it is
odd, or if it passes all of an odd number of levels: exact membership, a few bits per key, and no join with the pages.

Keys are found, hashed and tested by Spark; a level is made by or-ing 64-bit words that tasks set.  Level sizes follow from counts,
so what is sent to the tasks is known before it is built; beyond ``MOST_BYTES`` the pages are joined with the list instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import mix64
from gapwise.scale import durable

BITS, HASHES = 10, 5
MOST_BYTES = 256 * 1024 * 1024
#: fixed: rules as (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: fixed: a domain is listed if a hyphen-separated part of its first label is one of these
LISTED_WORDS = ["casino", "bets", "pills", "adult", "spam", "ads"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a URL, both empty for null and text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and all domains above it; none for an empty host."""
    parts = F.split(host, r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host != "", above).otherwise(F.array().cast("array<string>"))


def slots(a: np.ndarray, b: np.ndarray, level: int, size: int, hashes: int = HASHES) -> np.ndarray:
    """Bit numbers (keys x hashes) of keys given by two 64-bit hashes."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    first, step = mix64(a + salt), mix64(b + salt) | np.uint64(1)
    return (first[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def level_size(keys: int) -> int:
    return max(64, -(-keys * BITS // 64) * 64)


@dataclass(frozen=True)
class Cascade:
    """Bloom filters in order, each as 64-bit words."""

    levels: tuple[np.ndarray, ...] = ()

    def first_miss(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Level that rejects each key, the number of levels if none does."""
        out = np.full(len(a), len(self.levels))
        left = np.arange(len(a))
        for n, words in enumerate(self.levels):
            at = slots(a[left], b[left], n, len(words) * 64)
            hit = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
            out[left[~hit]] = n
            left = left[hit]
        return out

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.first_miss(a, b) % 2 == 1


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")]


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))


def _filter_of(keys: DataFrame, level: int, count: int) -> np.ndarray:
    """Words of a Bloom filter of the hashed keys."""
    size = level_size(count)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = slots(*_columns(batch), level, size).ravel()
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    out = np.zeros(size // 64, np.int64)
    for r in keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    """Hashed keys that a level does not reject."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = _columns(batch)
            at = slots(a, b, level, len(words) * 64)
            hit = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
            yield batch.filter(pa.array(hit))

    return keys.mapInArrow(run, "a long, b long")


def build(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """Cascade for the keys (column ``key``) of both tables; None if its filters could exceed ``MOST_BYTES``."""
    keys = universe.select("key", F.lit(0).alias("on")).union(listed.select("key", F.lit(1).alias("on"))).where("key IS NOT NULL")
    keys = durable(keys.groupBy("key").agg(F.max("on").alias("on")).select("on", *_hashed(F.col("key"))))
    n = {r["on"]: r["count"] for r in keys.groupBy("on").count().collect()}
    # levels shrink by far more than half, so twice the first level and the first level of false positives bound the whole
    if 2 * (level_size(n.get(1, 0)) + level_size(n.get(0, 0) // 8)) // 8 > MOST_BYTES:
        return None
    inside, outside = keys.where("on = 1").select("a", "b"), keys.where("on = 0").select("a", "b")
    levels: list[np.ndarray] = []
    count = n.get(1, 0)
    while count:
        level = len(levels)
        levels.append(_filter_of(inside, level, count))
        wrong = durable(_passing(outside, levels[-1], level))
        inside, outside, count = wrong, inside, wrong.count()
        if level > 100:
            raise ValueError("two keys have the same 128-bit hash")
    return Cascade(tuple(levels))


def listed_by_words(universe: DataFrame, words: list[str] = LISTED_WORDS) -> DataFrame:
    """The keys whose first label has one of ``words`` between hyphens."""
    return universe.where(F.col("key").rlike(rf"^(?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?(?:\.|$)"))


def key_universe(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """All hosts of a table and the domains above them: ``key``.  Hosts are made distinct before they are taken apart."""
    hosts = pages.select(host_path(F.col(url_col))[0].alias("host")).distinct()
    return hosts.select(F.explode(domains(F.col("host"))).alias("key")).distinct()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """One row per row: id, ``host``, ``path``, ``rule`` (the longest that fits, or null), ``verdict``, ``listed``.

    A rule's verdict holds; without a rule the page is blocked if its host or a domain above it is in ``listed`` (column ``key``; by
    default the domains of the table that :data:`LISTED_WORDS` name), else allowed.  Null urls and those without ``://`` have an
    empty host and path and are allowed.  Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    universe = durable(key_universe(pages, url_col))
    listed = listed_by_words(universe) if listed is None else listed
    cascade = build(universe, listed)
    kind = pages.schema[id_col].dataType.simpleString()
    if cascade is None:
        above = rows.select("host").distinct().select("host", F.explode(domains(F.col("host"))).alias("key"))
        bad = above.join(listed.select("key").distinct(), "key").select(F.col("host").alias("bad")).distinct()
        rows = rows.join(bad, F.col("host") == F.col("bad"), "left").select("id", "host", "path", F.col("bad").isNotNull().alias("listed"))
    else:

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                each = batch.column("keys")
                owner = np.repeat(np.arange(batch.num_rows), each.value_lengths().to_numpy(zero_copy_only=False))
                flat = each.flatten()
                a, b = (flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                hit = np.zeros(batch.num_rows, bool)
                hit[owner[cascade.listed(a, b)]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hit)], ["id", "host", "path", "listed"])

        pairs = F.transform(domains(F.col("host")), lambda key: F.struct(*_hashed(key)))
        rows = rows.withColumn("keys", pairs).mapInArrow(run, f"id {kind}, host string, path string, listed boolean")
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)) for _, h, p in longest]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, longest, strict=True)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, longest, strict=True)], F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def judge_sql(words: list[str] = LISTED_WORDS) -> str:
    """The same with the default rules and list, over ``pages``."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT *, regexp_matches(host, '(^|[.-])({'|'.join(words)})([.-]|$)') AS listed FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM l
"""
