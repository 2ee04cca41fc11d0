"""N-gram Jaccard join by a MinHash LSH forest.

Every text becomes the set of its five-word shingles and a MinHash signature, which is cut into ``TREES`` labels of
``DEPTH`` values each.  A tree of the forest is the prefix trie of its labels: texts that share a prefix of length d
meet in one node.  The join cuts the tries at the longest prefix at which every pair, even one that is exactly at the
threshold, meets at least once with a chance of ``RECALL``.  This holds pair by pair: a share over the pairs found would be
that of the largest groups.  Signatures only propose groups; all pairs in a group are then compared by their whole shingle sets.

Scale: equal shingle sets are one vertex with a count, nodes and groups of any size are cut into blocks of ``BLOCK``
vertices, and a task compares two blocks and returns links per vertex and a spanning forest, never the pairs.  The key
of a vertex is 128 bits of its shingle set and shingles are 64-bit hashes; no other approximation enters verification.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import SHINGLE, SIMILARITY, components, in_pieces, partitions, shingle_set
from gapwise.scale import durable

TREES, DEPTH = 20, 8
RECALL = 0.999
#: a signature puts pairs of similarity 0.8 below this estimate with a chance under 1e-9 (160 values, 6 deviations)
LOOSE = 0.6
BLOCK, BLOCK_SHINGLES = 256, 400_000


def signature(x: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """``trees * depth`` MinHash values of a set of 64-bit hashes, from their upper halves times odd numbers modulo 2^32."""
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = np.full(trees * depth, 2**32 - 1, np.uint32)
    upper = (x >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (mul[:, None] * upper[None, at : at + 1024]).min(1), out=low)
    return low


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, digest of the text, key of its shingle set (null without a word), number of shingles, signature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in in_pieces(batches):
            keys, sizes, signs = [], [], []
            for t in b.column(2).to_pylist():
                x = shingle_set(t, SHINGLE)
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sizes.append(len(x))
                signs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                ["id", "digest", "key", "n", "sign"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    return durable(rows.mapInArrow(run, f"id {kind}, digest string, key binary, n long, sign binary"))


def meets(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Chance that two texts share a prefix of this length in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def _blocks(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Each row once for every pair of blocks that its block takes part in; ``count`` is the number of blocks."""
    block = F.pmod(F.xxhash64("key"), F.col(count))
    df = df.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    df = df.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    by = [*keys, "p", "q"]
    return df.drop("other", count).repartition(partitions(df.sparkSession), *by).sortWithinPartitions(*by)


def _grouped(batches: Iterator, by: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal ``by`` values in sorted batches; a run is at most two blocks."""
    import pyarrow as pa

    last, rows = None, []
    for b in in_pieces(batches, 256):
        columns = []
        for c in b.columns:
            if pa.types.is_list(c.type):  # as arrays: Python numbers would take many times the memory
                flat, ends = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))
                columns.append([x.copy() for x in np.split(flat, ends[:-1])])
            else:
                columns.append(c.to_pylist())
        for r in (dict(zip(b.schema.names, values, strict=True)) for values in zip(*columns, strict=True)):
            key = tuple(r[c] for c in by)
            if rows and key != last:
                yield last, rows
                rows = []
            last = key
            rows.append(r)
    if rows:
        yield last, rows


def _sides(rows: list[dict], p: int, q: int) -> tuple[list[int], list[int]]:
    left = [i for i, r in enumerate(rows) if r["block"] == p]
    return left, left if p == q else [i for i, r in enumerate(rows) if r["block"] == q]


class _Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.find(i), self.find(j)
            self.up[max(a, b)] = min(a, b)


def _propose(loose: float = LOOSE) -> Callable:
    """Compare the signatures of the members of a node: links of a spanning forest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        links: list[tuple] = []
        for (_, _, p, q), rows in _grouped(batches, ["node", "tree", "p", "q"]):
            if len(rows) < 2:
                continue
            signs = np.frombuffer(b"".join(r["sign"] for r in rows), np.uint32).reshape(len(rows), -1)
            left, right = _sides(rows, p, q)
            right = np.array(right, np.int64)
            forest = _Forest(len(rows))
            for i in left:
                js = right[right > i] if p == q else right
                forest.join(i, js[(signs[i] == signs[js]).mean(1) >= loose])
            links += [(r["key"], rows[forest.find(i)]["key"]) for i, r in enumerate(rows) if forest.find(i) != i]
            if len(links) > 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in links], schema)
                links = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in links], schema)

    return run


def _nodes(depth: int) -> Column:
    """Node of the forest that each tree puts a signature in: hash of the tree's first ``depth`` values."""
    prefix = lambda tree: F.substring("sign", tree * (4 * DEPTH) + 1, F.lit(4 * depth))
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    return F.transform(trees, lambda tree: F.struct(tree.alias("tree"), F.xxhash64(tree, prefix(tree)).alias("node")))


def candidates(vertices: DataFrame, recall: float = RECALL, similarity: float = SIMILARITY) -> DataFrame:
    """Links (``a``, ``b``) that connect every vertex with those it may be similar to."""
    depth = next((d for d in range(DEPTH, 0, -1) if meets(similarity, d) >= recall), 1)
    nodes = vertices.select("key", F.inline(_nodes(depth)))
    size = nodes.groupBy("node", "tree").agg(F.count("*").alias("size"))
    met = nodes.join(size.where("size > 1"), ["node", "tree"]).withColumn("cuts", F.ceil(F.col("size") / BLOCK))
    met = _blocks(met.drop("size").join(vertices.select("key", "sign"), "key"), ["node", "tree"], "cuts")
    return durable(met.select("node", "tree", "p", "q", "block", "key", "sign").mapInArrow(_propose(), "a binary, b binary")).distinct()


def _verify(similarity: float) -> Callable:
    """Exact similarity of all pairs of two blocks: per vertex its links, and one link of a spanning forest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])
        out: list[dict] = []
        for (_, p, q), rows in _grouped(batches, ["root", "p", "q"]):
            sets = [np.asarray(r.pop("shingles"), np.int64) for r in rows]
            copies = np.array([r["copies"] for r in rows], np.int64)
            left, right = _sides(rows, p, q)
            if not left or not right:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([sets[j] for j in right])
            starts = np.concatenate(([0], np.cumsum(sizes[right])[:-1]))
            values, flat = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(values), bool)
            texts, docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            forest, cols = _Forest(len(rows)), np.array(right, np.int64)
            for i in left:
                at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
                at = at[values[at] == sets[i]]
                mark[at] = True
                shared = np.add.reduceat(mark[flat].astype(np.int64), starts)
                mark[at] = False
                # similarity as a fraction: shared / union >= similarity
                near = shared >= similarity * (sizes[i] + sizes[cols] - shared) - 1e-9
                near &= cols != i
                js = cols[near]
                texts[i] += len(js)
                docs[i] += copies[js].sum()
                if p != q:
                    texts[js] += 1
                    docs[js] += copies[i]
                forest.join(i, js)
            out += [
                {"a": r["key"], "b": rows[forest.find(i)]["key"], "texts": int(texts[i]), "docs": int(docs[i])}
                for i, r in enumerate(rows)
                if texts[i]
            ]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _with_shingles(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in in_pieces(batches):
        sets = [shingle_set(t, SHINGLE).view(np.int64) for t in b.column("text").to_pylist()]
        keep = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.list_(pa.int64()))], [*b.schema.names[:-1], "shingles"])


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, digest of its text, class, links.

    Two documents are linked if their sets of five-word shingles (words are runs of non-space, case counts; a shorter
    text is one shingle) have a Jaccard similarity of ``similarity`` or more; classes are the connected components.
    Columns: ``id``, ``digest``, ``class_id`` (least id in the class), ``n_links`` (other rows linked to this one, copies
    counted one by one), ``n_texts`` (different shingle sets among them), ``first_id`` and ``first_digest`` (least pair in the class).

    Null and blank texts have no shingle and no link: each is its own class.  Repeated rows are copies of each other.
    A null id takes part like any other; ``class_id`` is null only if all ids of the class are.  Other columns of the
    input are ignored.  An empty table gives an empty result.
    """
    rows = sketch(docs, id_col, text_col)
    vertices = durable(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("copies"), F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign"),
        )
    )
    groups = components(candidates(vertices, recall, similarity))
    members = groups.select(F.col("id").alias("key"), "root").join(vertices.drop("sign"), "key")
    cuts = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("cuts"))
    members = durable(members.join(cuts, "root").select("key", "root", "cuts", "copies", "rep"))
    texts = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    found = members.join(texts, members["rep.id"].eqNullSafe(texts["id"]) & (members["rep.digest"] == texts["digest"]))
    found = found.select("key", "root", "cuts", "copies", "text").dropDuplicates(["key"])
    found = found.mapInArrow(_with_shingles, "key binary, root binary, cuts long, copies long, shingles array<long>")
    pairs = _blocks(found, ["root"], "cuts").select("root", "p", "q", "block", "key", "copies", "shingles")
    pairs = durable(pairs.mapInArrow(_verify(similarity), "a binary, b binary, texts long, docs long"))
    links = pairs.groupBy(F.col("a").alias("key")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(pairs).select(F.col("id").alias("key"), "root")
    # only vertices with copies or links need more than their own row
    many = vertices.drop("sign", "n").join(links, "key", "left").join(classes, "key", "left").where("copies > 1 OR root IS NOT NULL")
    many = durable(many.withColumn("root", F.coalesce("root", "key")))
    whole = many.groupBy("root").agg(F.min("least").alias("class_id"), F.min("rep").alias("first"))
    info = many.join(whole, "root").select(
        F.col("key").alias("vertex"), "class_id", "first",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    out = rows.select("id", "digest", "key").join(info, F.col("key") == F.col("vertex"), "left")
    alone = F.col("vertex").isNull()
    pick = lambda one, other: F.when(alone, one).otherwise(other)
    return out.select(
        "id", "digest",
        pick(F.col("id"), F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        pick(F.col("id"), F.col("first.id")).alias("first_id"),
        pick(F.col("digest"), F.col("first.digest")).alias("first_digest"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each class: that with the least (id, digest of the text).

    Rows that repeat in id and text stay once, also if they have no word.
    """
    classes = durable(similar_classes(docs, id_col, text_col, **options).withColumn("stays", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))))
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"))
    same = lambda other: packed["id"].eqNullSafe(other["id"]) & (packed["digest"] == other["digest"])
    kept = packed.join(gone := classes.where("NOT stays").select("id", "digest"), same(gone), "left_anti")
    twice = classes.where("stays").groupBy("id", "digest").count().where("count > 1")
    if twice.isEmpty():
        return kept.select("row.*")
    again = durable(twice.select("id", "digest"))
    on = lambda other: kept["id"].eqNullSafe(other["id"]) & (kept["digest"] == other["digest"])
    once = kept.join(again, on(again), "left_semi").dropDuplicates(["id", "digest"])
    return kept.join(again, on(again), "left_anti").unionByName(once).select("row.*")
