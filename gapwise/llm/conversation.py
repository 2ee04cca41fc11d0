"""Repair of conversation structure by an auction for shortest paths.

A conversation should read system (or not), then user and assistant in turns.  Each row can be kept, given another role or
deleted, and empty rows can be inserted, each at a cost; the cheapest edits are a shortest path through a lattice whose
nodes are (rows consumed, state of the grammar).  An auction finds it: a path grows from its origin along an arc that is
tight under the node prices, or shrinks while the price of its end rises to the least that its arcs allow.  At the end the
prices are the distances to the goal, every cheapest path consists of tight arcs, and the ASCII-least one is traced by
taking the least letter among the tight arcs at each node.

Rows of one conversation are numbered with hot conversations cut into chunks, and their one-letter symbols are gathered
in blocks of at most ``block`` rows.  Blocks of longer conversations are joined by their 4 x 4 distance matrices, again in
groups of bounded size.  Texts are shuffled once, and streamed in order past the edits; a task holds the edits of one
block and the state of one digest.  A digest runs over all text of its conversation, so that step is one stream per
conversation by its definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.scale import durable, previous, running_sum, scan

BLOCK = 1024
FAN = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60

#: grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation ends in 0 or 3
GOAL = (0, NEVER, NEVER, 0)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
TURN = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))


def _arcs(symbol: str) -> list[list[tuple]]:
    """Per state the arcs (letter, cost, next state) over a row, in ASCII order of the letters.

    ``d`` is a row that has to go; a capital marks a truncated row; ``x`` is a row whose role has no place.
    """
    if symbol == "d":
        return [[("D", DELETE, q)] for q in range(4)]
    extra = TRUNCATED * symbol.isupper()
    out = []
    for q in range(4):
        keep = NEXT.get(symbol.lower(), {}).get(q)
        arcs = [("D", DELETE, q)]
        if keep is not None:
            arcs.append(("K", KEEP + extra, keep))
        arcs.append(("R", REROLE + extra, TURN[q][0]))
        out.append(arcs)
    return out


ARCS = {s: _arcs(s) for s in "suaxSUAXd"}


def _auction_layer(arcs: list[list[tuple]], below: tuple, reachable: list[bool]) -> tuple:
    """Prices of the four nodes of one layer, the next layer's prices being final.

    Every node is the origin of a path once.  A layer starts at the least price of the next one, which no arc forbids as
    costs are not negative.  A path that meets a final price or a settled node is complete, as tight arcs lead on from there.
    """
    start = min(below)
    price = [start if r else NEVER for r in reachable]
    settled = [not r for r in reachable]
    for origin in range(4):
        path = [] if settled[origin] else [origin]
        while path:
            q = path[-1]
            best, head = 3 + price[TURN[q][0]], TURN[q][0]
            for _, cost, to in arcs[q]:
                if cost + below[to] < best:
                    best, head = cost + below[to], None
            if best >= NEVER:
                price[q], settled[q] = NEVER, True
                path.pop()
            elif price[q] < best:  # contraction: the end's price rises, the path gives way
                price[q] = best
                if len(path) > 1:
                    path.pop()
            elif head is None or settled[head]:
                for node in path:
                    settled[node] = True
                break
            else:  # extension along a tight arc
                path.append(head)
    return tuple(price)


def prices(symbols: str, ends: tuple) -> list[tuple]:
    """Node prices of all layers of a block; ``ends`` are the distances to the goal from behind its last row."""
    reachable = [any(ends[e] < NEVER for e in REACH[q]) for q in range(4)]
    last = [[("", 0, q)] for q in range(4)]
    layers = [_auction_layer(last, tuple(ends), reachable)]
    for symbol in reversed(symbols):
        layers.append(_auction_layer(ARCS[symbol], layers[-1], reachable))
    return layers[::-1]


def trace(symbols: str, ends: tuple, state: int) -> tuple[tuple[str, ...], int, int]:
    """ASCII-least cheapest edits from ``state``: letters per row (inserts before it first, behind the last row at the end),
    the state behind the block and the cost of the block's edits."""
    layers = prices(symbols, ends)
    steps, cost = [], layers[0][state]
    for i, symbol in enumerate([*symbols, None]):
        here, letters = layers[i], ""
        while True:
            if symbol is None:
                if here[state] == ends[state]:
                    break
                tight = None
            else:
                tight = next(((a, c, to) for a, c, to in ARCS[symbol][state] if here[state] == c + layers[i + 1][to]), None)
            inserted = TURN[state][0]
            if here[state] == INSERT + here[inserted] and (tight is None or tight[0] > "I"):
                letters, state = letters + "I", inserted
                continue
            letters, state = letters + tight[0], tight[2]
            break
        steps.append(letters)
    return tuple(steps), state, cost - ends[state]


def matrix(symbols: str) -> list[int]:
    """Least cost from each state before the block to each state behind it, row by row."""
    columns = [prices(symbols, tuple(0 if e == to else NEVER for e in range(4)))[0] for to in range(4)]
    return [columns[to][q] for q in range(4) for to in range(4)]


def _behind(m: list[int], ends: tuple) -> tuple:
    return tuple(min(min(m[4 * q + e] + ends[e] for e in range(4)), NEVER) for q in range(4))


# --------------------------------------------------------------------------- rows


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage with ``copies`` 0 (dropped), 1 or 2; null roles and texts, and nulls in the hashed key, are one space."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    code = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn"),
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, each once, in the form that ``repair`` takes."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def _symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation without their texts: place, number, symbol, number of copies, counts for the report."""
    text, lastly = F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
    end = F.regexp_extract(text, lastly, 1)
    slim = rows.where("copies > 0").select(
        "conv",
        "turn",
        "role",
        F.unhex(F.md5("text")).alias("digest"),
        "copies",
        F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").alias("state"),
    )
    slim = slim.groupBy("conv", "turn", "role", "digest", "state").agg(F.sum("copies").cast("long").alias("n"))
    own = F.concat(F.md5(F.to_json(F.struct("conv", "role"))), F.hex("digest"))
    slim = scan(durable(slim.withColumn("same", own)), ["same"], ["turn"], {"earlier": running_sum(1, inclusive=False)})
    first = F.when(F.col("state") == "blank", "blank").when(F.coalesce("earlier", F.lit(0)) > 0, "duplicate").otherwise(F.col("state"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    slim = slim.select(
        "conv",
        F.struct("turn", "role", "digest").alias("place"),
        "n",
        first.alias("fault"),
        initial.alias("initial"),
        F.when(first.isin("blank", "duplicate"), "d").when(first == "truncated", F.upper(letter)).otherwise(letter).alias("symbol"),
    )
    before = previous(F.struct(F.col("place")["turn"].alias("turn"), "initial"))
    return scan(slim, ["conv"], ["place"], {"number": running_sum(1), "before": before})


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Symbols of up to ``block`` consecutive rows as one string, with the block's part of the counts."""
    n, b = F.col("n"), F.col("before")
    turn = F.col("place")["turn"]
    legal = F.concat(b["initial"], F.col("initial")).isin("su", "ua", "au")
    broken = F.when(b.isNotNull() & ~legal, 1).otherwise(0) + n - 1
    new_turn = turn.isNotNull() & (b.isNull() | b["turn"].isNull() | (b["turn"] != turn))
    of = F.sort_array(F.collect_list(F.struct("number", "symbol", "n", "place")))
    found = rows.groupBy("conv", F.floor((F.col("number") - 1) / block).alias("block")).agg(
        of.alias("of"),
        F.min(turn).alias("low"),
        F.max(turn).alias("high"),
        F.count_if(new_turn).alias("turns"),
        F.sum(F.when(F.col("fault") == "blank", n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", n).when(F.col("fault") == "blank", 0).otherwise(n - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"),
        F.sum(broken).alias("illegal"),
    )
    return found.select(
        "*",
        F.array_join(F.transform("of", lambda r: r["symbol"]), "").alias("symbols"),
        F.transform("of", lambda r: r["n"]).alias("times"),
        F.col("of")[0]["place"].alias("place"),
    ).drop("of")


# --------------------------------------------------------------------------- long conversations


def _with_ends(blocks: DataFrame, fan: int) -> DataFrame:
    """Add ``ends``: the distance to the goal from behind each block.

    Blocks of conversations with several blocks become matrices; up to ``fan`` neighbours are multiplied into one until a
    conversation is one matrix, and the distances are handed back down the same way.  One-block conversations end in the goal.
    """
    ends = F.array(*[F.lit(e).cast("long") for e in GOAL])
    several = blocks.groupBy("conv").agg(F.max("block").alias("last")).where("last > 0")
    many = _null_safe(blocks.select("conv", "block", "symbols"), several.select("conv"))
    form = T.StructType([*[many.schema[c] for c in ("conv", "block")], T.StructField("m", T.ArrayType(T.LongType()))])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([matrix(s) for s in b["symbols"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["conv"], b["block"], found], ["conv", "block", "m"])

    levels = [durable(many.mapInArrow(matrices, form))]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        groups = levels[-1].withColumn("group", F.floor(F.col("block") / fan))
        up = groups.groupBy("conv", "group").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("ms"))
        product = T.ArrayType(T.LongType())
        of = F.udf(lambda ms: reduce(_times, [r["m"] for r in ms]), product)
        levels.append(durable(up.select("conv", F.col("group").alias("block"), of("ms").alias("m"))))
    known = levels.pop().select("conv", "block", ends.alias("ends"))
    behind = T.ArrayType(T.StructType([T.StructField("block", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))

    @F.udf(behind)
    def down(ms, end):
        out = []
        for r in reversed(ms):
            out.append((r["block"], list(end)))
            end = _behind(r["m"], end)
        return out

    for level in reversed(levels):
        groups = level.groupBy("conv", F.floor(F.col("block") / fan).alias("group")).agg(
            F.sort_array(F.collect_list(F.struct("block", "m"))).alias("ms")
        )
        above = known.select(F.col("conv").alias("c"), F.col("block").alias("g"), F.col("ends").alias("end"))
        met = groups.join(above, groups["conv"].eqNullSafe(above["c"]) & (groups["group"] == above["g"]))
        known = met.select("conv", F.explode(down("ms", "end")).alias("r")).select("conv", "r.block", "r.ends")
    known = known.select(F.col("conv").alias("c"), F.col("block").alias("k"), F.col("ends").alias("found"))
    out = blocks.join(known, blocks["conv"].eqNullSafe(known["c"]) & (blocks["block"] == known["k"]), "left")
    return out.withColumn("ends", F.coalesce("found", ends)).drop("c", "k", "found")


def _null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnRenamed("conv", "c")
    return left.join(r, left["conv"].eqNullSafe(r["c"]), "left_semi")


def _times(a: list[int], b: list[int]) -> list[int]:
    return [min(NEVER, *[a[4 * q + k] + b[4 * k + to] for k in range(4)]) for q in range(4) for to in range(4)]


# --------------------------------------------------------------------------- streaming past the edits


EDITED = ["conv", "block", "audit", "cost", "sha"]


class _Digest:
    """Digest of the lines of a repaired conversation and the state of the grammar behind them."""

    def __init__(self):
        self.sha, self.state, self.empty = hashlib.sha256(), 0, True

    def line(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def edit(self, letters: str, role: str, text: str) -> None:
        """Write the inserted rows and then, kept or with another role, the row itself."""
        for letter in letters:
            if letter == "K":
                self.state = NEXT[role[:1]][self.state]
                self.line(role, text)
            elif letter != "D":
                self.state, other = TURN[self.state]
                self.line(other, text if letter == "R" else "")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by conversation and place; a block's header comes before its rows."""
    digest = head = last = None
    steps, at, solve = (), 0, lru_cache(maxsize=4096)(trace)
    columns = ["kind", "turn", "role", "digest", "text", "symbols", "times", "ends", "block", "final", "conv"]
    for b in batches:
        out = []
        for kind, turn, role, key, text, symbols, times, ends, block, final, conv in zip(*[b[n].to_pylist() for n in columns]):
            if kind == 0:
                if block == 0:
                    digest = _Digest()
                steps, _, cost = solve(symbols, tuple(ends), digest.state)
                audit = "".join(s + "D" * (n - 1) for s, n in zip(steps, times)) + steps[-1]
                head = (conv, block, audit, cost + DELETE * (sum(times) - len(times)), block == final)
                at, last = 0, None
            elif (turn, role, key) != last:  # an equal one is a copy, which is deleted
                last = (turn, role, key)
                digest.edit(steps[at], role, text)
                at += 1
                if at == len(steps) - 1:
                    digest.edit(steps[at], "", "")
                    out.append((*head[:4], digest.sha.hexdigest() if head[4] else None))
        types = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], EDITED)


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies): counts, cost, audit and digest of the repair.

    Rows go by turn (nulls first); rows of one turn by role, then by the MD5 of their text.  A role that starts with
    none of s, u, a, the empty one included, cannot be kept.  Conversations all of whose rows have no copy give zeros, an
    empty audit and the digest of the empty string; an empty table gives no row.  A null conversation is one of its own.
    """
    blocks = _with_ends(durable(_blocks(_symbols(rows), block)), fan)
    tops = blocks.groupBy("conv").agg(F.max("block").alias("final")).withColumnRenamed("conv", "c")
    heads = blocks.join(tops, blocks["conv"].eqNullSafe(tops["c"])).select(
        "conv", "place.turn", "place.role", "place.digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"),
        "block", "symbols", "times", "ends", "final",
    )
    texts = rows.where("copies > 0").select(
        "conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("kind"), "text"
    )
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")
    types = [rows.schema["conv"].dataType, T.LongType(), T.StringType(), T.LongType(), T.StringType()]
    form = T.StructType([T.StructField(n, t) for n, t in zip(EDITED, types)])
    edited = ordered.mapInArrow(_edit, form)
    counts = blocks.select("conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
    ids = rows.where("copies = 0").select("conv").distinct()
    parts = edited.unionByName(counts, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)

    pieces = F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("block", "audit"))))
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    return parts.groupBy("conv").agg(
        gaps.alias("gaps"),
        *[total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    ).withColumnRenamed("conv", "conv_id")
