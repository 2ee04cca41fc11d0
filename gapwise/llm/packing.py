"""Packing documents into sequences of a fixed number of tokens by sums of squares.

Documents are tokenized and cut only where they are longer than a sequence.  A piece goes where the sum over all residual
gaps of (number of open sequences with that gap) squared becomes smallest: into a new sequence, or into an open one of some
gap.  That rule only needs the counts by gap, so a group of pieces is packed by a small state; groups are random parts of
bounded size.  Sequences that a group leaves open are dissolved, and their pieces are placed again in fewer groups, until a
round saves no sequence.  Only keys and lengths travel; a task holds one group.

The tokenizer must drop white space and split letters and digits from punctuation (``word_bpe_49k.json`` does), so that the ids of a
text are those of its words one after another; ids of words are remembered by each Python worker.  Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import math
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import in_pieces
from gapwise.scale import durable, spread

LENGTH = 2048
END = 0
GROUP = 50_000
VOCABULARY = "word_bpe_49k.json"

#: between a letter (ASCII or Latin-1, UTF-8) or digit and punctuation other than an apostrophe the tokenizer always splits
EDGE = re.compile(
    rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])|(?<=\xc3[\x9f-\xb6\xb8-\xbf])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z0-9])"
)
#: words that its normalizer and its splitting leave as they are: lower-case letters of ASCII and Latin-1
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
KNOWN_BYTES = 128 << 20


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level tokenizers write each byte: itself where it is printable, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Words(dict):
    """Ids of words as little-endian 32-bit bytes, computed when a word is first asked for."""

    def __init__(self, vocabulary: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.size = self.tokenizer.model, _byte_letters(), 0

    def __missing__(self, word: bytes) -> bytes:
        if PLAIN.fullmatch(word):
            found = _packed([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])
        elif word[-1:] in b".,;:!?" and PLAIN.fullmatch(word, 0, len(word) - 1):
            found = self[word[:-1]] + self[word[-1:]]
        elif len(parts := EDGE.sub(b" ", word).split()) > 1:
            found = b"".join([self[p] for p in parts])
        else:
            found = _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        self[word] = found
        self.size += len(word) + len(found) + 150
        return found

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; a batch's words are told apart by Arrow, so that each is looked up once."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten().dictionary_encode()
        of = [self[w] for w in words.dictionary.cast(pa.binary()).to_pylist()]
        at, ends = words.indices.to_numpy(), split.offsets.to_numpy()
        for start, end in zip(ends[:-1], ends[1:]):
            yield b"".join(map(of.__getitem__, at[start - ends[0] : end - ends[0]].tolist()))
        if self.size > KNOWN_BYTES:
            self.clear()
            self.size = 0


def _words(vocabulary: str) -> Words:
    """The tokenizer of this Python worker; it stays for the worker's next tasks."""
    kept = sys.modules.setdefault("_gapwise_words", types.ModuleType("_gapwise_words"))
    if vocabulary not in vars(kept):
        setattr(kept, vocabulary, Words(vocabulary))
    return vars(kept)[vocabulary]


def tokenize(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document, ``end`` behind its last token.

    Columns doc_id, piece, start, length, ids_crc32 (little-endian unsigned 32-bit ids) and, with ``keep_ids``, ids.  A
    null or empty text is the one token ``end``.  Repeated rows give repeated pieces; other columns are left out.
    """
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids
    step = 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        last = end.to_bytes(4, "little")
        for b in in_pieces(batches, 256):
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, found in enumerate(words.ids(b["text"])):
                found += last
                for k in range(0, len(found), step):
                    part = found[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [b["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, size, crc)]
            columns += [pa.array(ids, pa.list_(pa.int64()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def place(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, offset and whether the sequence stays open, for pieces taken from the longest to the shortest.

    Going from gap g to gap h changes the sum by 2 (count(h) - count(g) + 1), one less where h is full or the sequence is
    new; of equal changes the one that leaves the smallest gap is taken, and of sequences with one gap the latest.
    """
    count = np.zeros(length + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        change = 2 * (count[: length + 1 - size] - count[size:]) + 2  # by the gap that is left
        change[count[size:] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * count[length - size] + 1
        if size < length:
            change[0] -= 1 if count[size] else 0
        else:
            change[0] = 0
        left = int(change.argmin())
        gap = left + size
        if gap == length:
            here = len(gaps)
            gaps.append(length)
        else:
            here = by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i], gaps[here] = here, length - gap, left
        if left:
            by_gap[left].append(here)
            count[left] += 1
    return sequence, offset, np.array(gaps, np.int64)[sequence] > 0 if gaps else np.empty(0, bool)


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``length``; rows need not be distinct.

    Full pieces are sequences of their own.  Each round packs the open pieces in groups of about ``group`` rows; rounds end
    when dissolving the open sequences saves none.  Empty input gives an empty table.
    """
    pieces = durable(pieces.withColumn("_key", F.monotonically_increasing_id()))
    placed = [pieces.where(F.col("length") >= length).select("_key", (-F.col("_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items = pieces.where(F.col("length") < length).select("_key", "length")
    form = "_key long, length long, _no long, offset long, open boolean"

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_key")
        no, offset, still = place(rows["length"].to_numpy(), length)
        return pd.DataFrame({"_key": rows["_key"], "length": rows["length"], "_no": (int(rows["_group"].iloc[0]) << 20) + no, "offset": offset, "open": still})

    best, kept, n, number = None, None, items.count(), 0
    while n:
        own = F.pmod(F.xxhash64("_key", F.lit(number)), F.lit(math.ceil(n / group))).alias("_group")
        now = durable(spread(items.select("*", own), ["_group"]).groupBy("_group").applyInPandas(of_group, form))
        now = now.withColumn("sequence_id", F.col("_no") + F.lit(number << 56))
        first = F.col("offset") == 0
        made, n, opened = now.agg(F.count_if(first), F.count_if("open"), F.count_if(first & F.col("open"))).first()
        if best is not None and made >= best:
            break  # the open sequences stay as the round before left them
        placed.append(now.where("not open").select("_key", "sequence_id", "offset"))
        kept, best, number = now.where("open").select("_key", "length", "sequence_id", "offset"), opened, number + 1
        items = kept.select("_key", "length")
    if kept is not None:
        placed.append(kept.select("_key", "sequence_id", "offset"))
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return pieces.join(found, "_key").drop("_key")


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of each sequence from packed rows that hold ``ids``; a sequence has at most as many tokens as it was packed for."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Where every piece of every document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenize(docs))
