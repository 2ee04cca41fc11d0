"""Quality rules on repetition inside a text, by a suffix array over its words.

The suffixes of a text that start with a window of ``MIN_REPEAT`` words found twice are sorted by prefix doubling: ranks of runs
of 1, 2, 4, ... words.  The longest common prefix of two neighbours in the array follows from the same ranks, from the longest run
down.  A suffix's longest repeated prefix is the larger value of its two neighbours; the union of these spans is what maximal
repeated substrings cover.  A text is rejected if too large a part is covered or the longest repeat is too long.

Texts of a batch are ranked together (they never mix: a rank is only compared inside its text), so that numpy's cost per call is
spread over many texts.  All of it runs where the text is: no shuffle, memory bound by one batch or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import in_pieces

WINDOW = 5
#: shortest repeat that counts, in words; longer than the base rule's window, or the covered words would be that rule's
MIN_REPEAT = 10
#: most a text may be covered by repeats (below the base rule's part, which no longer repeats reach), and the longest repeat allowed in words
MAX_COVERED, MAX_LONGEST = 0.1, 50
#: fixed: characters that count as symbols
SYMBOLS = "#*$%&|<>"
#: words ranked together
BATCH_WORDS = 200_000


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, in their order."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _ahead(rank: np.ndarray, by: int, end: np.ndarray) -> np.ndarray:
    """1 + rank ``by`` words further on, 0 past the end of the text."""
    at = np.arange(len(rank)) + by
    return np.where(at < end, rank[np.minimum(at, len(rank) - 1)] + 1, 0)


def measure(texts: list[list[str]], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text (its words): words in windows of five found twice, words covered by repeats, longest repeat."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(owner)
    if not n:
        none = np.zeros(len(texts), np.int64)
        return none, none.copy(), none.copy()
    ids: dict[str, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, n)
    end = np.cumsum(sizes)[owner]
    place = np.arange(n)

    def run_of(length: int) -> np.ndarray:
        """Ranks of runs of ``length`` words (5 = 4 + 1)."""
        rank, done = one, 1
        while done < length:
            step = min(done, length - done)
            rank, done = _pairs(rank, _ahead(rank if step == done else one, done, end)), done + step
        return rank

    def twice(rank: np.ndarray, length: int) -> np.ndarray:
        """Starts of whole runs that occur again in the same text."""
        whole = np.flatnonzero(place + length <= end)
        _, inverse, count = np.unique(owner[whole] * (rank.max() + 1) + rank[whole], return_inverse=True, return_counts=True)
        return whole[count[inverse] > 1]

    def covered(starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Words per text inside the spans."""
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + lengths, -1)
        return np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=len(texts))

    window = twice(run_of(WINDOW), WINDOW)
    repeat_words = covered(window, WINDOW)
    start = window if min_repeat == WINDOW else twice(run_of(min_repeat), min_repeat)
    longest = np.zeros(len(texts), np.int64)
    if not len(start):
        return repeat_words, np.zeros(len(texts), np.int64), longest

    # prefix doubling over all words of the texts that repeat something; others are done
    busy = np.zeros(len(texts), bool)
    busy[owner[start]] = True
    keep = np.flatnonzero(busy[owner])
    back = np.full(n, -1, np.int64)
    back[keep] = np.arange(len(keep))
    end = np.cumsum(np.bincount(owner[keep], minlength=len(texts)))[owner[keep]]
    at, who = back[start], owner[keep]
    rank = np.unique(one[keep], return_inverse=True)[1].astype(np.int64)
    levels, length = [rank], 1
    while True:
        key = who[at] * (rank.max() + 1) + rank[at]
        if len(np.unique(key)) == len(at):
            break
        rank = _pairs(rank, _ahead(rank, length, end))
        length *= 2
        levels.append(rank)
    order = np.lexsort((rank[at], who[at]))
    a, b = at[order][:-1], at[order][1:]
    same = who[a] == who[b]
    x, y, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        by, r = 1 << level, levels[level]
        fits = same & (np.maximum(x, y) + by <= end[a])
        hit = np.flatnonzero(fits)
        hit = hit[r[x[hit]] == r[y[hit]]]
        x[hit] += by
        y[hit] += by
        common[hit] += by
    best = np.zeros(len(at), np.int64)
    best[1:] = common
    np.maximum(best[:-1], common, out=best[:-1])
    best[best < min_repeat] = 0
    starts = keep[at[order]]
    np.maximum.at(longest, owner[starts], best)
    has = best > 0
    return repeat_words, covered(starts[has], best[has]), longest


def _line_counts(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _words(text: str | None) -> list[str]:
    """Runs of characters other than ASCII white space."""
    return [w.decode() for w in (text or "").encode().split()]


def rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """One row per row: id, counts, ``base_failed``, ``kept``, ``n_covered_words``, ``longest_repeat``.

    A text fails the base rules with fewer than 10 words or more than 20 % of them in windows of five that occur twice.  Of
    the others it is kept unless repeats of ``min_repeat`` words or more cover more than ``max_covered`` of its words, or the longest
    repeat has more than ``max_longest`` words, however long the text is.  Null and blank texts have no words and
    fail.  Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        symbols = SYMBOLS.encode()
        for b in in_pieces(batches):
            rows = [np.zeros(b.num_rows, np.int64) for _ in counts]
            held: list[list[str]] = []
            first = total = 0
            texts = b.column(1).to_pylist()
            for i, text in enumerate(texts):
                words, raw = _words(text), (text or "").encode()
                rows[0][i], rows[1][i] = len(words), sum(map(len, words))
                rows[2][i] = len(raw) - len(raw.translate(None, symbols))
                rows[3][i] = _line_counts(text or "")
                held.append(words)
                total += len(words)
                if total >= BATCH_WORDS or i == len(texts) - 1:
                    for k, x in enumerate(measure(held, min_repeat)):
                        rows[4 + k][first : i + 1] = x
                    held, first, total = [], i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows)], ["id", *counts])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in counts))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    covered = F.col("n_covered_words") > F.lit(max_covered) * F.col("n_words")
    long = F.col("longest_repeat") > max_longest
    return out.select(
        F.col("id").alias(id_col), *counts[:5], failed.alias("base_failed"), (~failed & ~covered & ~long).alias("kept"), *counts[5:],
    )

