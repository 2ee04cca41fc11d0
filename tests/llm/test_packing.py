"""Packing against the tokenizer on whole texts, the layout of sequences and the least possible number of them."""

import math
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwise.llm import packing
from gapwise.llm.common import table

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WHOLE.encode_special_tokens = True


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def laid_out(rows, length=2048):
    """Rows of one sequence touch without gaps from 0, none is longer than ``length``."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = packing.pack_documents(docs).collect()
    made = laid_out(rows)
    want = []
    for d in docs.collect():
        ids = ids_of(d["text"])
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((d["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    least = math.ceil(sum(r["length"] for r in rows) / 2048)
    assert made <= 1.01 * least + 1


ODD = ["The CAT's 3.14, don't!?", "ÉTÉ. été, Àà: ÷. ×, ß. ŉ.", "<|endoftext|> a\x85b\x1fc d e.", "é. ́ x", "ΑΣ. ΑΣΑ, İ. ﬁ ①", "\x00.\x01,", "a.. b.,c ;;; 1,2.3:4", "\r\n\t .", "日本語。テキスト, 한국어.", "x" * 5000 + ".", "🙂. 🙂,🙂"]


def test_words_give_the_ids_of_whole_texts():
    words = packing.Words("word_bpe_49k.json")
    for text in [*ODD, *(a + b + c for a, b, c in product(["a", "É", "é", "ß", "÷", "1", "'", "́", ".", "('"], [".", ",", "!?", " ", "'", "(", "'re"], ["s", "'s", "́", "É", "ÿ", "", ".", "7"]))]:
        assert np.frombuffer(next(words.ids(pa.array([text]))), "<u4").tolist() == ids_of(text)[:-1], repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_give_the_ids_of_any_text(text):
    words = packing._words("word_bpe_49k.json")
    assert np.frombuffer(next(words.ids(pa.array([text]))), "<u4").tolist() == ids_of(text)[:-1]


def test_place_takes_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(30):
        length = int(rng.integers(3, 40))
        sizes = rng.integers(1, length, int(rng.integers(0, 60)))
        no, offset, still = packing.place(sizes, length)
        gaps = {}
        for i in np.argsort(-sizes, kind="stable"):
            old = gaps.get(no[i], length)
            assert offset[i] == length - old and old >= sizes[i]

            def total(change):
                now = {**gaps, **change}
                counts = np.bincount([g for g in now.values() if g], minlength=length + 1)
                return int((counts**2).sum())

            options = [total({k: g - sizes[i]}) for k, g in gaps.items() if g >= sizes[i]] + [total({"new": length - sizes[i]})]
            gaps[no[i]] = old - sizes[i]
            assert total({}) == min(options)
        assert all(bool(s) == (gaps[k] > 0) for s, k in zip(still, no))


@pytest.mark.parametrize("group", [7, 40, 50_000])
def test_groups_and_rounds(spark, group):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 2049, 300)] + [2048, 2048, 1]
    rows = packing.pack(spark.createDataFrame([(s,) for s in sizes], "length long"), group=group).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes)
    assert laid_out(rows) <= {7: 1.3, 40: 1.15}.get(group, 1.05) * math.ceil(sum(sizes) / 2048)


def test_odd_documents_and_sequences(spark):
    texts = [None, "", *ODD, *["same words here"] * 50]
    docs = spark.createDataFrame([(None if i % 9 == 0 else i % 5, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    packed = packing.pack(packing.tokenize(docs, length=64, keep_ids=True), length=64)
    rows = packed.collect()
    laid_out(rows, 64)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) for t in texts)
    assert sum(r["length"] == 1 for r in rows if r["start"] == 0) == 2  # null and empty
    made = packing.sequences(packed).withColumn("n", F.size("ids")).collect()
    assert all(r["n"] <= 64 for r in made) and sum(r["n"] for r in made) == sum(r["length"] for r in rows)
    by = {r["sequence_id"]: r["ids"] for r in made}
    assert all(by[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
