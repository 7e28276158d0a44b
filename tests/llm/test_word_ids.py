"""Ids of whole texts by distinct words, against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import packing

POOL = ["a", "Foo", "foo,", "BAR.", "x!", "|", "a|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>,", ",", "..", "don't", "it's,", "É", "é,",
        "ΑΣ", "Σ.", "ǅ", "İ", "12,", "3.5", "\t", "\x1c", "\x0b", "\x85", " ", "　", "日本語。", "_a", "A-B",
        "''s", "‍", "\U0001f600", "K", "zz|", "Q!Q!Q!", "x" * 70, "ͅ", "à́", "\x00"]


@pytest.fixture(scope="module")
def ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


def test_batches_equal_the_library(ids):
    rnd = random.Random(5)
    texts = ["", " ", *("".join(rnd.choice(POOL) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(1, 25))) for _ in range(2000))]
    for _ in range(2):  # the second time from the memo
        for text, got in zip(texts, ids.batch(pa.array(texts)), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids.library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert ids.batch(pa.array([None, ""], pa.string())) == [b"", b""] and ids.batch(pa.array([], pa.string())) == []


def test_words_laid_out_in_parts(ids, monkeypatch):
    texts = pa.array(["one two, three", None, "", "two THREE four. five", "six"])
    whole = ids.batch(texts)
    monkeypatch.setattr(packing, "WORDS", 2)
    assert ids.batch(texts) == whole


def test_portions_hold_every_row():
    batch = pa.record_batch([pa.array(["a" * 9, None, "b", "c" * 30, "", "é" * 5])], ["text"])
    got = list(packing.portions(batch, "text", 10))
    assert [len(p) for p in got] == [3, 1, 2] and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
