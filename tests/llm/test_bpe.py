"""Merge replay against the public tokeniser library."""

from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from statewell.llm import bpe, catalog
from statewell.llm.base import table

SF = "/root/testdata/sf0.001"
PATH = bpe.vocabulary_path()
RANKS = bpe.read_ranks(PATH)
TOKENS = {r: t for t, r in RANKS.items()}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    encoder = bpe.Encoder(RANKS)
    numbers = encoder.numbers(text)
    encoder.settle()
    return [int(t) for w in numbers for t in encoder.ids[w].split()]


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_every_space_and_control_character():
    odd = [chr(c) for c in [*range(0, 0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x180E]]
    for c in odd:
        for text in (c, f"a{c}b", f"{c}{c}x", f" {c} ", f"1{c}\n{c}2"):
            assert ids_of(text) == LIBRARY.encode_ordinary(text), repr(text)


def test_merges_of_small_vocabularies():
    """Random ranks, where a merge can bring up a pair of lower rank, against the library's own order of merges."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        ranks = {bytes((i,)): i for i in range(256)}
        for _ in range(40):
            token = bytes(rng.choice([97, 98, 99], rng.integers(2, 6)).tolist())
            ranks.setdefault(token, len(ranks))
        library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        tokens = {r: t for t, r in ranks.items()}
        words = [bytes(rng.choice([97, 98, 99], rng.integers(1, 30)).tolist()) for _ in range(50)]
        got = bpe.replay([w for w in words if w not in ranks], ranks, tokens)
        assert got == [library.encode_ordinary(w.decode()) for w in words if w not in ranks]


def test_query_by_the_library(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = catalog.op12_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(text.encode()).hexdigest()


TEXTS = [None, "", " ", "a", "It's  fine\n\n", "x" * 50_000, "wörd " * 300_000, "日本語 " * 10, "\u0000", "a", "a"]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "KEPT_WORDS", block)
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, ids int, n_tokens int").repartition(2)
    plain = bpe.encode(frame, PATH, digests=False)
    rows = plain.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["row"]["doc_id"]] or ""
        assert r["ids"] == LIBRARY.encode_ordinary(text) and r["n_tokens"] == len(r["ids"]) and bytes(r["decoded"]) == text.encode()
    back = bpe.decode(plain.select("row.doc_id", "ids"), PATH).collect()
    assert all(bytes(r["text_bytes"]) == (TEXTS[r["doc_id"]] or "").encode() for r in back)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
