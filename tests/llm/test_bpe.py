from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import bpe, vocab

FILE, WORDS = vocab.path(vocab.BYTE_BPE), vocab.path(vocab.WORD_BPE)
BYTE, WORD = Tokenizer.from_file(FILE), Tokenizer.from_file(WORDS)
PARTS = ["a", "b", "'", "re", "'s", "'r", " ", "  ", "\n", "\t", "1", "23", "é", "中", "文字", "<|endoftext|>", "<|startoftext|>", "<|", "!", "...", "\x1c", "́", "²", "👍🏽", "the ", "\x85", "\r\n", "İ", "Σ", "ΑΣ", "K", "THE", "\x01", "\xad", "\xa0"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_joined_chunks_equal_whole_encoding(text):
    old = bpe.LEAST_BYTES, bpe.BITS
    bpe.LEAST_BYTES, bpe.BITS = 3, 2
    try:
        got = bpe.encode_text(text, vocab.byte_encoder(FILE)).tolist()
    finally:
        bpe.LEAST_BYTES, bpe.BITS = old
    want = BYTE.encode(text, add_special_tokens=False).ids
    assert got == want
    assert vocab.byte_encoder(FILE).decode(got).decode(errors="replace") == BYTE.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_encoder_equals_library(text):
    assert np.frombuffer(vocab.word_encoder(WORDS).encode(text), "<u4").tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_long_run_without_splits():
    text = "x" * 5000 + "é" * 3000
    assert bpe.encode_text(text, vocab.byte_encoder(FILE)).tolist() == BYTE.encode(text, add_special_tokens=False).ids


def test_borders_follow_content():
    rng = np.random.default_rng(1)
    passage = rng.integers(32, 127, 20_000, np.uint8).tobytes()
    cut = lambda d: {d[a:b] for a, b in zip([0, *bpe.borders(d)], bpe.borders(d))}  # noqa: B905, E731
    shared = cut(b"one start " + passage) & cut(b"quite another start, longer " + passage)
    assert sum(map(len, shared)) > 0.8 * len(passage)


def row(text):
    ids = BYTE.encode(text or "", add_special_tokens=False).ids
    body = BYTE.decode(ids, skip_special_tokens=False).encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(body).hexdigest()


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_query_equals_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = bpe.op1_chunk_reuse_bpe(spark, small).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r["doc_id"], *row(r["text"])) for r in docs), key=key)


def test_edge_cases(spark, odd, nothing):
    ids = bpe.encode_ids(odd, FILE).cache()
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=key)
    assert sorted((tuple(r) for r in bpe.decode_ids(ids, FILE).collect()), key=key) == want
    assert bpe.encode_ids(nothing, FILE).count() == 0


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 10_000, "é".encode() * 4000])
def test_borders_cover_all(data):
    ends = bpe.borders(data)
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
    for a in ends[:-1]:
        data[:a].decode()
