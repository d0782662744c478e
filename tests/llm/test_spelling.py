"""Spelling variants against brute force."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import spelling

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_words(docs):
    out = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            out[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return out


def brute_variants(words):
    """Near words by trying every edit over the letters that occur."""
    letters = sorted(set("".join(words)))

    def near(w):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return (edits - {w}) & words.keys()

    found = {w: near(w) for w in words}
    form = {w: b for w in words if found[w] and words[b := min(found[w], key=lambda x: (-words[x], x))] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(found[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def test_query_equals_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in brute_words(docs).items() if n >= 3 and len(w) >= 5}
    got = [tuple(r) for r in spelling.op12_aho_halves(spark, small).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(words) > 1000 and set(got) == brute_variants(words)
    assert any(r[3] for r in got)


@pytest.mark.parametrize(("shard", "split"), [(20_000, 40_000), (7, 5), (3, 2)])
def test_dense_words_and_hot_halves(spark, shard, split):
    """Short words over three letters, most halves hot: every pair once, also where halves are split into a grid."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), n)): int(rng.integers(1, 60)) for n in rng.integers(1, 8, 400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_variants(df, shard_words=shard, split=split)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute_variants(words) and got.count() == len(words)


def test_long_chains_of_forms(spark):
    chain = [("a" * k, 4**k) for k in range(5, 25)]
    got = {r["word"]: r["root"] for r in spelling.spelling_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 24}


def test_ties_go_to_the_smaller_word(spark):
    rows = [("blame", 3), ("flame", 3), ("slame", 1), ("\u00e9lame", 3), ("plain", 9)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["slame"]["form"], got["slame"]["form_n"], got["slame"]["n_near"]) == ("blame", 3, 3)
    assert got["blame"]["form"] is None and got["blame"]["root"] == "blame" and got["plain"]["n_near"] == 0


def test_odd_tables(spark, odd, nothing):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in spelling.corpus_words(odd.withColumn("run", F.lit("x")).withColumn("word", F.lit("y"))).collect()}
    assert got == {w: n for w, n in brute_words(docs).items()}
    assert spelling.spelling_variants(spelling.frequent_words(nothing)).count() == 0
    long = "q" * 70_000
    both = spelling.spelling_variants(spark.createDataFrame([(long, 5), (long[1:], 2)], "word string, n long")).collect()
    assert {r["n_near"] for r in both} == {1} and {len(r["root"]) for r in both} == {70_000}


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "ab") and spelling.one_edit("bc", "abc")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("a", "abc")
