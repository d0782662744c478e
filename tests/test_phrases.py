"""Vocabulary matching against a plain scan, and heads of defining sentences."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import phrases as P
from tests.test_units import one


def plain_spans(words, vocab, longest):
    out, at = [], 0
    while at < len(words):
        n = next((n for n in range(longest, 1, -1) if at + n <= len(words) and " ".join(words[at : at + n]) in vocab), 0)
        if n:
            out.append((at + 1, n, " ".join(words[at : at + n])))
        at += n or 1
    return out


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_spans_equal_plain_scan(spark, most):
    """With the vocabulary sent to all tasks, and joined by a shuffle."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(list("abcdef"), int(rng.integers(0, 40))))) for i in range(60)] + [(90, None), (91, ""), (92, "of a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["phrase"]: r["n_docs"] for r in P.vocabulary(df, 4, 5).collect()}
    seen = defaultdict(set)
    for i, t in docs:
        w = (t or "").split()
        for n in (2, 3, 4):
            for k in range(len(w) - n + 1):
                seen[" ".join(w[k : k + n])].add(i)
    assert found == {g: len(d) for g, d in seen.items() if len(d) >= 5 and not {g.split()[0], g.split()[-1]} & set(P.FUNCTION_WORDS)}
    got = defaultdict(list)
    for r in P.phrase_spans(df, ["doc_id"], P.vocabulary(df, 4, 5), 4, most).orderBy("doc_id", "at").collect():
        got[r["doc_id"]].append((r["at"], r["n"], r["phrase"]))
    want = {i: s for i, t in docs if (s := plain_spans((t or "").split(), found, 4))}
    assert dict(got) == want and len(want) > 40


def test_no_vocabulary(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert P.phrase_spans(df, ["doc_id"], P.vocabulary(df)).count() == 0


def test_heads(spark):
    cases = {
        "Rome is a large old city in Italy. It was a river.": "city",
        "Acme was one of the oldest companies": "companie",
        "They are tall trees": "tree",
        "This is for you": None,
        "He ran. Rome is a city.": None,
        "": None,
        "It is": None,
    }
    assert {t: one(spark, P.defined_head(F.lit(t))) for t in cases} == cases
    assert one(spark, P.defined_head(F.lit(None).cast("string"))) is None
