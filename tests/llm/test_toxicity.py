"""The toxicity grammar: its transducers on written sentences, learning against plain counts, held-out accuracy, odd tables."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from granary.llm import toxicity

LEXICON = toxicity.Lexicon([("fool", False, 3.0), ("scoundr", True, 2.0), ("scoundry", False, 0.0)])


@pytest.mark.parametrize(
    ("text", "plain", "aimed", "negated", "reported", "threat"),
    [
        ("what a fool", 3, 0, 0, 0, 0),
        ("you are a fool", 0, 3, 0, 0, 0),
        ("Fool that you are", 0, 3, 0, 0, 0),
        ("a fool. you there", 3, 0, 0, 0, 0),
        ("he is not a fool", 0, 0, 3, 0, 0),
        ("not at all, a fool", 3, 0, 0, 0, 0),
        ("they said he was a FOOL", 0, 0, 0, 3, 0),
        ("they said so. what a fool", 3, 0, 0, 0, 0),
        ('the sign "fool" fell', 0, 0, 0, 3, 0),
        ("I will hurt you", 0, 0, 0, 0, 2),
        ("I will not hurt you", 0, 0, 0, 0, 0),
        ("hurt, you see", 0, 0, 0, 0, 0),
        ("some scoundrel and a scoundr", 2, 0, 0, 0, 0),
        ("scoundry", 0, 0, 0, 0, 0),
        ("a foolish thing", 0, 0, 0, 0, 0),
        ("du Fool, nicht fool fool", 0, 3, 6, 0, 0),
    ],
)
def test_clauses(text, plain, aimed, negated, reported, threat):
    assert toxicity.Reader(LEXICON).matches(text)[0] == [plain, aimed, negated, reported, threat]


def test_composition_equals_parts_side_by_side():
    """The composed table against the five transducers run one beside the other on random symbols."""
    rng = np.random.default_rng(0)
    nxt, says = toxicity.compose()
    for _ in range(200):
        state, parts = 0, dict.fromkeys(toxicity.PARTS, 0)
        for x in rng.integers(0, 9, 40).tolist():
            on = {}
            for name, (_, step) in toxicity.PARTS.items():
                parts[name], on[name] = step(parts[name], x)
            quiet = 4 if on["report"] else 3 if on["negation"] else 0
            if x == toxicity.INSULT:
                want = quiet or (2 if on["target"] else 1)
            elif quiet:
                want = 0
            else:
                want = toxicity.THREAT if on["threat"] else toxicity.TURNS if on["insult"] else 0
            assert says[state][x] == want
            state = nxt[state][x]


def test_automaton_takes_the_longest_entry():
    lex = toxicity.Lexicon([("ab", True, 1.0), ("abcd", True, 2.0), ("abce", False, 0.5), ("x", False, 9.0)])
    want = {"ab": 0, "abc": 1, "abcd": 1, "abcde": 2, "abce": 0.5, "abcex": 1, "x": 9, "xy": 0, "": 0, "zz": 0}
    assert {w: lex.weight(w) for w in want} == want
    assert toxicity.Lexicon([]).weight("word") == 0


def test_word_counts_equal_plain_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sample, counts = toxicity.labelled_sample(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = sample.collect()
    assert sum(counts) == len(rows) > 10 and all(crc32(str(r["id"]).encode()) % 5 for r in rows)
    want = Counter()
    for r in rows:
        for w in {t.lower().replace("\u2019", "'") for t in toxicity.TOKEN.findall(r["text"] or "") if t[0].isalpha()}:
            want[w, r["label"]] += 1
    got = {(r["word"], k): r[c] for r in toxicity.word_counts(sample).collect() for k, c in ((0, "neg"), (1, "pos")) if r[c]}
    assert got == dict(want)


def test_words_and_stems_are_learnt(spark):
    """Planted: one toxic word, one stem with many forms of which clean texts use two, a frequent clean word that is part of neither."""
    rng = np.random.default_rng(6)
    base = [f"{a}{b}" for a in "klmnprst" for b in ("alo", "emi", "otu", "ira")]
    ends = ["ing", "ed", "er", "ous", "ify", "al", "ness", "ion", "ward", "ly"]
    rows, labels = [], []
    for i in range(1, 901):
        text = rng.choice(base, 40).tolist()
        toxic = i % 9 == 0
        if toxic:
            text[5] = "grobnik"
            text[11], text[20] = (f"zarv{rng.choice(ends)}" for _ in range(2))
        elif i % 4 == 0:
            text[7] = "zarvward"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    lex = model.lexicon
    assert lex.weight("grobnik") > 3 and lex.weight("zarvable") > 2 and lex.weight("zarvward") < 1 and lex.weight("kalo") == 0 and lex.weight("grobnika") == 0
    assert [e[0] for e in lex.entries if e[1]] == ["zarv"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)


def test_fit_is_the_optimum():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((300, 1)), rng.normal(size=(300, 8))], 1)
    y, weigh = (rng.random(300) < 0.3).astype(float), rng.random(300) + 0.5
    w = toxicity.fit_scores(x, y, weigh)

    def loss(v):
        z = x @ v
        return (weigh * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * toxicity.PRIOR_STRENGTH * 300 * ((v - toxicity.PRIOR) ** 2).sum()

    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=9)) for _ in range(200))


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op11_toxic_grammar(spark, folder).collect()}
    assert len(got) == docs.count() and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def test_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    out = toxicity.score(odd, model, ["doc_id", "score", "_key"]).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4)}) == 1
    none = toxicity.learn(odd, labels.where("doc_id = 98"))
    assert {r["score"] for r in toxicity.score(odd, none, ["doc_id"]).collect()} == {0.5}
    one = toxicity.learn(odd, labels.where("doc_id = 1"))
    assert all(math.isclose(r["score"], 2 / 3) for r in toxicity.score(odd, one, ["doc_id"]).collect())
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 300)] + [(1, "other"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)] + [(1000, 1)], "doc_id long, toxic int")
    sample, counts = toxicity.labelled_sample(docs, labels, 20)
    rows = sample.collect()
    assert Counter(r["label"] for r in rows) == {0: 20, 1: 20} and len({r["id"] for r in rows}) == 40 and sum(counts) > 200
