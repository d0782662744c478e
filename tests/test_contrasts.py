"""Opposites, their edits and edits of relations, on planted statements and against plain loops."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import contrasts as C

TEXTS = [
    "The hot soup. The cold soup! A hot day\nA cold day? Some hot tea. Some cold tea",  # three frames with two words each
    "An old road. A young road. The old tree. The young tree",  # two words in one frame each of two
    "The big house. The small house. The tiny house. one big door. one small door",  # "the _ house" has three words
    None,
    "",
    "...",
]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_opposites_by_hand(spark):
    got = {tuple(r) for r in C.opposites(C.statements(frame(spark, TEXTS))).collect()}
    assert got == {("hot", "cold", 3), ("cold", "hot", 3)}
    got = {(r["word"], r["opposite"]) for r in C.opposites(C.statements(frame(spark, TEXTS)), 1).collect()}
    assert got == {("hot", "cold"), ("cold", "hot"), ("old", "young"), ("young", "old"), ("big", "small"), ("small", "big")}


def plain_opposites(statements, least):
    fills = defaultdict(set)
    for w in statements:
        for l, m, r in zip(w, w[1:], w[2:]):
            if len(m) >= 3 and m.isalpha():
                fills[l, r].add(m)
    n = Counter(tuple(sorted(x)) for x in fills.values() if len(x) == 2)
    rivals = defaultdict(dict)
    for (a, b), k in n.items():
        if k >= least:
            rivals[a][b] = rivals[b][a] = k
    best = {a: min(r, key=lambda b: (-r[b], b)) for a, r in rivals.items()}
    return {(a, b, rivals[a][b]) for a, b in best.items() if best[b] == a}


@pytest.mark.parametrize("seed", range(3))
def test_opposites_equal_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["red", "blue", "high", "low", "x", "yy", "7th", "warm", "cool"]
    said = [[str(x) for x in rng.choice(words, int(rng.integers(1, 8)))] for _ in range(150)]
    df = frame(spark, [". ".join(" ".join(w) for w in said[i : i + 5]) for i in range(0, 150, 5)])
    for least in (1, 2):
        want = plain_opposites(said, least)
        assert want and {tuple(r) for r in C.opposites(C.statements(df), least).collect()} == want


def test_two_fill(spark):
    """The sums tell two values from one and from more, also where one of their parts is the same."""
    rng = np.random.default_rng(9)
    pool = [int(x) for x in rng.integers(-(2**63), 2**63, 12)] + [5, 6, 5 + (1 << 60), 6 + (1 << 60), -1, 0, 2**63 - 1, -(2**63)]
    rows = [(g, h) for g in range(400) for h in rng.choice(np.array(pool, dtype=np.int64), int(rng.integers(1, 4))) for h in [int(h)] * int(rng.integers(1, 9))]
    h = F.col("h")
    sums = spark.createDataFrame(rows, "g int, h long").groupBy("g").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"), F.sum(C.low_part(h)).alias("low"), F.sum(C.high_part(h)).alias("high"))
    got = {r["g"] for r in sums.where(C.two_fill(*[F.col(c) for c in ("a", "b", "n", "low", "high")])).collect()}
    values = defaultdict(set)
    for g, x in rows:
        values[g].add(x)
    assert got == {g for g, v in values.items() if len(v) == 2}


@pytest.mark.parametrize("repeat", [1, 50])
def test_opposite_edits(spark, repeat):
    claims = ["An old cat saw a hot stove. Hot or cold, who knows?", "The hot soup", "It was hot"] * repeat + [None, ""]
    table = spark.createDataFrame([("hot", "icy"), ("icy", "hot"), ("cold", "warm"), ("old", "young")], "word string, opposite string")
    got = {tuple(r) for r in C.opposite_edits(C.statements(frame(spark, claims)), table, C.statements(frame(spark, ["the  ICY soup!"]))).collect()}
    assert got == {
        ("an old cat saw a hot stove", repeat, 2, "old", "young", "a young cat saw a hot stove"),
        ("an old cat saw a hot stove", repeat, 6, "hot", "icy", "an old cat saw an icy stove"),
        ("hot or cold who knows", repeat, 1, "hot", "icy", "icy or cold who knows"),
        ("hot or cold who knows", repeat, 3, "cold", "warm", "hot or warm who knows"),
        ("it was hot", repeat, 3, "hot", "icy", "it was icy"),  # "the icy soup" is stated
    }
    both = spark.createDataFrame([("hot", "cold"), ("cold", "hot")], "word string, opposite string")
    none = C.opposite_edits(C.statements(frame(spark, ["hot or cold"])), both, C.statements(frame(spark, [])))
    assert none.count() == 0


def test_relations_by_hand(spark):
    rows = ["A whale is an animal", "Whales are mammals that swim. Is it so?", "nothing here", "It was", "Cats were a joy", None]
    got = {tuple(r) for r in C.relations(C.statements(frame(spark, rows))).collect()}
    assert got == {("a whale", "is an", "animal", "is a"), ("whales", "are", "mammals that swim", "is"), ("cats", "were a", "joy", "was a")}


def test_relation_edits(spark):
    claims = ["A whale is an animal. An oak is a tree. A daisy is a flower", "Ice is cold. Fire is hot", "Iron was new. Iron was new"]
    # Two reversals are stated, one of them without its article.
    stated = C.statements(frame(spark, [*claims, "Cold is ice", "animal is a whale"]))
    rows = C.relation_edits_of(C.statements(frame(spark, claims)), stated).collect()
    turned = {r["subject"]: r["variant"] for r in rows if r["kind"] == "reverse"}
    assert turned == {
        "an oak": "a tree is an oak",
        "a daisy": "a flower is a daisy",
        "fire": "hot is fire",
        "iron": "new was iron",
    }
    swapped = {r["subject"]: r["variant"] for r in rows if r["kind"] == "swap"}
    assert swapped["ice"] == "ice is hot" and swapped["fire"] == "fire is cold" and "iron" not in swapped
    new = {s: v.split()[-1] for s, v in swapped.items() if s in ("a whale", "an oak", "a daisy")}
    own = {"a whale": "animal", "an oak": "tree", "a daisy": "flower"}
    assert len(new) == 3 and sorted(new.values()) == sorted(own.values()) and all(new[s] != own[s] for s in own)
    assert all(v.split()[-2] == ("an" if v.split()[-1] == "animal" else "a") for s, v in swapped.items() if s in own)


def test_empty_tables(spark):
    none = C.statements(frame(spark, [])).where(F.lit(True))
    assert C.opposites(none).count() == 0
    one = C.statements(frame(spark, ["who is who", "is it", "he is is here", "it is"]))  # sides alike, no subject, two copulas, no object
    assert {(r["subject"], r["variant"]) for r in C.relation_edits_of(one, one).collect()} == {("he", "is here is he")}
    assert C.relation_edits_of(none, none).count() == 0
