from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from granary.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, p, q):
    """component by id, linking all pairs of sets with q |a & b| >= p |a | b|; rows with equal ids are one node."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    shared = Counter((a, b) for ks in where.values() for x, b in enumerate(ks) for a in ks[:x])
    for (a, b), c in shared.items():
        if q * c >= p * (len(sets[a][1]) + len(sets[b][1]) - c):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check(spark, rows, size, threshold):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, size, threshold).collect()
    want = brute(rows, size, threshold.numerator, threshold.denominator)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 3, 85, 100)
    got = neardup.op4_odd_sketch_neardup(spark, small).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, 3)) for i, t in rows}


def test_chains_stars_and_borders(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, ident = [], iter(rng.sample(range(1000), 400))
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        rows.append((next(ident), " ".join(base)))
        text = list(base)
        for _ in range(12):  # a chain that drifts away, and copies of the base
            text[rng.randrange(len(text))] = word()
            rows.append((next(ident), " ".join(text)))
            near = list(base)
            near[rng.randrange(len(near))] = word()
            rows.append((next(ident), " ".join(near).upper()))
            rows.append((next(ident), " ".join(base)))
    check(spark, rows, 3, Fraction(85, 100))
    check(spark, rows, 5, Fraction(4, 5))


def test_exactly_at_the_threshold(spark):
    base = [f"w{i}" for i in range(19)]  # 17 shingles of 3; 17/20 with three more
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x", "y", "z"])), (3, " ".join([*base, "p", "q", "r", "s"]))]
    got = {r["doc_id"]: r["component_id"] for r in check(spark, rows, 3, Fraction(85, 100))}
    assert got == {1: 1, 2: 1, 3: 3}


def test_cases(spark, odd, nothing):
    out = neardup.near_duplicates(odd, 3, Fraction(85, 100)).collect()
    assert len(out) == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in out}
    assert by[2, 7] == (1, False) and by[1, 7] == (1, True) and by[3, 0] == (3, True) and by[4, 0] == (4, True)
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert neardup.near_duplicates(nothing, 3).count() == 0
    kept = neardup.unique_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 2").count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "k")] * 5 + [(4, a, None), (2, b, "k"), (2, c, "k"), (None, a, "k"), (None, d, "x"), (None, d, "y"), (None, d + " more", "z"), (None, None, "n"), (None, None, "n"), (None, "", "e"), (7, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = neardup.unique_documents(docs)
    out = got.collect()
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 2, 7]
    nameless = [r["text"] for r in out if r["doc_id"] is None]
    assert len(nameless) == 3 and None in nameless and "" in nameless and {d, d + " more"} & set(nameless)


def test_ids_with_several_texts_join_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    check(spark, [(1, a), (1, b), (5, b), (7, a), (9, "alone here now")], 3, Fraction(85, 100))


def test_large_buckets_are_tiled(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(neardup, "TILE", 7)
    check(spark, rows, 3, Fraction(85, 100))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    signer = neardup.Signer(Fraction(85, 100))
    most = neardup.most_different_bits(Fraction(85, 100), signer.samples)
    for _ in range(40):
        common = rng.integers(0, 1 << 63, 850, np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 75, np.uint64)]) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        sx, sy = (np.frombuffer(signer.sign(s)[1], np.uint8) for s in (x, y))
        assert np.bitwise_count(sx ^ sy).sum() <= most
    far = [np.frombuffer(signer.sign(rng.integers(0, 1 << 63, 500, np.uint64))[1], np.uint8) for _ in range(2)]
    assert np.bitwise_count(far[0] ^ far[1]).sum() < neardup.SKETCH_BITS / 2


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(1, 500), (500, 300), (300, 1)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 1: 1, 500: 1, 300: 1}
    none = spark.createDataFrame([], "a long, b long")
    assert neardup.components(none).select(F.count("*")).first()[0] == 0
