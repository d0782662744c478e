"""Placebo partners and subspaces against brute force; converters on planted layouts."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.hashing import hash_rank_key
from granary.operators import controls as C
from granary.operators import converters as V


@pytest.mark.parametrize("seed", range(3))
def test_placebo_is_a_derangement_of_problems(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{rng.integers(4)}", f"p{rng.integers(6)}", i, int(rng.random() < 0.4)) for i in range(150)] + [("lone", "p0", 900 + i, i % 2) for i in range(5)] + [("lone", "p1", 950, 1), ("single", "p", 999, 1)]
    df = spark.createDataFrame(rows, "stratum string, problem string, node long, target int")
    got = C.placebo_partners(df, "stratum", "problem", "node", hash_rank_key("k", F.col("problem"))).collect()
    of = {r[2]: r for r in rows}
    assert len(got) == len(rows)
    for stratum in {r[0] for r in rows}:
        mine = [r for r in got if r["stratum"] == stratum]
        sizes = Counter(r["problem"] for r in mine)
        if 2 * max(sizes.values()) > len(mine):
            assert all(r["partner"] is None for r in mine)
            continue
        assert sorted(r["partner"] for r in mine) == sorted(r["node"] for r in mine)
        assert all(of[r["partner"]][1] != r["problem"] and of[r["partner"]][0] == stratum for r in mine)
        assert sum(of[r["partner"]][3] for r in mine) == sum(r["target"] for r in mine)
    assert {r["stratum"] for r in got if r["partner"] is None} >= {"lone", "single"}


def test_subspaces_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(y, (rng.normal(size=6) * np.array([9, 5, 3, 2, 1, 0.5]))[[(k + y) % 6 for k in range(6)]].tolist()) for y in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "label int, embedding array<double>").repartition(5)
    got = {(r["label"], r["r"]): (r["cosine"], r["similarity"], r["captured"]) for r in C.label_against_rest(df, "label", "embedding", 4).collect()}
    assert len(got) == 12
    for y in range(3):
        a, b = (np.array([x for k, x in rows if (k == y) is same]) for same in (True, False))
        u, v = (np.linalg.svd(m, full_matrices=False)[2][:4].T for m in (a, b))
        cosines = np.linalg.svd(u.T @ v, compute_uv=False)
        for r in range(1, 5):
            want = (cosines[r - 1], np.linalg.norm(u[:, :r].T @ v[:, :r]) ** 2 / r, np.linalg.norm(b @ u[:, :r]) ** 2 / np.linalg.norm(b) ** 2)
            assert got[y, r] == pytest.approx(want, abs=2e-6)
    same = C.compared(np.diag([4.0, 1.0, 0.0]), np.diag([4.0, 1.0, 0.0]), 3)
    assert [(r, round(c, 9), round(s, 9)) for r, c, s, _ in same] == [(1, 1, 1), (2, 1, 1)] and same[-1][3] == pytest.approx(1)


PLANTED = [
    ("listed", {"id": "a", "q": " Which? ", "choices": ["x", "y"], "answer": 1}, ("a", "Which?", "y", None)),
    ("listed", {"id": 7, "q": "Which?", "choices": ["x", "y"], "answer": "0"}, ("7", "Which?", "x", None)),
    ("listed", {"id": "a", "q": "Which?", "choices": ["x", "x"], "answer": 0}, (None, None, None, "options")),
    ("listed", {"id": "a", "q": "Which?", "choices": "x", "answer": 0}, (None, None, None, "options")),
    ("listed", {"id": "a", "q": "Which?", "choices": ["x", "y"], "answer": 2}, (None, None, None, "gold")),
    ("keyed", {"meta": {"key": "k"}, "item": {"stem": "S", "options": [{"label": "1", "text": "u"}, {"label": "2", "text": "v"}]}, "answerKey": "2"}, ("k", "S", "v", None)),
    ("keyed", {"meta": {}, "item": {"stem": "S", "options": []}, "answerKey": "2"}, (None, None, None, "id")),
    ("weighed", {"uid": "w", "prompt": "P", "candidates": {"b": 0.5, "a": 0.5, "c": 0}}, ("w", "P", "a", None)),
    ("weighed", {"uid": "w", "prompt": "", "candidates": {"b": 0.5, "a": 0.5}}, (None, None, None, "question")),
    ("unheard", {"id": "a"}, (None, None, None, "layout")),
    (None, {"id": "a"}, (None, None, None, "layout")),
]


def test_planted_layouts(spark):
    rows = [(i, layout, json.dumps(doc)) for i, (layout, doc, _) in enumerate(PLANTED)] + [(50, "listed", "{"), (51, "listed", None)]
    got = {r["line"]: r for r in V.converted(spark.createDataFrame(rows, "line long, layout string, json string")).collect()}
    for i, (_, _, (item, question, gold, reject)) in enumerate(PLANTED):
        r = got[i]
        assert (r["item_id"], r["question"], r["reject"]) == (item, question, reject)
        assert (dict(zip(r["labels"], r["options"], strict=True))[r["gold_label"]] if r["gold_label"] else None) == gold
    assert got[50]["reject"] == got[51]["reject"] == "not_json" and len(got) == len(rows)
