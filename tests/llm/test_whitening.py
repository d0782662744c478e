"""Exact whitening against fractions, on extreme numbers and odd tables."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import whitening


def exact(rows):
    """(n, S, n*X'X - S S') of lists of whole numbers."""
    n, width = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(width)]
    return n, s, [[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(width)] for i in range(width)]


def test_query_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    rows = {r["vec_id"]: [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in table}
    n, s, m = exact(list(rows.values()))
    cov = np.array([[float(Fraction(v, n * n)) for v in line] for line in m])
    values, vectors = np.linalg.eigh(cov)
    got = whitening.op13_exact_whitening(spark, small).collect()
    assert len(got) == 32 * len(rows)
    white = np.zeros((len(rows), 32))
    at = {i: k for k, i in enumerate(rows)}
    for r in got:
        x, c = rows[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert r["explained"] == pytest.approx(values[-1 - c] / cov.trace(), rel=1e-9) and r["identity_error"] < 1e-9
        white[at[r["vec_id"]], c] = r["whitened"]
    want = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)] for x in rows.values()]) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-7)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize("far", [1, 1 << 30, 1 << 40, (1 << 61) + 12345, (1 << 62) + 7])
def test_scatter_is_exact_at_any_size(far):
    rng = np.random.default_rng(1)
    x = (rng.integers(-50, 50, (30, 4)).astype(object) * (far // 50 + 1)).clip(-(1 << 63), (1 << 63) - 1).astype(np.int64)
    for shift in (0, 1_000_000, -3):
        s, p = whitening.scatter(x, shift)
        rows = [[int(v) - shift for v in r] for r in x]
        assert s.tolist() == [sum(c) for c in zip(*rows, strict=True)]
        assert p.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]


def test_totals_over_partitions_and_shifts(spark):
    rng = np.random.default_rng(2)
    rows = [[float(v) for v in rng.normal(size=3) * 10 ** float(rng.integers(0, 9))] for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "embedding array<double>").repartition(7)
    whole = [[int(np.floor(64 * v)) + 1_000_000 for v in r] for r in rows]
    for shift in (0, 1_000_000, 12345):
        n, s, p = whitening.totals(df, 3, shift=shift)
        want = exact([[v - shift for v in r] for r in whole])
        assert (n, s) == want[:2] and [[n * p[i][j] - s[i] * s[j] for j in range(3)] for i in range(3)] == want[2]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [0.5], "b"), (2, None, "c"), (3, [1.0, None], "d"), (4, [float("nan"), 1.0], "e"), (5, [float("inf"), 1.0], "f"), (6, [], "g"), (7, [3.0, -1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string")
    sound = whitening.sound(df)
    model = whitening.fit(sound)
    out = whitening.whiten(sound, model, ["vec_id", "whitened"]).orderBy(F.col("vec_id").asc_nulls_first()).collect()
    assert [r["vec_id"] for r in out] == [None, 1, 1, 6, 7] and model.n == 5
    x = [[int(64 * v) + 1_000_000 for v in (*r, 0.0, 0.0)[:2]] for r in ([0.5], [1.0, 2.0], [1.0, 2.0], [], [3.0, -1.0])]
    n, s, _ = exact(x)
    assert [r["deviation"] for r in out] == [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert whitening.identity_error(sound, model) < 1e-9 and len(out[0]["whitened"]) == 2


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    model = whitening.fit(flat)
    out = whitening.whiten(flat, model, ["vec_id"]).collect()
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in out) and whitening.identity_error(flat, model) < 1e-12
    one = whitening.fit(flat.where("vec_id = 0"))
    assert not one.varied.any() and whitening.identity_error(flat.where("vec_id = 0"), one) == 0.0
    none = flat.where("vec_id = 9")
    assert whitening.whiten(none, whitening.fit(none), ["vec_id"]).count() == 0


def test_entries_beyond_a_long():
    got = whitening.whole_numbers(pa.array([[1e30, -1e30, 2.0**56 + 0.0]]), 3)
    assert got.tolist() == [[(1 << 63) - 1, -(1 << 63), (1 << 62) + 1_000_000]]
