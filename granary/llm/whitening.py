"""Embedding whitening from an exact integer scatter.

Entries become whole numbers ``x = floor(SCALE * c) + OFFSET``. Every task
subtracts a shift and adds up its rows' values and cross-products as whole
numbers of any size: in doubles or longs where a bound says that these are
exact, else in Python's integers. The tasks' sums are added up in two rounds of
Spark aggregation, row by row of the matrix, so nothing but one row of the
matrix (of as many numbers as a vector has) meets in a task, and one matrix
reaches the driver. There ``n * X'X - S S'`` is formed exactly, whatever the shift, divided by
``n^2`` with one rounding an entry, and decomposed by ``eigh``.

Rows are then projected where they lie: numerators ``n * x - S`` are exact whole
numbers, their division by ``n`` rounds once. The covariance of the whitened
rows is summed up in a second pass over them and compared with the identity.

The model (sums, components, eigenvalues) is as large as a vector times
``COMPONENTS`` and broadcast.

Edge cases: null vectors and vectors with a null, NaN or infinite entry are
dropped; vectors shorter than the longest count as if zeros followed; rows
without id and repeated rows stay rows of their own; an entry whose ``x`` is
beyond a long is set to the nearest long; a deviation beyond a long is null;
fewer dimensions than ``COMPONENTS`` give as many components; a component
without variance (under the rounding of the largest) has no whitened value: it
is null, and the identity is tested on the others; with no variance at all
``explained`` is null and ``identity_error`` 0; empty vectors have no component;
an empty table gives an empty result. Other columns are only read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Tasks' sums of one matrix row are added in so many groups first.
FIRST_GROUPS = 64
#: Eigenvalues under this share of the largest are rounding.
NO_VARIANCE = 1e-12


def sound(vectors: DataFrame) -> DataFrame:
    """The rows whose vector takes part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & ~bad)


def whole_numbers(vectors: pa.ListArray, width: int, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """(rows, width) longs: floor(scale * entry) + offset, zeros after short vectors."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.zeros((len(vectors), width))
    values[np.arange(width)[None] < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        values = np.floor(values * scale)
    if not values.size or np.abs(values).max() < 1 << 52:
        return values.astype(np.int64) + offset
    near = lambda v: min(MOST, max(LEAST, (int(v) if np.isfinite(v) else (MOST if v > 0 else LEAST) * 2) + offset))
    return np.array([[near(v) for v in row] for row in values], np.int64).reshape(values.shape)


def scatter(x: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the rows less ``shift``, as exact Python integers."""
    far = max((abs(int(v) - shift) for v in (x.min(), x.max())), default=0) if x.size else 0
    if far >= 1 << 62:
        r = x.astype(object) - shift
        return r.sum(0), r.T.dot(r)
    r = x - shift
    most = far * far * len(x)
    products = (r.astype(np.float64).T @ r.astype(np.float64)).astype(np.int64) if most < 1 << 53 else r.T @ r if most < 1 << 63 else r.astype(object).T.dot(r.astype(object))
    return (r.sum(0) if far * len(x) < 1 << 63 else r.astype(object).sum(0)).astype(object), products.astype(object)


def _added(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, sums, row): whole numbers as JSON lists, added up by ``keys``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, names = 0, None, None
        for batch in batches:
            names = names or {k: batch.column(k)[0] for k in keys} if batch.num_rows else names
            for m, row in zip(batch.column("n").to_pylist(), batch.column("row").to_pylist(), strict=True):
                row = np.array(json.loads(row), object)
                n, total = n + m, row if total is None else total + row
        yield pa.RecordBatch.from_pydict({k: pa.array([v.as_py()], v.type) for k, v in names.items()} | {"n": pa.array([n], pa.int64()), "row": pa.array([json.dumps(total.tolist())])})

    schema = ", ".join(f"{k} int" for k in keys) + ", n long, row string"
    return frame.groupBy(*keys).applyInArrow(add, schema)


def totals(rows: DataFrame, width: int, scale: int = SCALE, offset: int = OFFSET, shift: int = OFFSET) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of all rows less ``shift``, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            a, b = scatter(whole_numbers(batch.column(0), width, scale, offset), shift)
            n, s, p = n + batch.num_rows, s + a, p + b
        if n:
            # Row i of the matrix, with the sums as its last row.
            lines = [json.dumps(r.tolist()) for r in [*p, s]]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width + 1), pa.int32()), "n": pa.array([n] * (width + 1), pa.int64()), "row": pa.array(lines)})

    parts = rows.select("embedding").mapInArrow(partial, "i int, n long, row string")
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(FIRST_GROUPS)))
    got = {r["i"]: r for r in _added(_added(parts, ["i", "g"]), ["i"]).collect()}
    if not got:
        return 0, [0] * width, [[0] * width] * width
    return got[width]["n"], json.loads(got[width]["row"]), [json.loads(got[i]["row"]) for i in range(width)]


def decompose(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, largest first, from exact numbers."""
    width = len(sums)
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)], float).reshape(width, width)
    values, vectors = np.linalg.eigh(cov)
    take = np.argsort(-values, kind="stable")[:components]
    trace = sum(n * products[i][i] - sums[i] ** 2 for i in range(width)) / (n * n)
    return values[take], vectors[:, take], trace


class Whitening:
    """What a fit knows; small enough to broadcast."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, scale: int = SCALE, offset: int = OFFSET):
        self.n, self.sums, self.values, self.vectors, self.trace, self.scale, self.offset = n, sums, values, vectors, trace, scale, offset
        self.width, self.components = len(sums), len(values)
        self.varied = values > NO_VARIANCE * max(1e-300, values.max(initial=0.0))
        root = np.where(self.varied, np.sqrt(np.where(self.varied, values, 1.0)), np.nan)
        self.map = vectors / root

    def apart(self, vectors: pa.ListArray) -> np.ndarray:
        """Exact ``n * x - S`` of each row, in longs if they and their squares' sums fit, else in Python's integers."""
        x = whole_numbers(vectors, self.width, self.scale, self.offset)
        most = max((abs(self.n * int(v)) for v in (x.min(), x.max())), default=0) + max(map(abs, self.sums), default=0) if x.size else 0
        if most < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if not d.size or int(np.abs(d).max()) ** 2 * self.width < 1 << 63:
                return d
            return d.astype(object)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, apart: np.ndarray) -> np.ndarray:
        """(rows, components) whitened values; NaN where a component has no variance."""
        return (apart / self.n).astype(float) @ self.map


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of sound ``rows`` (column ``embedding``)."""
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    n, sums, products = totals(rows, width, scale, offset, shift=offset)
    if not n or not width:
        return Whitening(n, [0] * width, np.zeros(0), np.zeros((width, 0)), 0.0, scale, offset)
    model = decompose(n, sums, products, components)
    # Sums of x itself: the shift comes back once a row.
    return Whitening(n, [s + n * offset for s in sums], *model, scale, offset)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened rows, centred, divisor n) minus the identity, from a pass over all rows."""
    shared, k = rows.sparkSession.sparkContext.broadcast(model), int(model.varied.sum())
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = m.project(m.apart(batch.column(0)))[:, m.varied]
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

    sums = rows.select("embedding").mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    got = np.zeros((k + 1, k))
    for r in sums.collect():
        got.flat[r["at"]] = r["v"]
    mean = got[k] / model.n
    return float(np.abs(got[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, with ``deviation`` and the array ``whitened`` (null for components without variance)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("deviation", "whitened")]
    taken = vectors.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), "embedding")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            d = m.apart(batch.column(1))
            far = (d * d).sum(1).tolist() if d.shape[1] else [0] * len(d)
            w = pa.array(m.project(d).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * m.components, pa.int32()), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if v <= MOST else None for v in far], pa.int64()), lists], names=["kept", "deviation", "whitened"])

    out = taken.mapInArrow(apply, f"kept {taken.schema['kept'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], "deviation", "whitened")


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(sound(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "sound")
    model = fit(rows)
    share = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values]) if model.components else F.array().cast("array<double>")
    one = whiten(rows, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"))
