"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers per dimension; each dimension is a term. Rows are
ordered by their nearest of ``CENTRES`` rows (those with the smallest hash: a
bounded sample that only shapes the blocks) and cut into blocks of about
``BLOCK_ROWS``; a block keeps a forward index (its ids and rows as a matrix) and
for each term the largest and smallest weight in it. For a query the sum over
its terms of the best the block could give bounds every score in the block.

1. Every query looks at the bounds of all blocks (a 32nd of the vectors' bytes
   at 64 rows a block) and scores the ``FIRST`` best ones through their forward
   index. Its k-th score there is a threshold that the true k-th cannot be under.
2. Only blocks whose bound reaches the threshold of some query of a group are
   sent to that group. There each query goes through the blocks in the falling
   order of its own bounds and stops where the next bound is under the k-th score
   it has by then; a bound equal to it still counts, as ties go to smaller ids.

Work is split into cells (a chunk of blocks, a group of queries near each
other) of bounded size, each of which yields at most k rows a query; a window
merges the cells. The queries are a stated set, so queries times blocks is the
work asked for; only blocks of rows move, never pairs.

Edge cases: vectors that are null or hold a null, NaN or infinite component, and
rows without id, take no part; inner products are exact, by Python's integers
where longs could overflow on the way; a component or one of the k best scores
that no long holds is an error; shorter vectors are padded with zeros to the longest; a query finds no row with its own id; repeated ids are separate rows,
ranked next to each other, and separate queries with k rows each; fewer candidates than k give fewer rows; ties go to
the smaller id; empty vectors score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize, table

K = 20
SCALE = 64
QUERY_EVERY = 20
BLOCK_ROWS = 64
MOST_LONG = (1 << 63) - 1
CENTRES = 128
#: Blocks that set a query's first threshold.
FIRST = 2
#: Blocks of its own order that a query goes on by at once.
STRIDE = 4
#: Blocks in a chunk and queries in a group: what one task holds.
CHUNK_BLOCKS, GROUP_QUERIES = 512, 4096


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * x) for sound vectors; an error for one that no long holds."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    sound = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    scaled = lambda c: c.cast("double") * scale
    whole = lambda c: F.when(F.abs(scaled(c)) < F.lit(2.0**63), F.floor(scaled(c)).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond a long after scaling")).cast("long"))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def exact_type(*parts: np.ndarray) -> type:
    """What holds inner products of such rows exactly: doubles if all sums stay under 2^53, longs if under 2^63, else Python's integers."""
    most = [max(int(p.max()), -int(p.min())) if p.size else 0 for p in parts]
    reach = most[0] * most[1] * max(1, parts[0].shape[1])
    return np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object


def least_value(dtype: type):
    """Under every score of this type."""
    return -np.inf if dtype == np.float64 else np.iinfo(np.int64).min if dtype == np.int64 else -(1 << 200)


def as_least(values: pd.Series, dtype: type) -> np.ndarray:
    """Thresholds in the type of the scores; -MOST_LONG stands for none."""
    v = values.to_numpy(np.int64)
    return np.where(v == -MOST_LONG, least_value(dtype), v.astype(dtype))


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; an error if one doesn't fit."""
    if scores.dtype == object and len(scores) and not -(1 << 63) <= min(scores) <= max(scores) < 1 << 63:
        raise OverflowError("an inner product is beyond a long")
    return scores.astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that any row of each block can score, for each query: (queries, blocks)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for o, v in zip(out, vectors, strict=True):
        o[: len(v)] = v
    return out


def stacked(blobs: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers that are held as bytes."""
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width)


def score_blocks(asked: np.ndarray, own: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray, k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows in these (ids, rows) blocks, as far as they reach ``least``, its threshold; other rows than those of its own id.

    Every query goes through the blocks in the falling order of its own bounds,
    ``stride`` of them at a time, until the next bound is under the k-th score it
    has; queries that are at the same block are scored together.
    """
    least = least.copy()
    low = least_value(asked.dtype)
    tops = np.full((len(asked), k), low, asked.dtype)
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(asked))
    at, ids, scores = [], [], []
    for first in range(0, order.shape[1], stride):
        ahead = order[active, first : first + stride]
        reach = np.take_along_axis(bound[active], ahead, 1) >= least[active, None]
        active, ahead, reach = active[reach[:, 0]], ahead[reach[:, 0]], reach[reach[:, 0]]
        if not len(active):
            break
        queries, visited = np.repeat(active, ahead.shape[1])[reach.ravel()], ahead.ravel()[reach.ravel()]
        by_block = np.argsort(visited, kind="stable")
        visited, cuts = np.unique(visited[by_block], return_index=True)
        for b, sel in zip(visited, np.split(queries[by_block], cuts[1:]), strict=True):
            block_ids, rows = blocks[b]
            got = asked[sel] @ rows.T
            got[block_ids[None] == own[sel, None]] = low
            hit = (got >= least[sel, None]) & (got > low)
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            q, r = np.nonzero(hit[some])
            at.append(sel[some][q])
            ids.append(block_ids[r])
            scores.append(got[some][q, r])
            sel = sel[some]
            both = np.concatenate([tops[sel], got[some]], 1)
            tops[sel] = (np.sort(both, axis=1) if both.dtype == object else np.partition(both, both.shape[1] - k, axis=1))[:, -k:]
            least[sel] = np.maximum(least[sel], tops[sel].min(1))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, ids, scores = np.concatenate(at), np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((ids, -scores, at)) if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], -scores[i], ids[i])))
    at, ids, scores = at[order], ids[order], scores[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    return at[keep], ids[keep], as_longs(scores[keep])


def arrays(blocks: pd.DataFrame, asked: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, highest, lowest weights) in a type whose inner products are exact."""
    q, high, low = matrix(asked, width), stacked(blocks["high"], width), stacked(blocks["low"], width)
    dtype = exact_type(q, np.concatenate([high, low]))
    return q.astype(dtype), high.astype(dtype), low.astype(dtype)


def forward(blocks: pd.DataFrame, width: int, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of each block."""
    return [(np.frombuffer(i, np.int64), np.frombuffer(r, np.int64).reshape(-1, width).astype(dtype)) for i, r in zip(blocks["ids"], blocks["rows"], strict=True)]


class Search:
    """The blocks and query groups of one table, and the two passes over them."""

    def __init__(self, vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS, chunk_blocks: int = CHUNK_BLOCKS, group_queries: int = GROUP_QUERIES, centres: int = CENTRES):
        self.k, self.every = k, every
        rows = materialize(quantised(vectors, scale).withColumn("number", F.monotonically_increasing_id()), "vectors")
        self.width = width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
        sample = pd.Series([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "number").limit(centres).select("v").collect()], dtype=object)
        points = matrix(sample, width).astype(np.float64)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = matrix(b["v"], width).astype(np.float64)
                yield b.assign(cell=((points**2).sum(1)[None] - 2 * x @ points.T).argmin(1).astype(np.int32))

        placed = materialize(rows.mapInPandas(nearest, "vec_id long, v array<long>, number long, cell int"), "placed")
        is_query = F.col("vec_id") % every == 0
        # At most one row a centre: how many rows and queries are near it.
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy("cell").collect()
        plan, base, group, open_ = [], 0, -1, 0
        for r in sizes:
            parts = -(-r["n"] // block_rows)
            if group < 0 or open_ + r["q"] > group_queries:
                group, open_ = group + 1, 0
            split = max(1, -(-r["q"] // group_queries))
            plan.append((r["cell"], base, parts, group, split))
            base, group, open_ = base + parts, group + split - 1, open_ + r["q"] if split == 1 else group_queries
        self.n_blocks, self.groups, self.chunks = base, group + 1, -(-base // chunk_blocks)
        plan = rows.sparkSession.createDataFrame(plan or [(-1, 0, 1, 0, 1)], "cell int, base long, parts long, first_group int, split int")
        dealt = placed.join(F.broadcast(plan), "cell")
        block = F.col("base") + F.pmod(F.xxhash64("number"), F.col("parts"))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["vec_id", "number"])
            x = matrix(pdf["v"], width)
            ends = [a.tobytes() for a in (pdf["vec_id"].to_numpy(np.int64), x, x.max(0), x.min(0))]
            return pd.DataFrame([(pdf["block"].iloc[0], *ends)], columns=["block", "ids", "rows", "high", "low"])

        packed = dealt.select(block.alias("block"), "vec_id", "v", "number").groupBy("block").applyInPandas(pack, "block long, ids binary, rows binary, high binary, low binary")
        self.blocks = materialize(packed.withColumn("chunk", F.floor(F.col("block") / chunk_blocks).cast("int")), "blocks")
        grp = (F.col("first_group") + F.pmod(F.xxhash64("number", F.lit(7)), F.col("split"))).cast("int")
        self.queries = dealt.where(is_query).select(grp.alias("grp"), "number", "vec_id", "v")

    def _cells(self, blocks: DataFrame, queries: DataFrame, work, schema: str) -> DataFrame:
        """``work(blocks, queries)`` over the rows of each (chunk, grp)."""
        queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # attributes of their own, for cogroup
        return blocks.groupBy("chunk", "grp").cogroup(queries.groupBy("chunk", "grp")).applyInPandas(lambda x, y: work(x.sort_values("block"), y.sort_values("number")), schema)

    def _bounds(self, queries: DataFrame, work, schema: str) -> DataFrame:
        """``work`` over all blocks' bounds and all queries."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
        summaries = self.blocks.select("chunk", "block", "high", "low").withColumn("grp", every(self.groups))
        return self._cells(summaries, queries.withColumn("chunk", every(self.chunks)), work, schema)

    def thresholds(self, first: int = FIRST) -> DataFrame:
        """(number, least): the k-th score of each query in its best-bounded blocks, where they hold k rows."""
        k, width = self.k, self.width

        def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame(columns=["number", "grp", "block", "bound"])
            bound = bounds(*arrays(x, y["v"], width))
            top = np.argsort(-bound, 1, kind="stable")[:, :first]
            n = top.shape[1]
            return pd.DataFrame({"number": np.repeat(y["number"].to_numpy(), n), "grp": np.repeat(y["grp"].to_numpy(), n), "block": x["block"].to_numpy()[top].ravel(), "bound": np.take_along_axis(bound, top, 1).ravel().astype(float)})

        found = self._bounds(self.queries, best, "number long, grp int, block long, bound double")
        w = Window.partitionBy("number").orderBy(F.desc("bound"), "block")
        wanted = materialize(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).select("number", "grp", "block"), "wanted")

        def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            q = arrays(x, y["v"], width)[0]
            out = []
            for block, (ids, rows) in zip(x["block"], forward(x, width, q.dtype), strict=True):
                sel = np.flatnonzero(y["block"].to_numpy() == block)
                got = q[sel] @ rows.T
                own = ids[None] == y["vec_id"].to_numpy()[sel, None]
                for n, g, o in zip(y["number"].to_numpy()[sel], got, own, strict=True):
                    # A threshold may be lower than it could be: beyond a long it is the nearest one.
                    out += [(n, min(MOST_LONG, max(-MOST_LONG, int(v)))) for v in np.sort(g[~o])[::-1][:k]]
            return pd.DataFrame(out, columns=["number", "score"], dtype="int64")

        pairs = wanted.join(self.blocks.select("block", "chunk"), "block")
        some = self.blocks.join(wanted.select("block", "grp").distinct(), "block")
        rows = self._cells(some, pairs.join(self.queries.select("number", "vec_id", "v"), "number"), score, "number long, score long")
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))).where(F.col("r") <= k)
        return ranked.groupBy("number").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("number", "least")

    def needed(self, asked: DataFrame) -> DataFrame:
        """(chunk, grp, block, visits): the blocks whose bound reaches the threshold of ``visits`` queries of a group, and no others."""
        width = self.width

        def reach(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame(columns=["chunk", "grp", "block", "visits"])
            bound = bounds(*arrays(x, y["v"], width))
            visits = (bound >= as_least(y["least"], bound.dtype)[:, None]).sum(0)
            out = pd.DataFrame({"chunk": x["chunk"].iloc[0], "grp": y["grp"].iloc[0], "block": x["block"], "visits": visits})
            return out[out["visits"] > 0]

        return self._bounds(asked, reach, "chunk int, grp int, block long, visits long")

    def asked(self) -> DataFrame:
        """The queries with their thresholds; the least number for those without."""
        known = self.queries.join(self.thresholds(), "number", "left")
        return materialize(known.withColumn("least", F.coalesce("least", F.lit(-MOST_LONG))), "asked")

    def results(self) -> DataFrame:
        k, width = self.k, self.width
        asked = self.asked()
        needed = materialize(self.needed(asked), "needed")

        def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            q, high, low = arrays(x, y["v"], width)
            own = y["vec_id"].to_numpy(np.int64)
            at, ids, scores = score_blocks(q, own, as_least(y["least"], q.dtype), forward(x, width, q.dtype), bounds(q, high, low), k)
            return pd.DataFrame({"number": y["number"].to_numpy()[at], "query_id": own[at], "vec_id": ids, "score": scores})

        sent = self.blocks.drop("chunk").join(needed.select("chunk", "grp", "block"), "block")
        parts = self._cells(sent, asked.join(needed.select("chunk", "grp").distinct(), "grp"), search, "number long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
        return parts.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, a query being a row whose id is divisible by ``every``. ``sizes``: those of ``Search``."""
    return Search(vectors, k, scale, every, **sizes).results()


def op7_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.number, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
