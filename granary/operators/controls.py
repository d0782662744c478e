"""Controls: placebo targets from other problems, and how alike the subspaces of classes are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import hash_rank_key
from granary.functions.ranges import in_hash_order, ranges_for
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()


def placebo_partners(nodes: DataFrame, stratum: str, problem: str, node: str, key: Column) -> DataFrame:
    """``nodes`` with ``partner``: a node of another problem of the same stratum, every node being the partner of one.

    Targets taken from partners are a permutation inside each stratum, so rates
    stay what they are. Nodes are ordered by ``key``, the hex digest of their
    problem, and shifted by the size of the stratum's largest problem: as a
    problem's nodes lie together, none meets its own as long as no problem has more
    than half of the stratum. Where one has, no such permutation exists and
    partners are null. Ranks are made in ranges of the digest, so a stratum may be of any size.
    """
    most = nodes.groupBy(stratum, problem).agg(F.count("*").alias("_m")).groupBy(stratum).agg(F.max("_m").alias("_most"))
    ranked = in_hash_order(nodes, [stratum], key, node, ranges_for(nodes.count()), rank="_k", size="_n").join(most, stratum)
    to = F.when(2 * F.col("_most") <= F.col("_n"), (F.col("_k") - 1 + F.col("_most")) % F.col("_n") + 1)
    other = ranked.select(F.col(stratum).alias("_stratum"), F.col("_k").alias("_to"), F.col(node).alias("partner"))
    mine = ranked.withColumn("_at", to)
    return mine.join(other, (F.col(stratum) == F.col("_stratum")) & (F.col("_at") == F.col("_to")), "left").select(*nodes.columns, "partner")


@CATALOG.query("""
WITH n AS (SELECT l.doc_id, d.lang, d.source, l.quality, md5(concat_ws('|', 'placebo', d.source)) AS h FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT lang, max(k) AS most FROM (SELECT lang, source, count(*) AS k FROM n GROUP BY ALL) GROUP BY lang),
r AS (SELECT n.*, most, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM n JOIN m USING (lang))
SELECT a.doc_id, a.quality AS target, b.doc_id AS partner, b.quality AS placebo FROM r a LEFT JOIN r b ON a.lang = b.lang AND 2 * a.most <= a.n AND b.k = (a.k - 1 + a.most) % a.n + 1
""")
def placebo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document with the target of a document of another source of its language."""
    t = Tables(spark, sf_dir)
    n = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    pairs = placebo_partners(n, "lang", "source", "doc_id", hash_rank_key("placebo", F.col("source")))
    targets = n.select(F.col("doc_id").alias("partner"), F.col("quality").alias("placebo"))
    return pairs.join(targets, "partner", "left").select("doc_id", F.col("quality").alias("target"), "partner", "placebo")


RANK = 8


def gram_sums(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, i, row): row i of the sum of x x' over each label's vectors, added up in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for y, part in b.groupby("y"):
                x = np.stack(part["x"].to_numpy()).astype(float)
                total[y] = total.get(y, 0) + x.T @ x
        rows = [(y, i, m[i].tolist()) for y, m in total.items() for i in range(len(m))]
        yield pd.DataFrame(rows, columns=["y", "i", "row"])

    kind = vectors.schema[label].dataType.simpleString()
    parts = vectors.select(F.col(label).alias("y"), F.col(vector).alias("x")).mapInPandas(partial, f"y {kind}, i int, row array<double>")
    # Of each task one row a label and dimension; added place by place.
    each = parts.select("y", "i", F.posexplode("row").alias("j", "v")).groupBy("y", "i", "j").agg(F.sum("v").alias("v"))
    return each.groupBy("y", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))


def basis(gram: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the matrix whose gram this is, the largest ``rank`` of them that aren't nought."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")[:rank]
    order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    return np.sqrt(values[order]), vectors[:, order]


def compared(a: np.ndarray, b: np.ndarray, rank: int) -> list[tuple[int, float, float, float]]:
    """Of two gram matrices, per rank r up to ``rank``: r, the cosine of the r-th principal angle of the leading subspaces of ``rank``, their similarity at r (mean squared cosine), and the share of b's energy in a's leading r directions."""
    u, v = basis(a, rank)[1], basis(b, rank)[1]
    cosines = np.clip(np.linalg.svd(u.T @ v, compute_uv=False), 0, 1)
    energy = np.einsum("ir,ij,jr->r", u, b, u) / max(np.trace(b), 1e-300)
    return [(r, float(cosines[r - 1]), float((np.linalg.norm(u[:, :r].T @ v[:, :r]) ** 2) / r), float(energy[:r].sum())) for r in range(1, min(rank, len(cosines)) + 1)]


def label_against_rest(vectors: DataFrame, label: str, vector: str, rank: int = RANK) -> DataFrame:
    """(label, r, cosine, similarity, captured): the leading subspace of each label's vectors against that of all others'."""
    sums = gram_sums(vectors, label, vector)
    every = sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("all"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        a, whole = np.stack(rows["row"].to_numpy()), np.stack(rows["all"].to_numpy())
        return pd.DataFrame([(rows["y"].iloc[0], *(round(x, 6) if isinstance(x, float) else x for x in c)) for c in compared(a, whole - a, rank)], columns=["y", "r", "cosine", "similarity", "captured"])

    kind = vectors.schema[label].dataType.simpleString()
    return sums.join(every, "i").groupBy("y").applyInPandas(one, f"y {kind}, r int, cosine double, similarity double, captured double").withColumnRenamed("y", label)


@CATALOG.query()
def label_subspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the leading directions of each label's vectors lie to those of the other labels'."""
    e = Tables(spark, sf_dir).embeddings.where("embedding is not null and label is not null")
    return label_against_rest(e, "label", "embedding")
