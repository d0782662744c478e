"""The mixture assembler over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.catalog import Catalog, Tables
from granary.operators.overlap import _gate_sql, sql_tokens
from granary.plans.mixture import Mixture, assemble
from granary.plans.problems import Assembly, Fill, Source, assemble_problems

CATALOG = Catalog()
MIX = Mixture(exclude="src(7|9)$", least_chars=150, fill_chars=60_000, group_size=2)

_SQL = _gate_sql(13, 20) + f""", h AS (SELECT doc_id, min(item_id) AS owner FROM hits GROUP BY doc_id),
a AS (SELECT doc_id, source, n_chars, md5(array_to_string({sql_tokens('text')}, ' ')) AS key, CASE WHEN regexp_matches(source, 'src(7|9)$') THEN 'excluded' WHEN n_chars < 150 THEN 'short' WHEN owner IS NOT NULL THEN 'contaminated:' || CAST(owner AS VARCHAR) END AS r FROM documents LEFT JOIN h USING (doc_id)),
f AS (SELECT key, min((source, doc_id)) AS first FROM a WHERE r IS NULL GROUP BY key),
b AS (SELECT a.doc_id, a.source, a.n_chars, coalesce(r, CASE WHEN first <> (a.source, a.doc_id) THEN 'duplicate' END) AS r FROM a LEFT JOIN f USING (key)),
g AS (SELECT source, doc_id // 2 AS pid, arg_min(r, doc_id) FILTER (r IS NOT NULL) AS bad FROM b GROUP BY ALL),
c AS (SELECT b.doc_id, b.source, b.n_chars, coalesce(r, 'problem:' || bad) AS r FROM b JOIN g ON g.source = b.source AND g.pid = b.doc_id // 2),
d AS (SELECT *, sum(CASE WHEN r IS NULL THEN n_chars ELSE 0 END) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'mix', source, CAST(doc_id AS VARCHAR))), doc_id ROWS UNBOUNDED PRECEDING) - CASE WHEN r IS NULL THEN n_chars ELSE 0 END AS before FROM c),
e AS (SELECT doc_id, source, coalesce(r, CASE WHEN before >= 60000 THEN 'fill:not_needed' END) AS drop_reason FROM d),
v AS (SELECT *, row_number() OVER (PARTITION BY source, drop_reason IS NULL ORDER BY md5(concat_ws('|', 'val', source, CAST(doc_id AS VARCHAR))), doc_id) AS k, count(*) OVER (PARTITION BY source, drop_reason IS NULL) AS n FROM e)
SELECT doc_id, source, drop_reason, CASE WHEN drop_reason IS NULL THEN CASE WHEN k <= least(greatest(5, ceil(0.02 * n)), 200, n - 1) THEN 'val' ELSE 'train' END END AS split FROM v
"""


@CATALOG.query(_SQL)
def mixture_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return assemble(t.documents, t.benchmark, MIX)


@CATALOG.query(f"WITH m AS ({_SQL}) SELECT source, split, coalesce(split_part(drop_reason, ':', 1), 'kept') AS reason, count(*) AS n FROM m GROUP BY ALL")
def mixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixture_assemble(spark, sf_dir)
    return m.groupBy("source", "split", F.coalesce(F.split_part("drop_reason", F.lit(":"), F.lit(1)), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: Four sources in order of priority; the first two are one group, the last is filled up to a number of rows.
PROBLEMS = Assembly(
    sources=(
        Source("s0", group="core", label="gold", node_cap=1, own_evals=("bench2",)),
        Source("s1", group="core", label="program"),
        Source("s2", licence="ATTR", nodes=False),
        Source("s3"),
    ),
    release=True,
    fill=Fill("s3", 120),
    val_share=0.1,
    val_most=5,
    seed="mix",
)


def problem_rows(documents: DataFrame) -> DataFrame:
    """Documents as rows of problems: three ids in turn are a final row and its nodes, in a source named by the number of their own."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(3))
    gold = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")
    soft = F.create_map(F.lit("A"), F.lit(0.7), F.lit("B"), F.lit(0.3))
    hot = F.create_map(F.lit("A"), (gold == "A").cast("double"), F.lit("B"), (gold == "B").cast("double"))
    return documents.select(
        F.concat(F.lit("s"), (number % 4).cast("string")).alias("source"), F.when(F.col("doc_id") % 30 == 0, "val").otherwise("train").alias("split"),
        F.floor(F.col("doc_id") / 3).cast("string").alias("problem"), F.when(F.col("doc_id") % 3 == 0, "final").otherwise("node").alias("kind"),
        F.col("doc_id").cast("string").alias("item_id"), "text", F.col("lang").alias("family"),
        F.when(F.col("doc_id") % 11 == 0, "NC").otherwise("PERM").alias("licence"), F.when(F.col("doc_id") % 37 == 0, "audit").alias("flag"),
        (F.col("doc_id") % 41 == 0).alias("generated"), F.lit(None).cast("double").alias("weight"),
        F.array(F.lit("A"), F.lit("B")).alias("labels"), gold.alias("gold_label"), F.when(F.col("doc_id") % 13 == 0, soft).otherwise(hot).alias("teacher"),
    )


@CATALOG.query()
def problem_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembler of problems with licences, near duplicates, node weights, fill and validation split; the tests hold it against a plain loop."""
    t = Tables(spark, sf_dir)
    evals = t.benchmark.select(F.concat(F.lit("bench"), F.col("item_id") % 3).alias("file"), "item_id", "text")
    return assemble_problems(problem_rows(t.documents), evals, PROBLEMS)
