"""Records on their way in and out: sidecar metadata, converters, field policies, shape audits, reports, power, appended trajectories.

Settings and sidecars have one row for each source, so they are joined after the
rows are aggregated, or as literal tables of a few rows.
"""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from granary.functions.hashing import hash_rank_key
from granary.operators.catalog import Catalog, Tables
from granary.operators.sampling import ranked, ranked_whole
from granary.operators.stats import PAIRED, pairs_needed, paired
from granary.sources import readers
from granary.sources.scratch import scratch_path

CATALOG = Catalog()


@CATALOG.query("""
SELECT source, n, CASE WHEN source IS NULL OR source LIKE '%3' THEN 'no_sidecar' WHEN source LIKE '%4' THEN 'unfinished' WHEN source LIKE '%5' THEN 'generated' ELSE 'ok' END AS status
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def sidecar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against their metadata files: missing, with a TODO left, generated without leave, or fine."""
    counts = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "sidecars")
    licence = F.when(F.endswith("source", F.lit("4")), "TODO").otherwise("CC-BY-4.0")
    meta = counts.where("source is not null and source not like '%3'").select("source", licence.alias("licence"), F.endswith("source", F.lit("5")).alias("generated"))
    meta.write.json(path)
    sidecars = spark.read.schema("source string, licence string, generated boolean").json(path)
    status = F.when(F.col("licence").isNull(), "no_sidecar").when(F.contains("licence", F.lit("TODO")), "unfinished").when(F.col("generated"), "generated").otherwise("ok")
    return counts.join(sidecars, "source", "left").select("source", "n", status.alias("status"))


_CANDIDATES = "list_sort(list_distinct(list_filter([v, v + 1, v - 1, v * 2, v + 10], lambda x: x > 0)))"


@CATALOG.query(f"""
WITH p AS (SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size IS NOT NULL), x AS (SELECT p_partkey, p_name, v, unnest({_CANDIDATES}) AS x FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws('|', 'choice', CAST(p_partkey AS VARCHAR), CAST(x AS VARCHAR)))) AS k FROM x)
SELECT p_partkey AS item_id, 'What is the size of ' || p_name || '?' || chr(10) || 'Options:' || chr(10) || string_agg(chr(CAST(64 + k AS INTEGER)) || ') ' || CAST(x AS VARCHAR), chr(10) ORDER BY k) AS prompt, max(CASE WHEN x = v THEN chr(CAST(64 + k AS INTEGER)) END) AS gold_label, count(*) AS n_options FROM k GROUP BY p_partkey, p_name, v
""")
def numeric_choice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric questions as lettered choice records: near numbers as distractors, options in digest order."""
    v = F.col("v")
    options = F.array_distinct(F.filter(F.array(v, v + 1, v - 1, v * 2, v + 10), lambda x: x > 0))
    keyed = F.array_sort(F.transform(options, lambda x: F.struct(hash_rank_key("choice", F.col("p_partkey"), x).alias("h"), x.alias("x"))))
    p = Tables(spark, sf_dir).part.where("p_size is not null").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("v"))
    p = p.withColumn("o", F.transform(keyed, lambda s: s["x"]))
    rec = readers.to_eval_record(F.col("p_partkey"), F.transform("o", lambda x: x.cast("string")), (F.array_position("o", v) - 1).cast("int"), F.concat(F.lit("What is the size of "), "p_name", F.lit("?")), F.lit("size"))
    return p.select(rec.alias("r"), F.size("o").cast("long").alias("n_options")).select("r.item_id", "r.prompt", "r.gold_label", "n_options")


@CATALOG.query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, md5(concat_ws('|', 'bal', CAST(o_orderkey AS VARCHAR))) AS h FROM orders),
f AS (SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, h || CAST(o_orderkey AS VARCHAR)) AS o_orderkey, min(h) AS h FROM o GROUP BY ALL),
c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM f GROUP BY o_orderstatus)),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS k FROM f)
SELECT o_orderkey, o_orderstatus FROM k, c WHERE k <= least
""")
def balanced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each rule and answer class, then as many of every class as the rarest has."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", hash_rank_key("bal", F.col("o_orderkey")).alias("h"))
    first = o.groupBy("o_custkey", "o_orderstatus").agg(F.min(F.struct("h", F.col("o_orderkey").cast("string").alias("s"), "o_orderkey")).alias("m")).select("o_orderstatus", "m.o_orderkey", "m.h")
    least = first.groupBy("o_orderstatus").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    # A class may hold most rows: it is ranked in ranges of the digest.
    return ranked_whole(first, ["o_orderstatus"], F.col("h"), "o_orderkey").join(F.broadcast(least), F.col("k") <= F.col("least")).select("o_orderkey", "o_orderstatus")


#: What is done to the records of each source: a stand-in for a mixture's settings.
POLICIES = [
    {"part": 0, "nodes": "keep", "licence_class": "BY", "node_basis": "program"},
    {"part": 1, "nodes": "drop", "licence_class": "BY", "node_basis": "program"},
    {"part": 2, "nodes": "keep", "licence_class": "NC", "node_basis": "teacher"},
]


def apply_policy(items: DataFrame, policies: DataFrame, by: str) -> DataFrame:
    """Items with ``nodes`` as their source's policy wants them, and columns that say where they come from.

    Nodes are dropped from training items only, so that held-out ones can still
    be read out; a dropped or empty array leaves the basis "none". ``policies``
    has one row for each source.
    """
    rule = policies.withColumnsRenamed({"nodes": "_nodes", "node_basis": "_basis"})
    drop = (F.col("_nodes") == "drop") & (F.col("split") == "train")
    none = F.filter("nodes", lambda _: F.lit(False))
    out = items.join(F.broadcast(rule), by).withColumns({"n_dropped": F.when(drop, F.size("nodes")).otherwise(0), "nodes": F.when(drop, none).otherwise(F.col("nodes"))})
    return out.withColumns({"node_basis": F.when(F.size("nodes") > 0, F.col("_basis")).otherwise("none"), "lab_only": F.col("licence_class") == "NC"}).drop("_nodes", "_basis")


@CATALOG.query("""
WITH i AS (SELECT conv_id, conv_id % 3 AS part, CASE WHEN conv_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) FILTER (role = 'assistant') AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id, split, CASE WHEN part = 1 AND split = 'train' THEN 0 ELSE n END AS n_nodes, CASE WHEN part = 1 AND split = 'train' THEN n ELSE 0 END AS n_dropped,
 CASE WHEN n = 0 OR (part = 1 AND split = 'train') THEN 'none' WHEN part = 2 THEN 'teacher' ELSE 'program' END AS node_basis, CASE WHEN part = 2 THEN 'NC' ELSE 'BY' END AS licence_class, part = 2 AS lab_only FROM i
""")
def field_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items with their answers as nodes, kept or dropped by the policy of their part."""
    c = Tables(spark, sf_dir).conversations.where("conv_id is not null")
    node = F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    items = c.groupBy("conv_id").agg(node.alias("nodes")).withColumns({"part": (F.col("conv_id") % 3).cast("int"), "split": F.when(F.col("conv_id") % 5 == 0, "val").otherwise("train")})
    policies = readers.config_table(spark, POLICIES, "part int, nodes string, licence_class string, node_basis string")
    kept = apply_policy(items, policies, "part")
    return kept.select("conv_id", "split", F.size("nodes").cast("long").alias("n_nodes"), F.col("n_dropped").cast("long").alias("n_dropped"), "node_basis", "licence_class", "lab_only")


@CATALOG.query("""
WITH s AS (SELECT event_type, array_to_string(json_keys(props), ',') AS keys, 'OBJECT<' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || ': ' || CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN' ELSE 'BIGINT' END), ', ') || '>' AS shape FROM events),
c AS (SELECT event_type, keys, shape, count(*) AS n FROM s GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, shape, keys) = 1 AS usual FROM c
""")
def shape_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key order and value types of JSON records, counted; the usual shape of each type is marked, malformed records have none."""
    e = Tables(spark, sf_dir).events.select("event_type", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.schema_of_variant(F.try_parse_json("props")).alias("shape"))
    c = e.groupBy("event_type", "keys", "shape").agg(F.count("*").alias("n"))
    top = c.groupBy("event_type").agg(F.min(F.struct((-F.col("n")).alias("m"), "shape", "keys")).alias("t"))
    usual = F.struct("shape", "keys").eqNullSafe(F.struct("t.shape", "t.keys"))
    return c.join(top.withColumnRenamed("event_type", "type"), F.col("event_type").eqNullSafe(F.col("type"))).select("event_type", "keys", "shape", "n", usual.alias("usual"))


def report_lines(table: DataFrame, order: str) -> DataFrame:
    """(line, text) of a small table as a Markdown table, in ``order``; nulls are empty cells. For aggregates: a line is ranked by what stands before it."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(1, "| " + " | ".join(table.columns) + " |"), (2, "|" + " --- |" * len(table.columns))], "line long, text string")
    rows = ranked(table.select(F.lit("all").alias("all"), F.col(order).cast("string").alias("o"), cells.alias("text")), ["all"], F.col("o"), "text")
    return head.unionByName(rows.select((F.col("k") + 2).cast("long").alias("line"), "text"))


@CATALOG.query("""
WITH a AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT 1::BIGINT AS line, '| lang | n | sources |' AS text UNION ALL SELECT 2, '| --- | --- | --- |'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY lang), '| ' || lang || ' | ' || CAST(n AS VARCHAR) || ' | ' || CAST(sources AS VARCHAR) || ' |' FROM a
""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sources by language, as the lines of a report."""
    a = Tables(spark, sf_dir).documents.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return report_lines(a, "lang")


def power_of_pairs(discordant: Column, difference: Column, pairs: Column, alpha: float = 0.05) -> Column:
    """How likely a test of paired proportions finds a difference with so many pairs; null where the discordant share can't allow it."""

    @F.pandas_udf(DoubleType())
    def normal_cdf(z: pd.Series) -> pd.Series:
        return z.map(NormalDist().cdf, na_action="ignore")

    spread = discordant - difference * difference
    reach = difference * F.sqrt(pairs.cast("double")) - F.lit(NormalDist().inv_cdf(1 - alpha / 2)) * F.sqrt(discordant)
    return normal_cdf(F.when((spread > 0) & (pairs > 0), reach / F.sqrt(F.greatest(spread, F.lit(1e-300)))))


def units_needed(variance: Column, difference: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Units that a test of a mean difference needs at a variance; null where there is no variance or no difference."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(variance > 0, F.try_divide(F.lit(z * z) * variance, difference * difference))


@CATALOG.query()
def paired_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seed the share of discordant pairs, the difference, the power with the pairs there are, and the pairs or units that 80 % power needs."""
    d = F.col("a") - F.col("b")
    s = paired(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("n"), F.avg(F.abs(d).cast("double")).alias("discordant"), F.abs(F.avg(d)).alias("difference"), F.var_samp(d).alias("variance"))
    power = power_of_pairs(F.col("discordant"), F.col("difference"), F.col("n"))
    return s.select("seed", "n", "discordant", "difference", "variance", power.alias("power"), pairs_needed(F.col("discordant"), F.col("difference")).alias("pairs"), units_needed(F.col("variance"), F.col("difference")).alias("units"))


#: The columns of ``paired_power`` that SQL can express, for tests.
PAIRED_POWER_SQL = PAIRED + "SELECT seed, count(*) AS n, avg(abs(a - b)) AS discordant, abs(avg(a - b)) AS difference, var_samp(a - b) AS variance FROM pr GROUP BY seed"


def append_new(records: DataFrame, path: str, keys: list[str], schema: str) -> None:
    """Appends the records whose keys are not yet at ``path``: a run that stopped half way goes on where it was."""
    there = records.sparkSession.read.schema(schema).json(path).select(*keys).distinct()
    records.join(there, keys, "left_anti").write.mode("append").json(path)


@CATALOG.query("SELECT user_id AS run, count(*) AS n_records, max(event_id) AS last_step, arg_min(event_id, (value, event_id)) AS best_step FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id")
def trajectory_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records of runs, appended in two goes of which the second overlaps the first; counts, last and best step of each run."""
    path, schema = scratch_path(spark, "trajectory"), "run long, step long, loss double"
    records = Tables(spark, sf_dir).events.where("value is not null and user_id is not null").select(F.col("user_id").cast("long").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    records.where("step % 3 = 0").write.json(path)
    append_new(records, path, ["run", "step"], schema)
    r = spark.read.schema(schema).json(path)
    return r.groupBy("run").agg(F.count("*").alias("n_records"), F.max("step").alias("last_step"), F.min(F.struct("loss", "step"))["step"].alias("best_step"))
