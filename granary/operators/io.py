"""Reads and writes exercised on the tables: each round trip must give back the rows that went in."""

from __future__ import annotations

import io as bytes_io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.ranges import ranges_for
from granary.operators.catalog import Catalog, Tables
from granary.sources import readers, writers
from granary.sources.scratch import scratch_path

CATALOG = Catalog()


@CATALOG.query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in hash order, read back strictly."""
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(Tables(spark, sf_dir).documents, path, [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"], files=4)
    return readers.read_jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@CATALOG.query("SELECT count(*) AS n_good, (SELECT count(*) FROM nation) AS n_bad FROM region")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad lines of a file that holds both."""
    t, path = Tables(spark, sf_dir), scratch_path(spark, "tolerant")
    good = t.region.select(F.to_json(F.struct("r_regionkey")).alias("value"))
    good.unionByName(t.nation.select(F.concat(F.lit("{broken "), "n_name").alias("value"))).write.text(path)
    return readers.read_jsonl_tolerant(spark, path, "r_regionkey long").agg(F.count("r_regionkey").alias("n_good"), F.count("_bad").alias("n_bad"))


@CATALOG.query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def keyed_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key wins."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type", "value")
    return readers.last_per_key(e, "user_id", F.col("event_id")).select("user_id", "event_type", "value")


@CATALOG.query("SELECT source, count(*) AS n, max(CASE WHEN source IN ('src0', 'src1') THEN 'PERM' ELSE 'UNK' END) AS class FROM documents GROUP BY source")
def csv_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A licence table from CSV, looked up with a default."""
    path = scratch_path(spark, "csv")
    writers.write_csv(spark.createDataFrame([("src0", "PERM"), ("src1", "PERM")], "source string, class string"), path)
    dim = readers.read_dimension(spark, path, "source string, class string")
    n = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n"))
    return n.join(dim, "source", "left").select("source", "n", F.coalesce("class", F.lit("UNK")).alias("class"))


@CATALOG.query("SELECT doc_id, source FROM documents WHERE n_chars BETWEEN 500 AND 900 AND lang = 'en'")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns out of five and predicates that reach the scan."""
    return Tables(spark, sf_dir).documents.where("n_chars between 500 and 900 and lang = 'en'").select("doc_id", "source")


@CATALOG.query("SELECT a.doc_id, b.quality FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a JOIN (SELECT quality, row_number() OVER (ORDER BY doc_id) AS i FROM labels) b USING (i)")
def row_aligned_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables zipped by a row number that comes from range counts: no single task sees all rows."""
    t = Tables(spark, sf_dir)
    return with_row_number(t.documents.select("doc_id"), "doc_id", "i").join(with_row_number(t.labels.select("doc_id", "quality"), "doc_id", "i").select("i", "quality"), "i").select("doc_id", "quality")


def with_row_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based row numbers in key order: rank within ranges of the key, as many as the rows need, plus what lies before the range."""
    from pyspark.sql import Window

    parts = 8 * ranges_for(df.count())
    cuts = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 1000).alias("cuts")).first()["cuts"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    parted = df.withColumn("_p", part)
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return parted.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


_RUNS = "SELECT 'tree-4b-s' || CAST(r AS VARCHAR) || '-ep' || CAST(1 + r % 3 AS VARCHAR) AS run, 'tree' AS arm, '4b' AS model, CAST(r AS INT) AS seed, CAST(1 + r % 3 AS INT) AS epochs FROM (SELECT r_regionkey AS r FROM region)"


def _write_runs(spark: SparkSession, sf_dir: str) -> str:
    """Metrics documents, one folder per run (one row per region)."""
    root = scratch_path(spark, "runs")
    k = F.col("r_regionkey")
    run = F.concat(F.lit("tree-4b-s"), k.cast("string"), F.lit("-ep"), (1 + k % 3).cast("string"))
    m = F.to_json(F.struct(F.create_map(F.lit("val"), F.struct((k / 10).alias("acc"), (k / 7).alias("nll")), F.lit("test"), F.struct((k / 20).alias("acc"), F.lit(1.5).alias("nll"))).alias("eval")))
    Tables(spark, sf_dir).region.select(run.alias("run"), m.alias("value")).write.partitionBy("run").text(root)
    return root


@CATALOG.query(_RUNS)
def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run folders by pattern, with the fields of their names."""
    found = readers.discover_runs(spark, _write_runs(spark, sf_dir), "*/*.txt")
    return found.withColumn("run", F.regexp_replace("run", "^run=", "")).withColumns(readers.run_fields(F.col("run"))).select("run", "arm", "model", "seed", "epochs")


@CATALOG.query(f"WITH r AS ({_RUNS}) SELECT run, s AS set, round(CASE s WHEN 'val' THEN seed / 10 ELSE seed / 20 END, 6) AS acc, round(CASE s WHEN 'val' THEN seed / 7 ELSE 1.5 END, 6) AS nll FROM r, (SELECT unnest(['val', 'test']) AS s)")
def metrics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies per run and set out of nested metrics."""
    runs = readers.discover_runs(spark, _write_runs(spark, sf_dir), "*/*.txt")
    return readers.explode_metrics(runs).select(F.regexp_replace("run", "^run=", "").alias("run"), "set", F.round("acc", 6).alias("acc"), F.round("nll", 6).alias("nll"))


@CATALOG.query("SELECT r_regionkey AS k, r_name AS name FROM region")
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON members of zip archives, one archive per region, made and read by executors."""

    def pack(batches):
        for b in batches:
            for k, n in zip(b["k"], b["n"], strict=True):
                data = bytes_io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"{k}.json", json.dumps({"k": int(k), "name": n}))
                    z.writestr("readme.txt", "no record")
                yield pd.DataFrame({"path": [f"{k}.zip"], "content": [data.getvalue()]})

    archives = Tables(spark, sf_dir).region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")).mapInPandas(pack, "path string, content binary")
    path = scratch_path(spark, "zip")
    archives.write.parquet(path)
    members = readers.zip_members(spark.read.parquet(path))
    rec = F.from_json("content", "k int, name string")
    return members.select(rec.alias("r")).select(F.col("r.k").cast(Tables(spark, sf_dir).region.schema["r_regionkey"].dataType).alias("k"), "r.name")


@CATALOG.query("SELECT conv_id, turn, text FROM conversations")
def literal_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped as Python literal lists and parsed back; texts that are none stay."""
    c = Tables(spark, sf_dir).conversations
    quoted = F.concat(F.lit("['"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), "'", r"\\'"), "\n", r"\\n"), F.lit("']"))
    return c.select("conv_id", "turn", readers.literal_text(F.when(F.col("turn") % 2 == 0, quoted).otherwise(F.col("text"))).alias("text"))


@CATALOG.query("SELECT p_partkey AS item_id, p_name || chr(10) || 'Options:' || chr(10) || 'A) ' || p_type || chr(10) || 'B) ' || p_brand AS prompt, ['A', 'B'] AS labels, ['A', 'B'][1 + p_partkey % 2] AS gold_label, p_brand AS \"group\" FROM part")
def eval_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with options as lettered evaluation records."""
    p = Tables(spark, sf_dir).part
    rec = readers.to_eval_record(F.col("p_partkey"), F.array("p_type", "p_brand"), (F.col("p_partkey") % 2).cast("int"), F.col("p_name"), F.col("p_brand"))
    return p.select(rec.alias("r")).select("r.*")


@CATALOG.query("SELECT 'conv' AS origin, CAST(conv_id AS VARCHAR) AS uid, CAST(count(*) AS INT) AS n_steps, CAST(NULL AS VARCHAR) AS task FROM conversations GROUP BY conv_id UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), 1, substr(text, 1, 20) FROM benchmark")
def trajectory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts brought to one trajectory record and united by name."""
    t = Tables(spark, sf_dir)
    steps = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("agent"), "text")))
    a = t.conversations.groupBy("conv_id").agg(steps.alias("s")).select(F.lit("conv").alias("origin"), F.col("conv_id").cast("string").alias("uid"), F.transform("s", lambda x: F.struct(x["agent"].alias("agent"), x["text"].alias("text"))).alias("steps"))
    b = t.benchmark.select(F.lit("bench").alias("origin"), F.col("item_id").cast("string").alias("uid"), F.array(F.struct(F.lit("user").alias("agent"), F.col("text"))).alias("steps"), F.substring("text", 1, 20).alias("task"))
    return a.unionByName(b, allowMissingColumns=True).select("origin", "uid", F.size("steps").alias("n_steps"), "task")


@CATALOG.query("SELECT source, md5(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest, count(*) AS n FROM documents GROUP BY source")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.groupBy("source").agg(writers.key_digest(F.col("doc_id")).alias("digest"), F.count("*").alias("n"))


@CATALOG.query("SELECT doc_id, contains(text, '!!') AS contaminated FROM documents")
def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean and contaminated rows written apart and read together."""
    clean, rest = scratch_path(spark, "clean"), scratch_path(spark, "rest")
    writers.write_split(Tables(spark, sf_dir).documents.select("doc_id", F.contains("text", F.lit("!!")).alias("contaminated")), "contaminated", clean, rest)
    return spark.read.parquet(clean).unionByName(spark.read.parquet(rest))


@CATALOG.query("SELECT doc_id, lang FROM documents")
def partitioned_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release partitioned by a column, read back with it."""
    path = scratch_path(spark, "release")
    writers.write_partitioned(Tables(spark, sf_dir).documents.select("doc_id", "lang"), ["lang"], path)
    return spark.read.option("basePath", path).parquet(path).select("doc_id", "lang")


@CATALOG.query("SELECT event_type AS tag, count(*) AS n, round(sum(value), 4) AS usd FROM events GROUP BY event_type")
def call_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log as JSON lines, summed by tag."""
    path = scratch_path(spark, "calls")
    Tables(spark, sf_dir).events.select(F.col("event_type").alias("tag"), F.col("value").alias("usd")).write.json(path)
    return readers.read_jsonl(spark, path, "tag string, usd double").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 4).alias("usd"))


@CATALOG.query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose output is there already are skipped."""
    e, path = Tables(spark, sf_dir).events.select("event_id", "event_type"), scratch_path(spark, "done")
    e.where("event_id % 4 = 0").select("event_id").write.parquet(path)
    return e.join(spark.read.schema("event_id long").parquet(path), "event_id", "left_anti")
