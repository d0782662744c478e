"""Readers of nested records: JSON lines, JSON documents, zip members, CSV dimensions, run directories."""

from __future__ import annotations

import ast
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The record that all trajectory layouts are brought to.
TRAJECTORY = "uid string, origin string, subset string, task string, answer string, steps array<struct<agent:string,text:string>>, dec int, gold_agent string, mode string, split string, ids array<string>, flags array<string>"
DECISION = "item_id string, source string, prompt string, labels array<string>, gold_label string, teacher map<string,double>, depth int"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped; any other bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, but bad lines become rows with ``_bad`` set to the line."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; ``file`` is the file's name without its ending."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def zip_members(archives: DataFrame, pattern: str = r"\.json$") -> DataFrame:
    """(archive, member, content) of the members of ``archives(path, content)`` whose names match; a task holds one archive at a time."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(name, m, z.read(m).decode("utf-8", "replace")) for m in sorted(z.namelist()) if re.search(pattern, m)]
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return archives.select("path", "content").mapInPandas(members, "archive string, member string, content string")


def read_zip_members(spark: SparkSession, path: str, pattern: str = r"\.json$") -> DataFrame:
    return zip_members(spark.read.format("binaryFile").load(path), pattern)


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, under a fixed schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def config_table(spark: SparkSession, config: list[dict], schema: str) -> DataFrame:
    """Settings as a small table; entries that still say TODO are refused."""
    left = [k for row in config for k, v in row.items() if isinstance(v, str) and "TODO" in v]
    if left:
        raise ValueError(f"the settings are not finished: {', '.join(sorted(set(left)))}")
    return spark.createDataFrame([tuple(row.get(k.split()[0]) for k in schema.split(", ")) for row in config], schema)


@F.pandas_udf(StringType())
def literal_text(values: pd.Series) -> pd.Series:
    """A string that holds a Python literal list of texts (or of records with a text) as one text; others as they are."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        try:
            found = ast.literal_eval(s)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return s
        if not isinstance(found, list):
            return s
        return "\n".join(str(x.get("text", x.get("content", ""))) if isinstance(x, dict) else str(x) for x in found)

    return values.map(one)


def run_fields(name: Column) -> dict[str, Column]:
    """Fields of a run's name ``arm-model-s<seed>[-lr<rate>][-ep<n>]``."""
    pick = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return {"arm": pick(r"^([a-z]+)"), "model": pick(r"^[a-z]+-([0-9a-z]+)"), "seed": pick(r"-s([0-9]+)").cast("int"), "lr": pick(r"-lr([0-9.e]+(?:-[0-9]+)?)").cast("double"), "epochs": pick(r"-ep([0-9]+)").cast("int")}


def discover_runs(spark: SparkSession, root: str, pattern: str = "*/metrics.json") -> DataFrame:
    """The runs under a folder, with the fields of their names and their metrics as text."""
    raw = spark.read.option("wholetext", True).text(f"{root}/{pattern}").select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return raw.select(name.alias("run"), F.col("value").alias("metrics")).withColumns(run_fields(F.col("run")))


def explode_metrics(runs: DataFrame) -> DataFrame:
    """(run, set, acc, nll) from each run's ``eval`` map."""
    parsed = F.from_json("metrics", "eval map<string,struct<acc:double,nll:double,ece:double,brier:double>>")
    return runs.select("run", F.explode(parsed["eval"]).alias("set", "m")).select("run", "set", "m.acc", "m.nll")


def lettered(options: Column) -> Column:
    """A, B, C ... for an array of options."""
    return F.transform(options, lambda _, i: F.char(65 + i))


def to_eval_record(item: Column, options: Column, gold: Column, question: Column, group: Column) -> Column:
    """The evaluation record of a question with options and a 0-based gold index."""
    labels = lettered(options)
    lines = F.array_join(F.zip_with(labels, options, lambda l, o: F.concat(l, F.lit(") "), o)), "\n")
    return F.struct(item.alias("item_id"), F.concat(question, F.lit("\nOptions:\n"), lines).alias("prompt"), labels.alias("labels"), F.get(labels, gold).alias("gold_label"), group.alias("group"))


def schema_shape(record: str) -> str:
    """The key names and value types of one JSON record, in order: for audits of written files."""
    def kind(x: object) -> object:
        if isinstance(x, dict):
            return {k: kind(v) for k, v in x.items()}
        return [kind(x[0])] if isinstance(x, list) and x else type(x).__name__

    return json.dumps(kind(json.loads(record)))
