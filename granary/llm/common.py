"""Shared plumbing of the training-data operators: inputs, scratch tables, row keys."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a folder of our own in local mode (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or "file:///tmp/checkpoints"


#: Paths of scratch tables, in the order of writing, for those who release them.
_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _written.append(f"{scratch_root(spark)}/granary/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(p)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written in the block go at its end: everything that reads them must be written by then."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, [p for p in _written if p not in before])


def save(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage without a single-copy local checkpoint: an executor that
    is lost later only costs a re-read of the written files.
    """
    return save(df, scratch_path(df.sparkSession, label))


def measured(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows as they were written, without a second pass over them."""
    seen = Observation()
    out = materialize(df.observe(seen, *[v.alias(k) for k, v in figures.items()]), label)
    return out, seen.get


def held_out(doc_id: Column) -> Column:
    """Fold test: crc32 of the id as decimal text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` and the lambdas in it mention it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
