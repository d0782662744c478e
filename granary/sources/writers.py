"""Writers: ordered JSON lines, reports, split outputs, digests, partitioned releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[Column | str], files: int = 1) -> None:
    """JSON lines in order over ``files`` files of consecutive ranges: their names sort as their rows do."""
    ranged = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    ranged.sortWithinPartitions(*order).write.json(path)


def write_split(df: DataFrame, flag: str, clean: str, rest: str) -> None:
    """Rows whose ``flag`` is null or false to one table, the others to another."""
    bad = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    df.where(~bad).write.parquet(clean)
    df.where(bad).write.parquet(rest)


def write_partitioned(df: DataFrame, by: list[str], path: str, salts: int = 1) -> None:
    """One folder per value; rows of a large value are dealt out to ``salts`` tasks."""
    df.repartition(*[F.col(c) for c in by], F.pmod(F.monotonically_increasing_id(), F.lit(salts))).write.partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report table as text. For aggregates; ``limit`` bounds what reaches the driver."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def key_digest(keys: Column) -> Column:
    """md5 of a group's sorted keys joined by line feeds."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(keys.cast("string"))), "\n").cast("binary"))
