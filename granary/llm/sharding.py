"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of ``CELLS`` cells. A row hashes
to a cell by its key and belongs to the shard of the next point clockwise;
rows that meet a full shard continue clockwise to the next point whose shard
has room. Rows enter in ring order, so the outcome depends on keys alone, not
on partitions or on the order of the input.

The capacity of a shard is its exact share of the rows, ``floor(n / shards)``
or one more for the first ``n mod shards`` shards: the bounded-load rule with
the bound set to the mean. Counts therefore differ by one at most, and only
rows beyond a shard's share leave their home shard.

Only the number of rows in each of the ``CELLS`` cells reaches the driver; that
is a constant, whatever the input's size. The plan made from it (for each cell:
which ranks go to which shard) has at most ``CELLS + shards * vnodes`` lines and
is broadcast. Rows are ranked inside their cell, never inside a shard; a cell of
more than ``WINDOW_ROWS`` rows (one id repeated very often, say) is ranked in
parts of about that size. Windows hold three small columns; the texts are not
shuffled. The small columns are written once, so that counts and ranks see the
same parts.

Edge cases: a null text counts as no bytes; a null key is placed by the hash
of its text, so that rows without keys spread over the ring; rows with equal
keys share a cell and are ordered by size, then checksum, in cells that are not
split, and which of two equal rows comes first is left open; an empty table gives
an empty result; columns named like the output's get the output's values.
"""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import byte_length, materialize, table

#: Cells of the ring: a bound on what the driver gathers and broadcasts.
CELLS = 1 << 15
VNODES = 128
SHARDS = 24
OVERHEAD = 8
#: Rows that one window ranks.
WINDOW_ROWS = 200_000


def ring_points(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """The virtual nodes as (cell, shard), in ring order. A shard's points do not depend on how many shards there are."""
    return sorted((crc32(f"shard {s} point {v}".encode()) % cells, s) for s in range(shards) for v in range(vnodes))


def plan_ring(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, slot of the first rank), given the rows in each cell."""
    points = ring_points(shards, vnodes, cells)
    places = [p for p, _ in points]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    plan = []
    for cell in sorted(counts):
        rank, left, at = 0, counts[cell], bisect_left(places, cell)
        while left:
            shard = points[at % len(points)][1]
            n = min(left, room[shard] - taken[shard])
            if n:
                plan.append((cell, rank, rank + n - 1, shard, taken[shard]))
                taken[shard] += n
                rank += n
                left -= n
            at += 1
    return plan


def _cell(key: Column, fallback: Column, cells: int) -> Column:
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.lit("no key"), fallback)).otherwise(F.xxhash64(key)), F.lit(cells)).cast("int")


def assign_shards(df: DataFrame, key: str, order: list[str], fallback: str, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row of ``df``.

    key: the column that places a row on the ring. order: columns that rank
    rows of one cell after the key. fallback: placed by this if the key is null.
    Cells of more than ``window_rows`` rows are ranked in as many parts as it
    takes, by row number, each after the parts before it.
    """
    spark = df.sparkSession
    placed = df.drop("shard", "slot", "_cell", "_part", "_number", "_rank").withColumn("_cell", _cell(F.col(key), F.col(fallback), cells))
    rows = materialize(placed.withColumn("_number", F.monotonically_increasing_id()), "cells")
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_ring(counts, shards, vnodes, cells) or [(-1, 0, 0, 0, 0)], "_cell int, _from long, _to long, shard int, _slot long")
    split = spark.createDataFrame([(c, -(-n // window_rows)) for c, n in counts.items() if n > window_rows] or [(-1, 1)], "_cell int, _parts long")
    part = F.pmod(F.xxhash64("_number"), F.coalesce("_parts", F.lit(1)))
    rows = rows.join(F.broadcast(split), "_cell", "left").withColumn("_part", part).drop("_parts", "_number")
    # Only split cells have parts to add up: at most one for every window_rows rows.
    parts = rows.where(F.col("_cell").isin([c for c, n in counts.items() if n > window_rows])).groupBy("_cell", "_part").agg(F.count("*").alias("n"))
    before = parts.select("_cell", "_part", (F.sum("n").over(Window.partitionBy("_cell").orderBy("_part")) - F.col("n")).alias("_before"))
    rank = Window.partitionBy("_cell", "_part").orderBy(F.xxhash64(key), *[F.col(c) for c in (key, *order)])
    return (
        rows.withColumn("_rank", F.row_number().over(rank).cast("long") - 1)
        .join(before, ["_cell", "_part"], "left")
        .withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
        .join(F.broadcast(plan), "_cell")
        .where("_rank between _from and _to")
        .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from"))
        .drop("_cell", "_part", "_rank", "_before", "_from", "_to", "_slot")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per document: id, size in bytes with the fixed overhead, checksum of the text, law, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (byte_length(F.col(text_col)) + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = assign_shards(small, "doc_id", ["size", "text_crc32"], "text_crc32", shards, vnodes, window_rows=window_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs`` once under ``path/shard=N``, with its slot. Rows are carried whole, so null and repeated ids keep all their rows."""
    carried = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), byte_length(F.col(f"`{text_col}`")).alias("size"), F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))).alias("text_crc32"))
    placed = assign_shards(carried, "doc_id", ["size", "text_crc32"], "text_crc32", shards)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    placed.select(*kept, "shard", "slot").write.partitionBy("shard").parquet(path)


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
