"""Ranks and running sums in hash order within groups of any size.

A group's rows are cut into ranges of their hash. Windows run inside a range,
and what lies before it is added from the table of range totals, so a group
that holds a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.hashing import hash_number

#: Rows of one range, about.
RANGE_ROWS = 1_000_000


def ranges_for(rows: int, each: int = RANGE_ROWS) -> int:
    return max(1, -(-rows // each))


def in_hash_order(df: DataFrame, by: list[str], key: Column, tie: str, ranges: int, rank: str | None = None, size: str | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Adds to each row its 1-based ``rank`` in its group in order of (key, tie), the group's ``size``, and per name in ``before`` the sum of a column over the group's earlier rows.

    ``key`` is a hex digest, ``ranges`` how many ranges its values are cut into.
    """
    before = before or {}
    cut = df.withColumn("_h", key).withColumns({f"_v_{n}": v for n, v in before.items()})
    cut = cut.withColumn("_p", F.floor(hash_number(F.col("_h")) * ranges / F.lit(1 << 32)))
    totals = cut.groupBy(*by, "_p").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in before])
    group = Window.partitionBy(*by)
    up = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ahead = totals.select(
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)],
        F.col("_p").alias("_q"),
        (F.sum("_n").over(up) - F.col("_n")).alias("_n_before"),
        F.sum("_n").over(group).alias("_n_all"),
        *[(F.sum(f"_s_{n}").over(up) - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in before],
    )
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_p").orderBy("_h", tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_r", F.row_number().over(inside)).withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(so_far) - F.col(f"_v_{n}") for n in before}).join(ahead, same)
    added = ([(F.col("_n_before") + F.col("_r")).alias(rank)] if rank else []) + ([F.col("_n_all").alias(size)] if size else [])
    return out.select(*df.columns, *added, *[(F.col(f"_b_{n}") + F.col(f"_w_{n}")).alias(n) for n in before])
