"""The mixture assembler: a configuration turns pools of rows into train and validation rows with drop reasons.

Rows never leave the frame on the way: each step gives rows without a reason one
if they fail it. Steps carry keys and small columns; texts are joined back only
for what is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.hashing import hash_rank_key
from granary.functions.ranges import in_hash_order, ranges_for
from granary.operators.overlap import gate


@dataclass(frozen=True)
class Mixture:
    include: str = "."
    exclude: str = r"(?!)"
    least_chars: int = 0
    gram: int = 13
    boilerplate: int = 20
    fill_chars: int | None = None
    group_size: int = 1
    val_share: float = 0.02
    val_least: int = 5
    val_most: int = 200
    seed: str = "mix"
    caps: dict[str, float] = field(default_factory=dict)

    def check(self) -> list[str]:
        """What is wrong with the settings."""
        out = [f"{k} must be positive" for k in ("gram", "boilerplate", "group_size") if getattr(self, k) < 1]
        out += ["val_share must be in [0, 1)"] * (not 0 <= self.val_share < 1)
        return out + [f"cap of {k} must be in (0, 1]" for k, v in self.caps.items() if not 0 < v <= 1]


def _add(df: DataFrame, reason: str | Column, cond: Column) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.withColumn("drop_reason", F.coalesce("drop_reason", F.when(cond, reason)))


def assemble(rows: DataFrame, evals: DataFrame, mix: Mixture) -> DataFrame:
    """rows(doc_id, text, lang, source, n_chars) to (doc_id, source, drop_reason, split)."""
    wrong = mix.check()
    if wrong:
        raise ValueError("; ".join(wrong))
    small = rows.select("doc_id", "source", "lang", "n_chars", F.md5(T.normalised(F.col("text")).cast("binary")).alias("key")).withColumn("drop_reason", F.lit(None).cast("string"))
    small = _add(small, "excluded", ~(F.col("source").rlike(mix.include) & ~F.col("source").rlike(mix.exclude)))
    small = _add(small, "short", F.col("n_chars") < mix.least_chars)
    hit = gate(rows, "doc_id", evals, "item_id", mix.gram, mix.boilerplate).groupBy("doc_id").agg(F.min("item_id").alias("owner"))
    small = _add(small.join(hit, "doc_id", "left"), F.concat(F.lit("contaminated:"), F.col("owner").cast("string")), F.col("owner").isNotNull())
    # Of equal texts that are still in, the first by source and id stays.
    live = small.where("drop_reason is null").groupBy("key").agg(F.min(F.struct("source", "doc_id")).alias("first"))
    small = small.join(live, "key", "left")
    small = _add(small, "duplicate", (F.col("first.source") != F.col("source")) | (F.col("first.doc_id") != F.col("doc_id")))
    if mix.group_size > 1:
        small = small.withColumn("pid", F.floor(F.col("doc_id") / mix.group_size))
        bad = small.groupBy("source", "pid").agg(F.min_by("drop_reason", F.when(F.col("drop_reason").isNotNull(), F.col("doc_id"))).alias("bad"))
        small = small.join(bad, ["source", "pid"])
        small = _add(small, F.concat(F.lit("problem:"), F.col("bad")), F.col("bad").isNotNull())
    ranges = ranges_for(rows.count())
    if mix.fill_chars is not None:
        own = F.when(F.col("drop_reason").isNull(), F.col("n_chars")).otherwise(0)
        small = in_hash_order(small, ["source"], hash_rank_key(mix.seed, F.col("source"), F.col("doc_id")), "doc_id", ranges, before={"before": own})
        small = _add(small, "fill:not_needed", F.col("before") >= mix.fill_chars)
    small = small.withColumn("live", F.col("drop_reason").isNull())
    small = in_hash_order(small, ["source", "live"], hash_rank_key("val", F.col("source"), F.col("doc_id")), "doc_id", ranges, rank="rank", size="n")
    k = F.least(F.greatest(F.lit(mix.val_least), F.ceil(mix.val_share * F.col("n"))), F.lit(mix.val_most), F.col("n") - 1)
    return small.select("doc_id", "source", "drop_reason", F.when(F.col("live"), F.when(F.col("rank") <= k, "val").otherwise("train")).alias("split"))
