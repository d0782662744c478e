"""The assembler of problems: final rows with their node rows, from sources in order of priority, to train and validation rows.

A problem is all rows of one (source, split, problem). What a gate or a
duplicate takes from it takes the whole problem; node rows that a source leaves
out by policy, or over its cap, are screened like the kept ones in the first
case and not at all in the second. Rows never leave the frame: each gets its
weight, its target and the reason why it is dropped, or none.

Frames carry keys, small columns and a signature, never texts. They are written
to the shared folder between stages, so a lost executor repeats one stage.

Edge cases: a null text is empty, a null problem is the row's own item id, a
null family is one family, an unknown licence is the most restrictive; repeated
rows are rows of their own; rows of a source that is not configured get the
reason ``source``; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.hashing import hash_rank_key
from granary.functions.ranges import in_hash_order, ranges_for
from granary.operators.dedup import first_alike, minhash, signed
from granary.operators.filters import licence_max
from granary.operators.overlap import gate
from granary.sources.scratch import scratch_path

#: Licence classes that a release may hold.
RELEASED = ("PERM", "ATTR")
#: Reasons of rows that were never selected: they take no part in later stages and leave their problem alone.
UNSELECTED = ("source", "node_cap", "label")
PROBLEM = ["source", "split", "problem"]
SMALL = ["source", "split", "problem", "kind", "item_id", "family", "licence", "chars", "weight", "target"]


@dataclass(frozen=True)
class Source:
    """How one source takes part. Sources of one ``group`` are not compared for duplicates; ``own_evals`` are prefixes of evaluation files it may overlap."""

    name: str
    group: str = ""
    label: str = "as_is"
    licence: str | None = None
    lab_only: bool = False
    nodes: bool = True
    node_cap: int | None = None
    own_evals: tuple[str, ...] = ()
    gated: bool = True
    slice: str = ""


@dataclass(frozen=True)
class Fill:
    """Problems of ``source`` are taken in hash order until the training rows (or characters) reach ``target``."""

    source: str
    target: int
    unit: str = "rows"
    least: float | None = None
    allow_short: bool = False


@dataclass(frozen=True)
class Assembly:
    sources: tuple[Source, ...]
    release: bool = False
    allow_generated: bool = False
    gram: int = 13
    boilerplate: int = 20
    near: bool = True
    fill: Fill | None = None
    val_share: float | None = None
    val_least: int = 1
    val_most: int = 1_000_000_000
    seed: str = "0"
    caps: dict[str, float] = field(default_factory=dict)

    def check(self) -> list[str]:
        """What is wrong with the settings."""
        names = [s.name for s in self.sources]
        out = [f"source {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [f"{s.name}: label must be as_is, gold or program" for s in self.sources if s.label not in ("as_is", "gold", "program")]
        out += [f"{s.name}: node_cap must be positive" for s in self.sources if s.node_cap is not None and s.node_cap < 1]
        if self.fill and self.fill.source not in names:
            out.append(f"fill source {self.fill.source} is not configured")
        if self.fill and self.fill.unit not in ("rows", "chars"):
            out.append("fill unit must be rows or chars")
        slices = {s.slice for s in self.sources}
        return out + [f"cap on unknown slice {x}" for k in self.caps for x in k.split("+") if x not in slices]


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of(plan: Assembly, value) -> Column:
    """A setting of each row's source; null where the source is not configured or the setting is None."""
    out = F.lit(None)
    for s in plan.sources:
        out = F.when(F.col("source") == s.name, F.lit(value(s))).otherwise(out)
    return out


def _dropped(df: DataFrame, reason: Column | str, cond: Column) -> DataFrame:
    return df.withColumn("drop_reason", F.coalesce("drop_reason", F.when(cond, F.lit(reason) if isinstance(reason, str) else reason)))


def _propagated(df: DataFrame, prefix: str) -> DataFrame:
    """Problems with a row whose reason begins so lose all their rows, for the reason of the first one."""
    bad = df.where(F.startswith("drop_reason", F.lit(prefix))).groupBy(*PROBLEM).agg(F.min_by("drop_reason", F.struct("item_id", "row")).alias("_bad"))
    return _dropped(df.join(bad, PROBLEM, "left"), F.concat(F.lit("problem:"), "_bad"), F.col("_bad").isNotNull()).drop("_bad")


def _target(plan: Assembly) -> tuple[Column, Column]:
    """The target after the source's label policy, and whether the row can be labelled so."""
    mode = _of(plan, lambda s: s.label)
    named = F.coalesce(F.array_contains("labels", F.col("gold_label")), F.lit(False))
    hot = F.map_from_arrays("labels", F.transform("labels", lambda x: (x == F.col("gold_label")).cast("double")))
    given = F.col("teacher").isNotNull()
    gap = F.transform("labels", lambda x: F.abs(F.coalesce(F.element_at("teacher", x), F.lit(0.0)) - (x == F.col("gold_label")).cast("double")))
    as_hot = F.forall(gap, lambda d: d < 1e-9)
    target = F.when(mode == "gold", F.when(named, hot)).when((mode == "program") & ~given, F.when(named, hot)).otherwise(F.col("teacher"))
    fits = F.when(mode == "as_is", given).when(mode == "gold", named).otherwise(named & (~given | F.coalesce(as_hot, F.lit(False))))
    return target, fits


def _selected(rows: DataFrame, plan: Assembly, ranges: int) -> DataFrame:
    """The small frame: labels, node caps and weights done."""
    text = F.coalesce("text", F.lit(""))
    target, fits = _target(plan)
    known = _of(plan, lambda s: s.name).isNotNull()
    small = rows.select(
        "source", "split", F.coalesce("problem", "item_id").alias("problem"), "kind", "item_id", "family",
        licence_max(F.coalesce(_of(plan, lambda s: s.licence), "licence")).alias("licence"),
        F.coalesce("flag", F.lit("")).alias("flag"), F.coalesce("generated", F.lit(False)).alias("generated"),
        F.length(text).cast("long").alias("chars"), "weight", target.alias("target"),
        F.when(~known, "source").when(~fits, "label").alias("drop_reason"),
        F.sha2(text, 256).alias("key"), F.md5(T.normalised(text).cast("binary")).alias("exact"), minhash(text).alias("s"),
    )
    small = small.withColumn("sig", F.when(F.col("s").isNotNull(), signed(F.col("s")))).withColumn("row", F.monotonically_increasing_id())
    small = _saved(small, "problems-rows")
    cap = _of(plan, lambda s: s.node_cap).cast("int")
    counted = (F.col("kind") == "node") & F.col("drop_reason").isNull()
    nodes = small.where(counted).select("row", *PROBLEM, "item_id")
    ranked = in_hash_order(nodes, PROBLEM, hash_rank_key(plan.seed, F.col("source"), F.col("split"), F.col("item_id")), "row", ranges, rank="_rank", size="_n").select("row", "_rank", "_n")
    small = _dropped(small.join(ranked, "row", "left"), "node_cap", F.col("_rank") > cap)
    return small.withColumn("weight", F.when(cap.isNotNull() & F.col("_n").isNotNull(), F.round(1 / F.least(F.col("_n"), cap), 6)).otherwise(F.coalesce("weight", F.lit(1.0)))).drop("_rank", "_n")


def _screened(small: DataFrame, rows: DataFrame, evals: DataFrame, plan: Assembly) -> DataFrame:
    """Overlap with evaluation files, but for a source's own ones, which are noted in ``own_overlap``."""
    texts = rows.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text")
    reference = evals.select(F.struct("file", "item_id").alias("item"), "text")
    hits = gate(texts, "key", reference, "item", plan.gram, plan.boilerplate).groupBy("key").agg(F.array_sort(F.collect_set("item.file")).alias("_files"))
    none = F.array().cast("array<string>")
    own = F.coalesce(_of(plan, lambda s: F.array(*[F.lit(p) for p in s.own_evals]) if s.own_evals else none), none)
    mine = lambda f: F.exists(F.col("_own"), lambda p: F.startswith(f, p))
    gated = F.coalesce(_of(plan, lambda s: s.gated), F.lit(False)) & F.col("drop_reason").isNull()
    seen = small.join(hits, "key", "left").withColumn("_own", own).withColumn("_files", F.when(gated, F.col("_files")))
    seen = seen.withColumn("own_overlap", F.nullif(F.array_join(F.filter("_files", mine), ","), F.lit("")))
    first = F.array_min(F.filter("_files", lambda f: ~mine(f)))
    return _propagated(_dropped(seen, F.concat(F.lit("13gram:"), first), first.isNotNull()).drop("_files", "_own"), "13gram:")


def _licensed(small: DataFrame, plan: Assembly) -> DataFrame:
    if not plan.release:
        return small
    lab = F.coalesce(_of(plan, lambda s: s.lab_only), F.lit(False))
    why = F.concat(F.lit("licence:"), "licence", F.when(F.col("flag") != "", F.concat(F.lit("/"), "flag")).otherwise(""))
    small = _dropped(small, why, lab | ~F.col("licence").isin(*RELEASED) | (F.col("flag") != ""))
    return small if plan.allow_generated else _dropped(small, "licence:GEN", F.col("generated"))


def _level(plan: Assembly) -> Column:
    return F.array_position(F.array(*[F.lit(s.name) for s in plan.sources]), F.col("source")) - 1


def _group(plan: Assembly) -> Column:
    return _of(plan, lambda s: s.group or s.name)


def _exact(small: DataFrame, plan: Assembly) -> DataFrame:
    """A text or item id that an earlier row has goes: training rows against other groups, validation rows against all training rows."""
    train = F.col("split") == "train"
    small = small.withColumns({"_g": _group(plan), "_t": train, "_o": F.struct((~train).alias("late"), _level(plan).alias("level"), "item_id", "row")})
    live = small.where("drop_reason is null")
    for key in ("exact", "item_id"):
        first = live.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("row", "source", "_g", "_t"), "_o").alias("_f"))
        excused = F.when(F.col("_t"), F.col("_f._g") == F.col("_g")).otherwise(~F.col("_f._t"))
        same = (F.col("_f.row") != F.col("row")) & ~excused
        small = _dropped(small.join(first, F.col(key) == F.col("_k"), "left"), F.concat(F.lit("dup_exact:"), "_f.source"), same).drop("_k", "_f")
    return _propagated(small.drop("_g", "_t", "_o"), "dup_exact:")


def _near(small: DataFrame, signs: DataFrame, plan: Assembly) -> DataFrame:
    """Rows that resemble a kept training row of an earlier source of another group, greedily in order of the sources.

    Rows of one source and split with equal signatures are one class. In each
    round a class with a kept earlier partner is dropped, and one without an open
    earlier partner is kept; the earliest open ones have none, so the rounds are
    as many as the sources of a chain of likenesses at most.
    """
    train = F.col("split") == "train"
    named = small.withColumn("c", F.md5(F.concat_ws("|", _level(plan), train, "sig").cast("binary")))
    classes = named.where("drop_reason is null and sig is not null").groupBy("c").agg(F.any_value("sig").alias("sig"), F.any_value(_group(plan)).alias("source"), F.any_value(_level(plan)).alias("first"), F.any_value(train).alias("answering"))
    one = signs.groupBy("sig").agg(F.any_value("s").alias("s"))
    state = _saved(classes.join(one, "sig").drop("sig").withColumns({"mark": F.lit("open"), "owner": F.lit(None).cast("long")}), "problems-classes")
    own = F.when(F.col("answering"), F.col("first")).otherwise(len(plan.sources))
    while state.where("mark = 'open'").limit(1).count():
        asked = state.where("mark <> 'dropped'").select("c", "source", "first", "s", (F.col("mark") == "open").alias("asks"), F.when(F.col("answering"), F.col("mark")).alias("answers"))
        met = first_alike(asked).groupBy("c").agg(F.min(F.when(F.col("answers") == "kept", F.col("like"))).alias("_kept"), F.min(F.when(F.col("answers") == "open", F.col("like"))).alias("_open"))
        gone, waits = F.col("_kept") < own, F.col("_open") < own
        mark = F.when(F.col("mark") != "open", F.col("mark")).when(gone, "dropped").when(waits, "open").otherwise("kept")
        owner = F.when(F.col("mark") != "open", F.col("owner")).when(gone, F.col("_kept"))
        state = _saved(state.join(met, "c", "left").select("c", "source", "first", "answering", "s", mark.alias("mark"), owner.alias("owner")), "problems-classes")
    names = F.array(*[F.lit(s.name) for s in plan.sources])
    gone = state.where("mark = 'dropped'").select("c", F.concat(F.lit("dup_near:"), F.get(names, F.col("owner").cast("int"))).alias("_why"))
    return _propagated(_dropped(named.join(gone, "c", "left"), F.col("_why"), F.col("_why").isNotNull()).drop("_why", "c"), "dup_near:")


def _filled(small: DataFrame, plan: Assembly, ranges: int) -> DataFrame:
    fill = plan.fill
    if not fill:
        return small
    amount = F.lit(1) if fill.unit == "rows" else F.col("chars")
    counted = (F.col("split") == "train") & ~F.col("policy") & ~F.coalesce(F.col("drop_reason").isin(*UNSELECTED), F.lit(False))
    kept = small.where(counted & F.col("drop_reason").isNull() & (F.col("source") != fill.source))
    have = kept.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("n")).first()["n"]
    per = small.where(counted & (F.col("source") == fill.source)).groupBy("source", "problem").agg(F.sum(amount).alias("amount"), F.max(F.col("drop_reason").isNotNull()).alias("dirty"))
    takes = F.when(~F.col("dirty"), F.col("amount")).otherwise(0)
    placed = _saved(in_hash_order(per, ["source"], hash_rank_key(plan.seed, F.col("source"), F.col("problem")), "problem", ranges, before={"before": takes}), "problems-fill")
    got = have + placed.where(F.col("before") + have < fill.target).agg(F.coalesce(F.sum(takes), F.lit(0)).alias("n")).first()["n"]
    if fill.least is not None and not fill.allow_short and got < fill.least * fill.target:
        raise ValueError(f"the fill reaches {got} of {fill.target} {fill.unit}, under the least share of {fill.least}")
    spare = placed.where(F.col("before") + have >= fill.target).select("source", "problem", F.lit("train").alias("split"), F.lit(True).alias("_spare"))
    return _dropped(small.join(spare, PROBLEM, "left"), "fill:not_needed", F.coalesce("_spare", F.lit(False))).drop("_spare")


def _split(small: DataFrame, plan: Assembly, ranges: int) -> DataFrame:
    """Per family, whole problems move from training to validation, in hash order."""
    if plan.val_share is None:
        return small
    finals = small.where("drop_reason is null and split = 'train' and kind = 'final'").select("family", "source", "problem").distinct()
    placed = in_hash_order(finals, ["family"], hash_rank_key(plan.seed, "val", F.col("source"), F.col("problem")), "problem", ranges, rank="_rank", size="_n")
    k = F.least(F.greatest(F.lit(plan.val_least), F.ceil(plan.val_share * F.col("_n"))), F.lit(plan.val_most), F.col("_n") - 1)
    chosen = placed.where(F.col("_rank") <= k).select("source", "problem").distinct().withColumns({"split": F.lit("train"), "_val": F.lit(True)})
    return small.join(chosen, PROBLEM, "left").withColumn("split", F.when(F.col("_val"), "val_from_train").otherwise(F.col("split"))).drop("_val")


def assemble_problems(rows: DataFrame, evals: DataFrame, plan: Assembly) -> DataFrame:
    """rows(source, split, problem, kind, item_id, text, family, licence, flag, generated, weight, labels, gold_label, teacher) and evals(file, item_id, text) to rows with weight, target, split, ``own_overlap`` and ``drop_reason``."""
    wrong = plan.check()
    if wrong:
        raise ValueError("; ".join(wrong))
    ranges = ranges_for(rows.count())
    small = _selected(rows, plan, ranges)
    signs = small.select("sig", "s").where("sig is not null")
    small = _saved(_screened(small.drop("s"), rows, evals, plan), "problems-screened")
    small = _saved(_exact(_licensed(small, plan), plan), "problems-exact")
    if plan.near:
        small = _near(small, signs, plan)
    small = small.withColumn("policy", (F.col("kind") == "node") & ~F.coalesce(_of(plan, lambda s: s.nodes), F.lit(True)))
    small = _saved(small, "problems-near")
    small = _saved(_filled(small, plan, ranges), "problems-filled")
    small = _dropped(_split(small, plan, ranges), "policy:nodes", F.col("policy"))
    return small.select(*SMALL, "own_overlap", "drop_reason")


def slice_shares(spark: SparkSession, out: DataFrame, plan: Assembly) -> DataFrame:
    """(slices, share, most, ok) of each cap: the share of training characters that its slices hold together."""
    kept = out.where("drop_reason is null and split = 'train'").withColumn("slice", _of(plan, lambda s: s.slice)).groupBy("slice").agg(F.sum("chars").alias("chars"))
    caps = spark.createDataFrame([(k, float(v)) for k, v in sorted(plan.caps.items())], "slices string, most double")
    held = caps.select("slices", "most", F.explode(F.split("slices", r"\+")).alias("slice")).join(kept, "slice", "left")
    total = kept.agg(F.greatest(F.sum("chars"), F.lit(1)).alias("n")).first()["n"] or 1
    shares = held.groupBy("slices", "most").agg(F.round(F.coalesce(F.sum("chars"), F.lit(0)) / total, 4).alias("share"))
    return shares.withColumn("ok", F.col("share") <= F.col("most"))
