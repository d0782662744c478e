"""Sampling, quotas, splits and order: all by digests of keys, so equal sets give equal choices.

Where a rule counts rows of a group, ranks come from a window over the group's
keys; quota rules that look at all groups at once work on the table of group
sizes, which is small, and join back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.hashing import hash_number, hash_rank_key
from granary.functions.ranges import in_hash_order, ranges_for
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()


def rank_key(seed: str, *cols: str) -> Column:
    return hash_rank_key(seed, *[F.col(c) for c in cols])


def sql_key(seed: str, *cols: str) -> str:
    return "md5(concat_ws('|', '" + seed + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


_K = sql_key("7", "source", "doc_id")


def ranked(df: DataFrame, by: list[str], key: Column, tie: str, name: str = "k") -> DataFrame:
    """Adds the 1-based rank of each row in its group, in order of ``key``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key, tie)))


def ranked_whole(df: DataFrame, by: list[str], key: Column, tie: str) -> DataFrame:
    """Adds the rank ``k`` of every row and the group's size ``n``. Where only the first few ranks are used, ``ranked`` is better, as its limit goes before the shuffle."""
    return in_hash_order(df, by, key, tie, ranges_for(df.count()), rank="k", size="n")


@CATALOG.query(f"SELECT doc_id, source, {_K} AS h FROM documents ORDER BY h, doc_id LIMIT 50 OFFSET 10")
def hash_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudo-random slice: md5 order, an offset, a count."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", rank_key("7", "source", "doc_id").alias("h"))
    return d.orderBy("h", "doc_id").offset(10).limit(50)


@CATALOG.query(f"SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY {_K}, doc_id) <= 3")
def stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three smallest hashes of each stratum; the rank limit prunes before the shuffle."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", "lang")
    return ranked(d, ["source", "lang"], rank_key("7", "source", "doc_id"), "doc_id").where("k <= 3").drop("k")


@CATALOG.query("SELECT doc_id, h FROM (SELECT doc_id, " + sql_key("r", "doc_id") + " AS h FROM documents) ORDER BY h, doc_id LIMIT 100")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of fixed size without a reservoir: the smallest hashes."""
    return Tables(spark, sf_dir).documents.select("doc_id", rank_key("r", "doc_id").alias("h")).orderBy("h", "doc_id").limit(100)


def largest_remainder(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """(key, n, quota): proportional whole quotas that add up to ``total``; ties of remainders to the smaller key."""
    share = F.col("n") * total / F.sum("n").over(Window.partitionBy())
    s = sizes.withColumn("share", share).withColumn("base", F.floor("share"))
    s = s.withColumn("left", F.lit(total) - F.sum("base").over(Window.partitionBy()))
    k = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), key))
    return s.withColumn("quota", F.col("base") + (k <= F.col("left")).cast("long")).select(key, "n", "quota")


_LR = "s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q0 AS (SELECT source, n, n * 77 / sum(n) OVER () AS share FROM s), q1 AS (SELECT *, floor(share) AS base FROM q0), q2 AS (SELECT *, 77 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY round(share - base, 9) DESC, source) AS k FROM q1), q AS (SELECT source, n, CAST(base + CAST(k <= rest AS INT) AS BIGINT) AS quota FROM q2)"


@CATALOG.query(f"WITH {_LR} SELECT source, n, quota FROM q")
def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_remainder(Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n")), "source", 77)


@CATALOG.query(f"WITH {_LR} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_K}, doc_id) AS r FROM documents) JOIN q USING (source) WHERE r <= quota")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in hash order up to their stratum's largest-remainder quota."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source")
    q = largest_remainder(d.groupBy("source").agg(F.count("*").alias("n")), "source", 77).select("source", "quota")
    return ranked_whole(d, ["source"], rank_key("7", "source", "doc_id"), "doc_id").join(q, "source").where("k <= quota").select("doc_id", "source")


@CATALOG.query(f"SELECT doc_id, source, r <= ceil(n * 0.1) AS small, r <= ceil(n * 0.3) AS medium FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_K}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= ceil(n * 0.3)")
def nested_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller stratified subset inside a larger one: one order, growing quotas."""
    d = ranked_whole(Tables(spark, sf_dir).documents.select("doc_id", "source"), ["source"], rank_key("7", "source", "doc_id"), "doc_id")
    return d.where(F.col("k") <= F.ceil(F.col("n") * 0.3)).select("doc_id", "source", (F.col("k") <= F.ceil(F.col("n") * 0.1)).alias("small"), F.lit(True).alias("medium"))


@CATALOG.query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_K}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= greatest(1, round_even(n * 0.05, 0))")
def stratified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of each language, one at least; halves round to even."""
    d = ranked_whole(Tables(spark, sf_dir).documents.select("doc_id", "lang", "source"), ["lang"], rank_key("7", "source", "doc_id"), "doc_id")
    return d.where(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.05))).select("doc_id", "lang")


@CATALOG.query("SELECT doc_id, CASE WHEN CAST(('0x' || right(sha1(CAST(doc_id AS VARCHAR)), 12)) AS BIGINT) % 1000 < 100 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation by thousandths of a digest of the id; needs no shuffle."""
    h = F.conv(F.right(F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit(12)), 16, 10).cast("long")
    return Tables(spark, sf_dir).documents.select("doc_id", F.when(h % 1000 < 100, "val").otherwise("train").alias("split"))


@CATALOG.query("SELECT doc_id, CAST(('0x' || substr(md5('fold|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM documents")
def hash_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", (hash_number(rank_key("fold", "doc_id")) % 5).alias("fold"))


_PS = "CAST(('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT)"


@CATALOG.query(f"SELECT conv_id, CASE WHEN {_PS} % 2 = 0 THEN CASE WHEN ({_PS} // 2) % 10 = 0 THEN 'val' ELSE 'train' END ELSE 'test' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def program_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even digests train, a share of them validates, odd ones test."""
    h = hash_number(F.md5(F.col("conv_id").cast("string").cast("binary")))
    train = F.when(F.floor(h / 2) % 10 == 0, "val").otherwise("train")
    return Tables(spark, sf_dir).conversations.select("conv_id").distinct().select("conv_id", F.when(h % 2 == 0, train).otherwise("test").alias("split"))


@CATALOG.query("WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 'g', lang, source)), source ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY lang) AS total FROM s) SELECT lang, source, n, before < 0.2 * total AS test FROM r")
def group_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups go to test in hash order until the share is reached; works on group sizes."""
    s = Tables(spark, sf_dir).documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    before = F.sum("n").over(w.orderBy(rank_key("g", "lang", "source"), "source").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return s.select("lang", "source", "n", (before < 0.2 * F.sum("n").over(w)).alias("test"))


@CATALOG.query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT lang, least(greatest(5, ceil(0.02 * n)), 200, n - 1) AS k FROM n) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 'val', lang, CAST(doc_id AS VARCHAR))), doc_id) <= k AS val FROM documents JOIN k USING (lang)")
def family_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family max(least, ceil(share n)), capped, and at most n - 1, in hash order."""
    d = ranked_whole(Tables(spark, sf_dir).documents.select("doc_id", "lang"), ["lang"], rank_key("val", "lang", "doc_id"), "doc_id")
    k = F.least(F.greatest(F.lit(5), F.ceil(0.02 * F.col("n"))), F.lit(200), F.col("n") - 1)
    return d.where("lang is not null").select("doc_id", "lang", (F.col("k") <= k).alias("val"))


@CATALOG.query("WITH q AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, source) AS k FROM q) SELECT f.lang AS fold, count(*) AS n_train, count(DISTINCT d.source) AS n_sources FROM (SELECT DISTINCT lang FROM documents) f JOIN d ON d.lang <> f.lang AND d.k <= 100 GROUP BY f.lang")
def lofo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one group out: each fold trains on the other groups, each capped, its question groups (sources) taking turns. The join is on the few group names.

    Ranks beyond the cap go inside each source, whose limit goes before the shuffle, so the second window holds ``cap`` rows a source at most.
    """
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "source").where("lang is not null")
    turns = d.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))).where("r <= 100")
    capped = turns.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("r", "source"))).where("k <= 100")
    names = d.select("lang").distinct().withColumn("all", F.collect_set("lang").over(Window.partitionBy()))
    folds = names.select("lang", F.explode("all").alias("fold")).where("fold <> lang")
    return capped.join(folds, "lang").groupBy("fold").agg(F.count("*").alias("n_train"), F.count_distinct("source").alias("n_sources"))


@CATALOG.query(f"SELECT doc_id, source, row_number() OVER (ORDER BY k, source) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_K}, doc_id) AS k FROM documents)")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all sources, interleaved a0 b0 c0 a1 ..., each source in hash order.

    A row's place follows from counts alone: before it come, of every source,
    its first k - 1 rows or all it has, and the k-th of sources with smaller
    names. Both sums are made per k from the table of source sizes.
    """
    d = ranked_whole(Tables(spark, sf_dir).documents.select("doc_id", "source"), ["source"], rank_key("7", "source", "doc_id"), "doc_id").drop("n")
    # One row per round: how many sources take part in it.
    rounds = d.groupBy("k").agg(F.count("*").alias("m"))
    ends = rounds.groupBy("m").agg(F.count("*").alias("len"), F.min("k").alias("first"))
    # Rounds with equally many sources follow each other, so there are at most as many runs as sources.
    runs = ends.select("m", "first", (F.sum(F.col("m") * F.col("len")).over(Window.orderBy("first")) - F.col("m") * F.col("len")).alias("before"))
    size = d.groupBy("source").agg(F.count("*").alias("n"))
    names = size.select("source", F.collect_list("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)).alias("sizes"))
    at = d.join(rounds, "k").join(runs, "m").join(names, "source")
    ahead = F.size(F.filter("sizes", lambda n: n >= F.col("k")))
    return at.select("doc_id", "source", (F.col("before") + (F.col("k") - F.col("first")) * F.col("m") + ahead + 1).cast("long").alias("place"))


@CATALOG.query("SELECT doc_id, unnest(range(CASE lang WHEN 'de' THEN 2 WHEN 'en' THEN CAST(CAST(('0x' || substr(md5('third|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 = 0 AS INT) ELSE 1 END)) AS copy FROM documents")
def upsample_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family twice, a third of another by hash, the rest once."""
    n = F.when(F.col("lang") == "de", 2).when(F.col("lang") == "en", (hash_number(rank_key("third", "doc_id")) % 3 == 0).cast("int")).otherwise(1)
    copies = F.slice(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.lit(1), n)
    return Tables(spark, sf_dir).documents.select("doc_id", F.explode(copies).alias("copy"))


@CATALOG.query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'b', CAST(vec_id AS VARCHAR))), vec_id) AS k, count(*) OVER () AS n FROM embeddings) WHERE k <= 0.9 * n / (SELECT count(DISTINCT label) FROM embeddings)")
def outcome_balanced_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most balance * n / outcomes rows per outcome."""
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "label")
    size = e.groupBy("label").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("outcomes"))
    return ranked_whole(e, ["label"], rank_key("b", "vec_id"), "vec_id").drop("n").join(size).where(F.col("k") <= 0.9 * F.col("n") / F.col("outcomes")).select("vec_id", "label")


@CATALOG.query("WITH t AS (SELECT conv_id, turn, floor(10 * (turn - min(turn) OVER w) / greatest(1, max(turn) OVER w - min(turn) OVER w + 1)) AS bin FROM conversations WINDOW w AS (PARTITION BY conv_id)), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', 'p', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), conv_id, turn) AS k FROM t) SELECT conv_id, turn, CAST(bin AS BIGINT) AS bin FROM r WHERE k <= 10")
def position_balanced_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal quotas over ten bins of relative position."""
    w = Window.partitionBy("conv_id")
    span = F.greatest(F.lit(1), F.max("turn").over(w) - F.min("turn").over(w) + 1)
    t = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.floor(10 * (F.col("turn") - F.min("turn").over(w)) / span).alias("bin"))
    k = F.row_number().over(Window.partitionBy("bin").orderBy(rank_key("p", "conv_id", "turn"), "conv_id", "turn"))
    return t.withColumn("k", k).where("k <= 10").select("conv_id", "turn", "bin")


@CATALOG.query("SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY " + sql_key("m", "c_custkey") + ", c_custkey) AS place FROM customer")
def hash_ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their place in hash order: equal sets give equal files."""
    d = Tables(spark, sf_dir).customer.select("c_nationkey", "c_custkey")
    return in_hash_order(d, [], rank_key("m", "c_custkey"), "c_custkey", ranges_for(d.count()), rank="place").select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"))


def filled(rows: DataFrame, key: str, weight: Column, limit: Column, total: Column) -> DataFrame:
    """(key, share): ``total`` split in proportion to the weights, no share over its limit.

    Keys are sorted by limit over weight. Were all earlier ones at their limits,
    what is left gives the rest a common level; a key whose own ratio lies under
    that level is at its limit too, and the first that is not sets the level of
    all others. Works on a table with a row per key.
    """
    w = Window.partitionBy().orderBy("_ratio", key)
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select(key, weight.alias("_w"), limit.alias("_l"), total.alias("_t")).withColumn("_ratio", F.try_divide("_l", "_w"))
    left = F.col("_t") - F.coalesce(F.sum("_l").over(ahead), F.lit(0.0))
    heavy = F.sum("_w").over(Window.partitionBy()) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))
    level = sums.withColumn("_level", F.try_divide(left, heavy))
    opened = level.withColumn("_open", F.col("_ratio") >= F.col("_level"))
    common = F.min(F.when(F.col("_open"), F.struct("_ratio", key, "_level"))).over(Window.partitionBy())["_level"]
    return opened.select(key, F.when(F.col("_open"), F.col("_w") * common).otherwise(F.col("_l")).alias("share"))


_FILL = "s AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY source), t AS (SELECT *, 0.45 * median(w) OVER () AS l, 0.5 * sum(w) OVER () AS total FROM s)"


@CATALOG.query(f"""
WITH {_FILL}, c AS (SELECT DISTINCT l / w AS u FROM t), f AS (SELECT u, (SELECT sum(least(l, u * w)) FROM t) AS got FROM c),
a AS (SELECT max(u) AS u0, max(got) AS g0 FROM f WHERE got <= (SELECT max(total) FROM t)),
b AS (SELECT coalesce(u0, 0) AS u0, (SELECT max(total) FROM t) - coalesce(g0, 0) AS rest, (SELECT sum(w) FROM t WHERE l / w > coalesce(u0, 0)) AS open FROM a)
SELECT source, round(least(l, w * (u0 + coalesce(rest / open, 0))), 4) AS share FROM t, b
""")
def waterfill_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of half of all characters by source under a limit per source; the SQL finds the level by trying every source's ratio."""
    s = Tables(spark, sf_dir).documents.groupBy("source").agg(F.sum("n_chars").cast("double").alias("w"))
    whole = Window.partitionBy()
    t = s.select("source", "w", (0.45 * F.percentile("w", 0.5).over(whole)).alias("l"), (0.5 * F.sum("w").over(whole)).alias("t"))
    return filled(t, "source", F.col("w"), F.col("l"), F.col("t")).select("source", F.round("share", 4).alias("share"))


def equal_quotas(sizes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, quota): ``n`` rows over strata of ``sizes(keys, n)``, as equal as sizes allow; what is left over goes one each to the first open names."""
    every = Window.partitionBy()
    w = every.orderBy("n", *keys)
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.lit(n).cast("long"), F.sum("n").over(every))
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    level = F.floor((want - before) / (F.count("*").over(every) - F.row_number().over(w) + 1))
    s = sizes.withColumns({"_want": want, "_level": level}).withColumn("_open", F.col("n") > F.col("_level"))
    least = F.min(F.when(F.col("_open"), F.struct("n", *keys, "_level"))).over(every)["_level"]
    closed = F.sum(F.when(~F.col("_open"), F.col("n")).otherwise(0)).over(every)
    rest = F.col("_want") - closed - least * F.sum(F.col("_open").cast("long")).over(every)
    place = F.row_number().over(Window.partitionBy("_open").orderBy(*keys))
    return s.select(*keys, F.when(F.col("_open"), least + (place <= rest).cast("long")).otherwise(F.col("n")).alias("quota"))


@CATALOG.query("""
WITH s AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), w AS (SELECT least(200, sum(n)) AS want FROM s),
l AS (SELECT max(r) AS level FROM range(201) t(r), w WHERE (SELECT sum(least(n, r)) FROM s) <= want),
x AS (SELECT lang, source, n, level, want - (SELECT sum(least(n, level)) FROM s) AS rest, CASE WHEN n > level THEN row_number() OVER (PARTITION BY n > level ORDER BY lang, source) END AS k FROM s, l, w),
q AS (SELECT lang, source, least(n, level) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS quota FROM x),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY """ + sql_key("e", "doc_id") + """, doc_id) AS k FROM documents)
SELECT doc_id, lang, source FROM r JOIN q USING (lang, source) WHERE k <= quota
""")
def stratified_equal_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 rows over languages and sources as evenly as sizes allow, in hash order."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "source").where("lang is not null and source is not null")
    q = equal_quotas(d.groupBy("lang", "source").agg(F.count("*").alias("n")), ["lang", "source"], 200)
    return ranked(d, ["lang", "source"], rank_key("e", "doc_id"), "doc_id").where("k <= 200").join(q, ["lang", "source"]).where("k <= quota").select("doc_id", "lang", "source")


def token_budget_batches(rows: DataFrame, group: list[str], length: str, key: str, budget: int, most: int) -> DataFrame:
    """Longest-first batches with (n + 1) * longest <= budget and at most ``most`` rows, within groups of bounded size; adds ``batch``."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], ascending=[False, True]).reset_index(drop=True)
        batch, n, longest, out = 0, 0, 0, []
        for size in pdf[length]:
            if n and ((n + 1) * longest > budget or n >= most):
                batch, n = batch + 1, 0
            longest = longest if n else int(size)
            n += 1
            out.append(batch)
        return pdf.assign(batch=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    return rows.groupBy(*group).applyInPandas(cut, schema)


@CATALOG.query()
def token_budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of documents by length within hash groups of about 20,000 rows."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars")
    groups = max(1, d.count() // 20_000)
    return token_budget_batches(d.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups))), ["grp"], "n_chars", "doc_id", 65_536, 64).select("doc_id", "n_chars", "grp", "batch")


@CATALOG.query("WITH b AS (SELECT (row_number() OVER (PARTITION BY source ORDER BY " + _K + ", doc_id) - 1) // 8 AS mb, source, n_chars FROM documents), m AS (SELECT source, mb, max(n_chars) * count(*) AS padded, sum(n_chars) AS real FROM b GROUP BY ALL) SELECT source, CAST(sum(padded) AS BIGINT) AS padded, CAST(sum(real) AS BIGINT) AS real, round(sum(padded) / sum(real), 6) AS cost FROM m GROUP BY source")
def padding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded against real length of micro-batches of eight in random order."""
    d = ranked_whole(Tables(spark, sf_dir).documents.select("doc_id", "source", "n_chars"), ["source"], rank_key("7", "source", "doc_id"), "doc_id")
    m = d.groupBy("source", F.floor((F.col("k") - 1) / 8).alias("mb")).agg((F.max("n_chars") * F.count("*")).alias("padded"), F.sum("n_chars").alias("real"))
    return m.groupBy("source").agg(F.sum("padded").alias("padded"), F.sum("real").alias("real"), F.round(F.sum("padded") / F.sum("real"), 6).alias("cost"))


@CATALOG.query("WITH t AS (SELECT doc_id, lang, n_chars, ntile(3) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS tercile FROM documents) SELECT doc_id, lang, tercile FROM t QUALIFY row_number() OVER (PARTITION BY lang, tercile ORDER BY md5(concat_ws('|', 'w', CAST(doc_id AS VARCHAR))), doc_id) <= 5")
def worklist_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each language and length tercile."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "n_chars").withColumn("tercile", F.ntile(3).over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")).cast("long"))
    return ranked(d, ["lang", "tercile"], rank_key("w", "doc_id"), "doc_id").where("k <= 5").select("doc_id", "lang", "tercile")
