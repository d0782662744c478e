"""Scoring of predictions: accuracy, calibration, ranks, cascades and readouts.

The tables at hand hold no predictions, so the queries derive some from
``embeddings``: for each of three seeds a window of components, as logits over
four options; the label gives the gold option and the group. One prediction in
17 is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import prob as P
from granary.functions.arrays import first_argmax, let, total
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()
SEEDS, OPTIONS = 3, 4


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, grp, gold)."""
    return Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").alias("grp"), (F.col("label") % OPTIONS).alias("gold"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, item_id, grp, gold, probs)."""
    e = Tables(spark, sf_dir).embeddings
    seeded = e.select(F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"), "vec_id", "label", "embedding").where((F.col("vec_id") + F.col("seed")) % 17 != 0)
    raw = F.transform(F.slice("embedding", OPTIONS * F.col("seed") + 1, F.lit(OPTIONS)), lambda x: F.exp(x.cast("double") * 8))
    probs = let(raw, lambda e: F.transform(e, lambda x: F.round(x / total(e), 6)))
    return seeded.select("seed", F.col("vec_id").alias("item_id"), F.col("label").alias("grp"), (F.col("label") % OPTIONS).alias("gold"), probs.alias("probs"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with top option, confidence, gold probability and whether they are right."""
    p = predictions(spark, sf_dir).withColumn("top", first_argmax(F.col("probs")))
    return p.withColumns({"conf": F.array_max("probs"), "pg": P.gold_probability(F.col("probs"), F.col("gold")), "correct": (F.col("top") == F.col("gold")).cast("int")})


PREDS = f"""
WITH preds AS (SELECT s AS seed, vec_id AS item_id, label AS grp, label % {OPTIONS} AS gold, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS probs
  FROM (SELECT CAST(s AS INTEGER) AS s, vec_id, label, list_transform(embedding[{OPTIONS} * s + 1:{OPTIONS} * s + {OPTIONS}], lambda x: exp(CAST(x AS DOUBLE) * 8)) AS e FROM embeddings, range({SEEDS}) r(s)) WHERE (vec_id + s) % 17 <> 0),
sc AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS top, list_max(probs) AS conf, probs[gold + 1] AS pg,
  CAST(list_position(probs, list_max(probs)) - 1 = gold AS INTEGER) AS correct FROM preds)
"""


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


@CATALOG.query(PREDS + "SELECT seed, count(*) AS n, round(avg(correct), 6) AS acc FROM sc GROUP BY seed")
def top1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("n"), r6(F.avg("correct")).alias("acc"))


@CATALOG.query(PREDS + f"SELECT s AS seed, round(avg(coalesce(correct, 0)), 6) AS acc_all, count(correct) AS n_answered, round(avg(-ln(greatest(pg, 1e-12))), 6) AS nll FROM embeddings CROSS JOIN (SELECT CAST(s AS INTEGER) AS s FROM range({SEEDS}) r(s)) LEFT JOIN sc ON vec_id = item_id AND seed = s GROUP BY s")
def acc_all_missing_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing predictions are wrong for accuracy and absent from the likelihood."""
    every = items(spark, sf_dir).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
    both = every.join(scored(spark, sf_dir).select("item_id", "seed", "correct", "pg"), ["item_id", "seed"], "left")
    return both.groupBy("seed").agg(r6(F.avg(F.coalesce("correct", F.lit(0)))).alias("acc_all"), F.count("correct").alias("n_answered"), r6(F.avg(-F.log(F.greatest("pg", F.lit(P.FLOOR))))).alias("nll"))


@CATALOG.query(PREDS + "SELECT seed, round(avg(-ln(greatest(pg, 1e-12))), 6) AS nll, round(avg(list_sum(list_transform(probs, lambda p, i: (p - CASE WHEN i - 1 = gold THEN 1 ELSE 0 END) ** 2))), 6) AS brier FROM sc GROUP BY seed")
def nll_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.groupBy("seed").agg(r6(F.avg(P.nll(F.col("probs"), F.col("gold")))).alias("nll"), r6(F.avg(P.brier(F.col("probs"), F.col("gold")))).alias("brier"))


def _ece(rows: DataFrame, bin_: Column) -> DataFrame:
    per = rows.groupBy("seed", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("correct").alias("a"))
    return per.groupBy("seed").agg(r6(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.count("*").alias("n_bins"))


_ECE_SQL = "SELECT seed, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, count(*) AS n_bins FROM (SELECT seed, {bin} AS bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM sc GROUP BY ALL) GROUP BY seed"


@CATALOG.query(PREDS + _ECE_SQL.format(bin="least(len(list_filter(range(1, 16), lambda k: k / 15.0::DOUBLE < conf)), 14)"))
def ece15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ece(scored(spark, sf_dir), P.bin_right_closed(F.col("conf")))


@CATALOG.query(PREDS + _ECE_SQL.format(bin="least(floor(conf * 10), 9)"))
def ece10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ece(scored(spark, sf_dir), P.bin_left_closed(F.col("conf")))


@CATALOG.query(PREDS + f"SELECT seed, round(avg(list_sum(list_transform(probs, lambda p, i: CASE WHEN i - 1 = gold THEN 0.9 * ln(0.9 / greatest(p, 1e-12)) WHEN i - 1 = (gold + 1) % {OPTIONS} THEN 0.1 * ln(0.1 / greatest(p, 1e-12)) ELSE 0 END))), 6) AS kl FROM sc GROUP BY seed")
def kl_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KL of a soft gold (0.9 on the gold option, 0.1 on the next) to the prediction."""
    gold = F.transform(F.sequence(F.lit(0), F.lit(OPTIONS - 1)), lambda i: F.when(i == F.col("gold"), 0.9).when(i == (F.col("gold") + 1) % OPTIONS, 0.1).otherwise(0.0))
    return predictions(spark, sf_dir).groupBy("seed").agg(r6(F.avg(P.kl(gold, F.col("probs")))).alias("kl"))


@CATALOG.query(PREDS + "SELECT seed, grp, gold, count(*) AS n, round(avg(correct), 6) AS acc FROM sc GROUP BY GROUPING SETS ((seed), (seed, grp), (seed, gold))")
def scorecard_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, each group and each gold type from one pass."""
    s = scored(spark, sf_dir)
    return s.groupingSets([["seed"], ["seed", "grp"], ["seed", "gold"]], "seed", "grp", "gold").agg(F.count("*").alias("n"), r6(F.avg("correct")).alias("acc"))


@CATALOG.query(PREDS + "SELECT seed, round(avg(CASE WHEN probs[1] BETWEEN 0.2 AND 0.8 THEN 0 ELSE CAST((probs[1] > 0.8) = (gold = 0) AS INTEGER) END), 6) AS acc, count(*) FILTER (probs[1] BETWEEN 0.2 AND 0.8) AS n_abstained FROM sc GROUP BY seed")
def abstain_as_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no reading of the first option: answers between 0.2 and 0.8 are abstentions and count as wrong."""
    p = F.get("probs", F.lit(0))
    unsure = p.between(0.2, 0.8)
    right = F.when(unsure, 0).otherwise(((p > 0.8) == (F.col("gold") == 0)).cast("int"))
    return scored(spark, sf_dir).groupBy("seed").agg(r6(F.avg(right)).alias("acc"), F.count_if(unsure).alias("n_abstained"))


@CATALOG.query(PREDS + "SELECT seed, round(sum(w * 100 * (a - 0.25) / 0.75) / sum(w), 6) AS idx, round(sum(w * greatest(100 * (a - 0.25) / 0.75, 0)) / sum(w), 6) AS idx_clipped FROM (SELECT seed, grp, avg(correct) AS a, CAST(1 + grp AS DOUBLE) AS w FROM sc GROUP BY seed, grp) GROUP BY seed")
def chance_corrected_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over tiers of accuracy above chance in percent, plain and clipped at 0."""
    tiers = scored(spark, sf_dir).groupBy("seed", "grp").agg(F.avg("correct").alias("a")).withColumn("w", (1 + F.col("grp")).cast("double"))
    over = 100 * (F.col("a") - 1 / OPTIONS) / (1 - 1 / OPTIONS)
    return tiers.groupBy("seed").agg(r6(F.sum(F.col("w") * over) / F.sum("w")).alias("idx"), r6(F.sum(F.col("w") * F.greatest(over, F.lit(0.0))) / F.sum("w")).alias("idx_clipped"))


@CATALOG.query(PREDS + "SELECT seed, round(avg(a), 6) AS macro_acc, count(*) AS n_groups FROM (SELECT seed, grp, avg(correct) AS a FROM sc GROUP BY ALL) GROUP BY seed")
def macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("seed", "grp").agg(F.avg("correct").alias("a")).groupBy("seed").agg(r6(F.avg("a")).alias("macro_acc"), F.count("*").alias("n_groups"))


@CATALOG.query(PREDS + "SELECT grp AS depth, count(*) AS n, round(avg(correct), 6) AS acc, round(avg(conf), 12) AS conf FROM sc GROUP BY grp")
def accuracy_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(F.col("grp").alias("depth")).agg(F.count("*").alias("n"), r6(F.avg("correct")).alias("acc"), F.round(F.avg("conf"), 12).alias("conf"))


@CATALOG.query(PREDS + """, v AS (SELECT seed, conf, count(*) AS n, sum(correct) AS pos FROM sc GROUP BY seed, conf),
c AS (SELECT *, sum(n - pos) OVER (PARTITION BY seed ORDER BY conf ROWS UNBOUNDED PRECEDING) - (n - pos) AS below FROM v)
SELECT seed, round(sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)), 6) AS auroc FROM c GROUP BY seed""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney of confidence for right over wrong, ties a half, from counts by distinct value."""
    v = scored(spark, sf_dir).groupBy("seed", "conf").agg(F.count("*").alias("n"), F.sum("correct").alias("pos"))
    neg = F.col("n") - F.col("pos")
    c = v.withColumn("below", F.sum(neg).over(Window.partitionBy("seed").orderBy("conf").rowsBetween(Window.unboundedPreceding, 0)) - neg)
    return c.groupBy("seed").agg(r6(F.sum(F.col("pos") * (F.col("below") + neg / 2)) / (F.sum("pos") * F.sum(neg))).alias("auroc"))


_RANKED = PREDS + f", o AS (SELECT seed, item_id, grp, gold, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS pos FROM preds), rk AS (SELECT *, row_number() OVER (PARTITION BY seed, item_id ORDER BY p DESC, pos) AS rank FROM o), g AS (SELECT * FROM rk WHERE pos = gold) "


def option_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per option with its rank: falling probability, the earlier option first."""
    o = predictions(spark, sf_dir).select("seed", "item_id", "grp", "gold", F.posexplode("probs").alias("pos", "p"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("seed", "item_id").orderBy(F.desc("p"), "pos")))


@CATALOG.query(_RANKED + "SELECT seed, round(avg(CAST(rank <= 1 AS INT)), 6) AS hit1, round(avg(CAST(rank <= 2 AS INT)), 6) AS hit2, round(avg(CAST(rank <= 3 AS INT)), 6) AS hit3, round(avg(CASE WHEN rank <= 3 THEN 1.0 / rank ELSE 0 END), 6) AS mrr3 FROM g GROUP BY seed")
def hit_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = option_ranks(spark, sf_dir).where("pos = gold")
    hits = [r6(F.avg((F.col("rank") <= k).cast("int"))).alias(f"hit{k}") for k in (1, 2, 3)]
    return g.groupBy("seed").agg(*hits, r6(F.avg(F.when(F.col("rank") <= 3, 1 / F.col("rank")).otherwise(0.0))).alias("mrr3"))


@CATALOG.query(_RANKED + "SELECT seed, item_id, CAST(pos AS INTEGER) AS pos, rank FROM rk WHERE rank <= 2")
def rank_within_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return option_ranks(spark, sf_dir).where("rank <= 2").select("seed", "item_id", "pos", F.col("rank").cast("long").alias("rank"))


@CATALOG.query(PREDS + "SELECT seed, round(avg(CAST(abs(top - gold) <= 0 AS INT)), 6) AS tol0, round(avg(CAST(abs(top - gold) <= 1 AS INT)), 6) AS tol1, round(avg(CAST(abs(top - gold) <= 2 AS INT)), 6) AS tol2 FROM sc GROUP BY seed")
def tolerance_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.abs(F.col("top") - F.col("gold"))
    return scored(spark, sf_dir).groupBy("seed").agg(*[r6(F.avg((apart <= k).cast("int"))).alias(f"tol{k}") for k in (0, 1, 2)])


@CATALOG.query(PREDS + f"SELECT seed, bin, count(*) AS n FROM (SELECT seed, CASE WHEN top < gold THEN 'early' WHEN top > gold THEN 'late' ELSE 'exact' END || ':' || CAST(CAST(floor((top - gold) / {OPTIONS - 1}.0 * 4) AS INT) AS VARCHAR) AS bin FROM sc) GROUP BY ALL")
def signed_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("top") - F.col("gold")
    side = F.when(gap < 0, "early").when(gap > 0, "late").otherwise("exact")
    bin_ = F.concat(side, F.lit(":"), F.floor(gap / (OPTIONS - 1) * 4).cast("int").cast("string"))
    return scored(spark, sf_dir).groupBy("seed", bin_.alias("bin")).agg(F.count("*").alias("n"))


@CATALOG.query(f"""
WITH it AS (SELECT label % {OPTIONS} AS gold FROM embeddings), c AS (SELECT k, avg(CAST(gold = k AS INT)) AS acc FROM it, (SELECT CAST(k AS INT) AS k FROM range({OPTIONS}) r(k)) GROUP BY k)
SELECT 'first' AS baseline, round((SELECT avg(CAST(gold = 0 AS INT)) FROM it), 6) AS acc UNION ALL SELECT 'last', round((SELECT avg(CAST(gold = {OPTIONS - 1} AS INT)) FROM it), 6)
UNION ALL SELECT 'random', round(1.0 / {OPTIONS}, 6) UNION ALL SELECT 'best_constant:' || (SELECT CAST(arg_max(k, (acc, -k)) AS VARCHAR) FROM c), round((SELECT max(acc) FROM c), 6)
""")
def trivial_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, random and the best constant option; ties to the smaller index."""
    it = items(spark, sf_dir).withColumn("all", F.lit(1))
    c = it.select("gold", F.explode(F.sequence(F.lit(0), F.lit(OPTIONS - 1))).alias("k")).groupBy("k").agg(F.avg((F.col("gold") == F.col("k")).cast("int")).alias("acc"))
    best = c.agg(F.max_by("k", F.struct("acc", -F.col("k"))).alias("k"), F.max("acc").alias("acc")).select(F.concat(F.lit("best_constant:"), F.col("k").cast("string")).alias("baseline"), r6("acc").alias("acc"))
    plain = it.agg(*[F.avg((F.col("gold") == k).cast("int")).alias(n) for k, n in ((0, "first"), (OPTIONS - 1, "last"))], F.lit(1 / OPTIONS).alias("random"))
    return plain.unpivot([], ["first", "last", "random"], "baseline", "acc").select("baseline", r6("acc").alias("acc")).unionByName(best)


@CATALOG.query(PREDS + """, t AS (SELECT i / 20.0 AS tau FROM range(6, 20) r(i) UNION ALL SELECT unnest([0.0, 0.99, 1.01])),
small AS (SELECT * FROM sc WHERE seed = 0), big AS (SELECT item_id, correct AS big FROM sc WHERE seed = 1)
SELECT CAST(tau AS DOUBLE) AS tau, round(avg(CAST(conf < tau AS INT)), 6) AS deferral, round(avg(CASE WHEN conf < tau THEN coalesce(big, 0) ELSE correct END), 6) AS acc, round(sum(CASE WHEN conf < tau THEN 0.004 ELSE 0.001 END) / count(*) * 1000, 6) AS usd_per_1k
FROM small LEFT JOIN big USING (item_id) CROSS JOIN t GROUP BY tau""")
def cascade_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deferral to a larger model below 17 confidence thresholds; deferred items without an answer are wrong."""
    s = scored(spark, sf_dir)
    taus = [0.0, *[i / 20 for i in range(6, 20)], 0.99, 1.01]
    both = s.where("seed = 0").join(s.where("seed = 1").select("item_id", F.col("correct").alias("big")), "item_id", "left")
    each = both.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    defer = F.col("conf") < F.col("tau")
    return each.groupBy("tau").agg(r6(F.avg(defer.cast("int"))).alias("deferral"), r6(F.avg(F.when(defer, F.coalesce("big", F.lit(0))).otherwise(F.col("correct")))).alias("acc"), r6(F.sum(F.when(defer, 0.004).otherwise(0.001)) / F.count("*") * 1000).alias("usd_per_1k"))


@CATALOG.query(PREDS + """, grid AS (SELECT i AS cell, 0.5 + 0.05 * i AS t FROM range(51) r(i)),
z AS (SELECT seed, cell, t, gold, list_transform(probs, lambda p: greatest(p, 1e-12) ** (1 / t)) AS e FROM preds CROSS JOIN grid),
n AS (SELECT seed, cell, t, round(avg(-ln(greatest(e[gold + 1] / list_sum(e), 1e-12))), 9) AS nll FROM z GROUP BY ALL)
SELECT seed, round(arg_min(t, (nll, cell)), 6) AS temperature, round(min(nll), 6) AS nll FROM n GROUP BY seed""")
def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of least likelihood loss on a grid of 51; the first of equals."""
    each = predictions(spark, sf_dir).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(50)))).withColumn("t", 0.5 + 0.05 * F.col("cell"))
    soft = let(F.transform("probs", lambda p: F.pow(F.greatest(p, F.lit(P.FLOOR)), 1 / F.col("t"))), lambda e: F.get(e, F.col("gold")) / total(e))
    n = each.groupBy("seed", "cell", "t").agg(F.round(F.avg(-F.log(F.greatest(soft, F.lit(P.FLOOR)))), 9).alias("nll"))
    return n.groupBy("seed").agg(r6(F.min_by("t", F.struct("nll", "cell"))).alias("temperature"), r6(F.min("nll")).alias("nll"))


@CATALOG.query(PREDS + ", m AS (SELECT grp, avg(correct) FILTER (seed = 0) AS cand, avg(correct) FILTER (seed = 1) AS ref1, avg(correct) FILTER (seed = 2) AS ref2 FROM sc GROUP BY grp) SELECT avg(cand) > avg(ref1) AND avg(cand) > avg(ref2) AND bool_and(cand >= greatest(ref1, ref2) - 0.02) AS released, round(avg(cand), 6) AS cand, round(avg(ref1), 6) AS ref1, round(avg(ref2), 6) AS ref2 FROM m")
def release_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate goes out if it beats both references on the mean and no set drops over two points below the better one."""
    m = scored(spark, sf_dir).groupBy("grp").pivot("seed", [0, 1, 2]).agg(F.avg("correct")).toDF("grp", "cand", "ref1", "ref2")
    rule = (F.avg("cand") > F.avg("ref1")) & (F.avg("cand") > F.avg("ref2")) & F.every(F.col("cand") >= F.greatest("ref1", "ref2") - 0.02)
    return m.agg(rule.alias("released"), *[r6(F.avg(c)).alias(c) for c in ("cand", "ref1", "ref2")])


@CATALOG.query(PREDS + ", o AS (SELECT seed, item_id, gold, list_transform(probs, lambda p: round(p, 1)) AS q FROM preds) SELECT seed, round(avg(CASE WHEN q[gold + 1] >= list_max(q) - 1e-9 THEN 1.0 / len(list_filter(q, lambda x: x >= list_max(q) - 1e-9)) ELSE 0 END), 6) AS credit, round(avg(1 + len(list_filter(q, lambda x: x > q[gold + 1]))), 6) AS best_rank, round(avg(len(list_filter(q, lambda x: x >= q[gold + 1]))), 6) AS worst_rank FROM o GROUP BY seed")
def tie_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected credit where the gold option ties for the top, and best and worst rank, on probabilities in tenths."""
    q = predictions(spark, sf_dir).withColumn("q", F.transform("probs", lambda p: F.round(p, 1)))
    g, top = F.get("q", F.col("gold")), F.array_max("q")
    tied = F.size(F.filter("q", lambda x: x >= top - 1e-9))
    return q.groupBy("seed").agg(
        r6(F.avg(F.when(g >= top - 1e-9, 1 / tied).otherwise(0.0))).alias("credit"),
        r6(F.avg(1 + F.size(F.filter("q", lambda x: x > g)))).alias("best_rank"),
        r6(F.avg(F.size(F.filter("q", lambda x: x >= g)))).alias("worst_rank"),
    )


@CATALOG.query(PREDS + ", a AS (SELECT item_id, top AS ta, correct AS ca FROM sc WHERE seed = 0), b AS (SELECT item_id, top AS tb, correct AS cb FROM sc WHERE seed = 1) SELECT count(*) AS n, round(avg(ca * cb), 6) AS both_right, round(avg(ca) * avg(cb), 6) AS independent, round(avg(CAST(ta <> tb AS INT)), 6) AS changed, round(avg(CASE WHEN ca = 1 THEN cb END), 6) AS follow FROM a JOIN b USING (item_id)")
def counterfactual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and other answers of the same item: both right, the product if independent, changes, and right after right."""
    s = scored(spark, sf_dir)
    a = s.where("seed = 0").select("item_id", F.col("top").alias("ta"), F.col("correct").alias("ca"))
    b = s.where("seed = 1").select("item_id", F.col("top").alias("tb"), F.col("correct").alias("cb"))
    return a.join(b, "item_id").agg(F.count("*").alias("n"), r6(F.avg(F.col("ca") * F.col("cb"))).alias("both_right"), r6(F.avg("ca") * F.avg("cb")).alias("independent"), r6(F.avg((F.col("ta") != F.col("tb")).cast("int"))).alias("changed"), r6(F.avg(F.when(F.col("ca") == 1, F.col("cb")))).alias("follow"))


@CATALOG.query(PREDS + "SELECT grp, round(avg(correct) FILTER (seed = 0), 6) AS s0, round(avg(correct) FILTER (seed = 1), 6) AS s1, round(avg(correct) FILTER (seed = 2), 6) AS s2 FROM sc GROUP BY grp")
def accuracy_table_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("grp").pivot("seed", [0, 1, 2]).agg(r6(F.avg("correct"))).toDF("grp", "s0", "s1", "s2")


@CATALOG.query(PREDS + "SELECT item_id, count(*) AS n_seeds, mode(top) IS NOT NULL AS voted, arg_max(top, (k, -top)) AS majority FROM (SELECT item_id, top, count(*) OVER (PARTITION BY item_id, top) AS k FROM sc) GROUP BY item_id")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent answer over seeds; ties to the smaller option."""
    k = scored(spark, sf_dir).groupBy("item_id", "top").agg(F.count("*").alias("k"))
    return k.groupBy("item_id").agg(F.sum("k").alias("n_seeds"), F.lit(True).alias("voted"), F.max_by("top", F.struct("k", -F.col("top"))).alias("majority"))


@CATALOG.query(PREDS + ", f AS (SELECT seed, grp, avg(correct) AS a FROM sc GROUP BY ALL), arm AS (SELECT CASE WHEN seed = 0 THEN 'base' ELSE 'pooled' END AS arm, seed, avg(a) AS a FROM f GROUP BY ALL) SELECT arm, round(avg(a), 6) AS acc, count(*) AS n_files FROM arm GROUP BY arm")
def equal_weight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of per-group means, each file (seed) with equal weight in its arm."""
    f = scored(spark, sf_dir).groupBy("seed", "grp").agg(F.avg("correct").alias("a")).groupBy("seed").agg(F.avg("a").alias("a"))
    return f.groupBy(F.when(F.col("seed") == 0, "base").otherwise("pooled").alias("arm")).agg(r6(F.avg("a")).alias("acc"), F.count("*").alias("n_files"))


@CATALOG.query(PREDS + ", v AS (SELECT grp, seed, CASE WHEN avg(correct) < 0.2 THEN 'FAIL' WHEN count(*) < 40 THEN 'PENDING' ELSE 'PASS' END AS verdict FROM sc GROUP BY ALL) SELECT grp, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_and(verdict = 'PASS') THEN 'PASS' ELSE 'PENDING' END AS verdict FROM v GROUP BY grp")
def three_valued_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any failure fails, all passes pass, anything else is pending."""
    v = scored(spark, sf_dir).groupBy("grp", "seed").agg(F.when(F.avg("correct") < 0.2, "FAIL").when(F.count("*") < 40, "PENDING").otherwise("PASS").alias("verdict"))
    return v.groupBy("grp").agg(F.when(F.some(F.col("verdict") == "FAIL"), "FAIL").when(F.every(F.col("verdict") == "PASS"), "PASS").otherwise("PENDING").alias("verdict"))


@CATALOG.query(PREDS + f"SELECT item_id FROM sc GROUP BY item_id HAVING count(DISTINCT seed) = {SEEDS}")
def eligible_in_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items answered in every cell."""
    return scored(spark, sf_dir).select("item_id", "seed").distinct().groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") == SEEDS).select("item_id")


@CATALOG.query(PREDS + "SELECT seed, round(min(-ln(greatest(pg, 1e-12))), 6) AS best, round(avg(-list_sum(list_transform(probs, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END))), 6) AS entropy FROM sc GROUP BY seed")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.groupBy("seed").agg(r6(F.min(P.nll(F.col("probs"), F.col("gold")))).alias("best"), r6(F.avg(P.entropy(F.col("probs")))).alias("entropy"))


@CATALOG.query(PREDS + ", s AS (SELECT item_id, conf, correct FROM sc WHERE seed = 0), v AS (SELECT conf, count(*) AS n, sum(correct) AS p FROM s GROUP BY conf), c AS (SELECT conf, sum(p) OVER w AS pl, sum(n - p) OVER w AS nl, sum(p) OVER () AS pt, sum(n - p) OVER () AS nt FROM v WINDOW w AS (ORDER BY conf ROWS UNBOUNDED PRECEDING)) SELECT round(max(greatest((nl + pt - pl) / (pt + nt), (pl + nt - nl) / (pt + nt))), 6) AS stump_acc FROM c")
def stump_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the best threshold and sign on one feature, from cumulative counts by distinct value."""
    v = scored(spark, sf_dir).where("seed = 0").groupBy("conf").agg(F.count("*").alias("n"), F.sum("correct").alias("p"))
    w, every = Window.orderBy("conf").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    neg = F.col("n") - F.col("p")
    c = v.select(F.sum("p").over(w).alias("pl"), F.sum(neg).over(w).alias("nl"), F.sum("p").over(every).alias("pt"), F.sum(neg).over(every).alias("nt"))
    both = F.col("pt") + F.col("nt")
    return c.agg(r6(F.max(F.greatest((F.col("nl") + F.col("pt") - F.col("pl")) / both, (F.col("pl") + F.col("nt") - F.col("nl")) / both))).alias("stump_acc"))
