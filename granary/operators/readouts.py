"""Readouts over options, steps and traces: baselines, sensitivities, distributions, spans and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrays import first_argmax, let, total
from granary.functions.hashing import hash_number
from granary.operators.catalog import Catalog, Tables
from granary.operators.filters import first_reason
from granary.operators.scoring import PREDS, predictions, r6, scored
from granary.operators.stats import drawn, sql_draws

CATALOG = Catalog()

_OPTIONS = "WITH o AS (SELECT vec_id, label % 4 AS gold, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@CATALOG.query(_OPTIONS + """, h AS (SELECT *, list_transform(v, lambda x: round(list_sum(list_transform(v, lambda y: abs(x - y))), 9)) AS far FROM o)
SELECT round(avg(CAST(list_position(v, list_max(v)) - 1 = gold AS INT)), 6) AS largest, round(avg(CAST(list_position(v, list_min(v)) - 1 = gold AS INT)), 6) AS smallest,
round(avg(CAST(list_position(v, list_sort(v)[2]) - 1 = gold AS INT)), 6) AS middle, round(avg(CAST(list_position(far, list_min(far)) - 1 = gold AS INT)), 6) AS hub FROM h""")
def rule_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-blind rules over option values: largest, smallest, lower middle, and the hub nearest to all others."""
    e = Tables(spark, sf_dir).embeddings.select((F.col("label") % 4).alias("gold"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    far = F.transform("v", lambda x: F.round(total(F.transform("v", lambda y: F.abs(x - y))), 9))
    at = lambda a, x: F.array_position(a, x).cast("int") - 1
    rules = {"largest": first_argmax(F.col("v")), "smallest": at(F.col("v"), F.array_min("v")), "middle": at(F.col("v"), F.get(F.array_sort("v"), F.lit(1))), "hub": let(far, lambda f: at(f, F.array_min(f)))}
    return e.agg(*[r6(F.avg((c == F.col("gold")).cast("int"))).alias(n) for n, c in rules.items()])


_LOGIT = "ln(greatest(pg, 1e-6) / greatest(1 - pg, 1e-6))"


@CATALOG.query(PREDS + f", l AS (SELECT item_id, avg({_LOGIT}) FILTER (seed = 0) AS own, avg({_LOGIT}) FILTER (seed = 1) AS matched, avg({_LOGIT}) FILTER (seed = 2) AS none FROM sc GROUP BY item_id) SELECT count(own - matched) AS n_matched, round(avg(own - matched), 6) AS vs_matched, count(own - none) AS n_none, round(avg(own - none), 6) AS vs_none FROM l")
def parent_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds contrasts between conditions, first by item, then over items that have both."""
    logit = F.log(F.greatest("pg", F.lit(1e-6)) / F.greatest(1 - F.col("pg"), F.lit(1e-6)))
    l = scored(spark, sf_dir).withColumn("z", logit).groupBy("item_id").pivot("seed", [0, 1, 2]).agg(F.avg("z")).toDF("item_id", "own", "matched", "none")
    d = {"matched": F.col("own") - F.col("matched"), "none": F.col("own") - F.col("none")}
    return l.agg(*[x for n, c in d.items() for x in (F.count(c).alias(f"n_{n}"), r6(F.avg(c)).alias(f"vs_{n}"))])


@CATALOG.query(PREDS + ", c AS (SELECT grp, seed, avg(correct) AS hit, count(*) AS n FROM sc GROUP BY ALL), b AS (SELECT seed, arg_max(grp, (hit, -grp)) AS best_cell, max(hit) AS best FROM c GROUP BY seed), k AS (SELECT item_id FROM sc GROUP BY item_id HAVING count(DISTINCT seed) = 3) SELECT sc.seed, round(avg(correct), 6) AS hit_common, any_value(best_cell) AS best_cell, round(any_value(best), 6) AS best FROM sc JOIN k USING (item_id) JOIN b USING (seed) GROUP BY sc.seed")
def causal_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate per condition on common items, and its best cell; ties to the smaller cell."""
    s = scored(spark, sf_dir)
    best = s.groupBy("grp", "seed").agg(F.avg("correct").alias("hit")).groupBy("seed").agg(F.max_by("grp", F.struct("hit", -F.col("grp"))).alias("best_cell"), r6(F.max("hit")).alias("best"))
    common = s.groupBy("item_id").agg(F.count_distinct("seed").alias("k")).where("k = 3").select("item_id")
    return s.join(common, "item_id").groupBy("seed").agg(r6(F.avg("correct")).alias("hit_common")).join(best, "seed")


@CATALOG.query("WITH t AS (SELECT role, length(text) AS n, md5(text) AS h, CASE WHEN regexp_matches(text, '(?i)answer\\s*[:=]') THEN 'explicit' WHEN regexp_matches(text, '[.!?]$') THEN 'sentence' ELSE 'cut' END AS method FROM conversations WHERE text IS NOT NULL) SELECT role, count(*) AS n, count(*) FILTER (method = 'explicit') AS explicit, count(*) FILTER (method = 'cut') AS truncated, round(avg(n), 6) AS mean_length, list_sort(list(n))[1 + CAST(floor(0.9 * (count(*) - 1)) AS INT)] AS p90, round(count(DISTINCT h) / count(*), 6) AS diversity FROM t GROUP BY role")
def cot_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse methods, truncation, lengths (the 90 % value by position, found by rank) and diversity of texts."""
    method = F.when(F.col("text").rlike(r"(?i)answer\s*[:=]"), "explicit").when(F.col("text").rlike("[.!?]$"), "sentence").otherwise("cut")
    t = Tables(spark, sf_dir).conversations.where("text is not null").select("role", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"), method.alias("method"))
    counts = t.groupBy("role", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("role")
    ranked = counts.select("role", "n", F.sum("k").over(w.orderBy("n")).alias("to"), F.sum("k").over(w).alias("all"))
    p90 = ranked.where(F.col("to") > F.floor(0.9 * (F.col("all") - 1))).groupBy("role").agg(F.min("n").cast("long").alias("p90"))
    out = t.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("method") == "explicit").alias("explicit"), F.count_if(F.col("method") == "cut").alias("truncated"), r6(F.avg("n")).alias("mean_length"), r6(F.count_distinct("h") / F.count("*")).alias("diversity"))
    return out.join(p90, "role")


@CATALOG.query("SELECT user_id, round(min(value), 6) AS least, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) WHERE pos BETWEEN 3 AND 9 GROUP BY user_id")
def span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and mean value over a span of positions."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return Tables(spark, sf_dir).events.select("user_id", "value", pos.alias("pos")).where("pos between 3 and 9").groupBy("user_id").agg(r6(F.min("value")).alias("least"), r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@CATALOG.query(PREDS + ", a AS (SELECT grp, avg(correct) FILTER (seed = 0) AS x, avg(correct) FILTER (seed = 1) AS y FROM sc GROUP BY grp) SELECT k, bool_and(p.x >= q.y) AS dominates, count(*) AS n_levels FROM (SELECT CAST(i AS INT) AS k FROM range(6) r(i)) JOIN a q ON true JOIN a p ON p.grp = q.grp + k GROUP BY k")
def shifted_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shift, whether one arm at level + shift is never below the other at the level."""
    a = scored(spark, sf_dir).groupBy("grp").pivot("seed", [0, 1]).agg(F.avg("correct")).toDF("grp", "x", "y")
    q = a.select("y", F.col("grp").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("grp", F.col("base") + F.col("k"))
    return q.join(a.select("grp", "x"), "grp").groupBy("k").agg(F.every(F.col("x") >= F.col("y")).alias("dominates"), F.count("*").alias("n_levels"))


@CATALOG.query("WITH o AS (SELECT p_partkey, string_split(p_name, ' ') AS o FROM part), l AS (SELECT p_partkey, list_transform(o, lambda x: length(x)) AS n, list_transform(o, lambda x: regexp_matches(x, '^[aeiou]')) AS f FROM o) SELECT p_partkey, len(list_filter(n, lambda x: x = list_max(n))) = 1 AND n[1] = list_max(n) AS longest_tell, len(list_filter(f, lambda x: x = f[1])) = 1 AND len(f) > 2 AS odd_one_out FROM l")
def surface_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the gold option (the first) the one longest, or the one of its form."""
    p = Tables(spark, sf_dir).part.select("p_partkey", F.split("p_name", " ").alias("o"))
    p = p.select("p_partkey", F.transform("o", F.length).alias("n"), F.transform("o", lambda x: x.rlike("^[aeiou]")).alias("f"))
    first, form = F.get("n", F.lit(0)), F.get("f", F.lit(0))
    longest = (F.size(F.filter("n", lambda x: x == F.array_max("n"))) == 1) & (first == F.array_max("n"))
    return p.select("p_partkey", longest.alias("longest_tell"), ((F.size(F.filter("f", lambda x: x == form)) == 1) & (F.size("f") > 2)).alias("odd_one_out"))


@CATALOG.query("WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS pos FROM conversations), k AS (SELECT conv_id, turn, pos, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM s WHERE length(s) < 60) SELECT conv_id, turn, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last FROM k GROUP BY conv_id, turn, island")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of adjacent short sentences, merged to windows (gaps and islands)."""
    s = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\. "))).where(F.length("col") < 60)
    k = s.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")))
    return k.groupBy("conv_id", "turn", "island").agg((F.min("pos") + 1).alias("first"), (F.max("pos") + 1).alias("last")).drop("island")


@CATALOG.query("WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations), f AS (SELECT DISTINCT conv_id, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 1024 AS bucket FROM (SELECT conv_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM t)) SELECT bucket, count(*) AS df FROM f GROUP BY bucket")
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams and bigrams in 1,024 buckets, with document frequencies by conversation."""
    t = T.tokens(F.col("text"))
    grams = F.concat(t, T.shingles(t, 2, distinct=False))
    f = Tables(spark, sf_dir).conversations.select("conv_id", F.explode(grams).alias("g")).select("conv_id", (hash_number(F.md5(F.col("g").cast("binary"))) % 1024).alias("bucket")).distinct()
    return f.groupBy("bucket").agg(F.count("*").alias("df"))


@CATALOG.query(PREDS + ", s AS (SELECT seed, item_id, list_reverse_sort(probs) AS r, probs FROM preds) SELECT seed, item_id, list_transform(probs, lambda p: CASE WHEN p >= r[2] THEN round(p / list_sum(list_filter(probs, lambda x: x >= r[2])), 6) END) AS dist, round(r[2], 6) AS bound FROM s")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer only the two best options are seen: they are renormalised; the others are unknown, bounded by the least seen."""
    second = F.get(F.sort_array("probs", asc=False), F.lit(1))
    p = predictions(spark, sf_dir).select("seed", "item_id", "probs", second.alias("bound"))
    mass = total(F.filter("probs", lambda x: x >= F.col("bound")))
    return p.withColumn("mass", mass).select("seed", "item_id", F.transform("probs", lambda x: F.when(x >= F.col("bound"), F.round(x / F.col("mass"), 6))).alias("dist"), r6("bound").alias("bound"))


@CATALOG.query(PREDS + ", e AS (SELECT item_id, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS pos FROM preds) SELECT item_id, CAST(pos AS INT) AS pos, round(avg(p), 8) AS p, count(*) AS n_traces FROM e GROUP BY item_id, pos")
def teacher_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distribution over traces that have one."""
    return predictions(spark, sf_dir).select("item_id", F.posexplode("probs").alias("pos", "p")).groupBy("item_id", "pos").agg(F.round(F.avg("p"), 8).alias("p"), F.count("*").alias("n_traces"))


@CATALOG.query("SELECT vec_id, list_transform(range(4), lambda i: CASE WHEN i = label % 4 THEN 0.925::DOUBLE ELSE 0.025 END) AS target, round((1 + label) ** 1.5 / sum((1 + label) ** 1.5) OVER (PARTITION BY vec_id // 10), 6) AS weight FROM embeddings")
def soft_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot targets smoothed by 0.1 over four options, and depth weights (1 + depth)^1.5 that add up to one per item."""
    w = F.pow(1 + F.col("label"), F.lit(1.5))
    target = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("label") % 4, 0.925).otherwise(0.025))
    return Tables(spark, sf_dir).embeddings.select("vec_id", target.alias("target"), r6(w / F.sum(w).over(Window.partitionBy(F.floor(F.col("vec_id") / 10)))).alias("weight"))


@CATALOG.query("SELECT l_orderkey, l_linenumber, abs(a - b) <= 1e-6 * greatest(abs(a), abs(b), 1) AS strong, abs(a - b) <= 0.01 * greatest(abs(a), abs(b), 1) AS weak FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS a, round(CAST(l_extendedprice AS DOUBLE), -2) AS b FROM lineitem)")
def answer_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric answers equal to rounding (strong) or within a percent (weak)."""
    a = F.col("l_extendedprice").cast("double")
    b = F.round(a, -2)
    near = lambda t: F.abs(a - b) <= t * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", near(1e-6).alias("strong"), near(0.01).alias("weak"))


@CATALOG.query("SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS names FROM benchmark")
def name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words."""
    return Tables(spark, sf_dir).benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)).alias("names"))


@CATALOG.query("WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, value, n >= 5 AS chosen_epoch FROM e WHERE step = least(5, n)")
def asof_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record at the chosen step, else the final one."""
    w = Window.partitionBy("user_id")
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("step"), F.count("*").over(w).alias("n"))
    return e.where(F.col("step") == F.least(F.lit(5), F.col("n"))).select("user_id", "event_id", "value", (F.col("n") >= 5).alias("chosen_epoch"))


_SENTENCES = "SELECT {0}, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.!?\\n]+'), lambda x: array_to_string(regexp_extract_all(x, '[a-z0-9]+'), ' ')), lambda x: len(string_split(x, ' ')) >= 4)) AS s FROM {1}"


def sentences(text: Column) -> Column:
    """The distinct sentences and lines of four tokens or more, as tokens joined by blanks."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]+"), T.normalised)
    return F.array_distinct(F.filter(parts, lambda x: F.size(F.split(x, " ")) >= 4))


@CATALOG.query(f"""
WITH f AS (SELECT k, min(item_id) AS item_id FROM (SELECT item_id, unnest(s) AS k FROM ({_SENTENCES.format('item_id', 'benchmark')})) GROUP BY k HAVING count(DISTINCT item_id) = 1),
q AS (SELECT doc_id, unnest(s) AS k FROM ({_SENTENCES.format('doc_id', 'documents')}))
SELECT doc_id, item_id, count(*) AS n_steps FROM q JOIN f USING (k) GROUP BY ALL
""")
def unique_fact_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that exactly one fact states, by whole sentence; how many of each fact a document has."""
    t = Tables(spark, sf_dir)
    facts = t.benchmark.select("item_id", F.explode(sentences(F.col("text"))).alias("k")).groupBy("k").agg(F.min("item_id").alias("item_id"), F.max("item_id").alias("last")).where("item_id = last").drop("last")
    steps = t.documents.select("doc_id", F.explode(sentences(F.col("text"))).alias("k"))
    return steps.join(facts, "k").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_steps"))


@CATALOG.query(PREDS + "SELECT seed, item_id, (correct = 1) = (pg >= 0.5) AND (top = gold OR pg < 0.5) AS kept FROM sc")
def consistency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node is kept if its truth, its answer and its probability agree."""
    agree = ((F.col("correct") == 1) == (F.col("pg") >= 0.5)) & ((F.col("top") == F.col("gold")) | (F.col("pg") < 0.5))
    return scored(spark, sf_dir).select("seed", "item_id", agree.alias("kept"))


@CATALOG.query("SELECT conv_id, CASE WHEN count(*) < 2 THEN 'one_step' WHEN count(DISTINCT role) < 2 THEN 'one_agent' WHEN max(length(text)) > 2000 THEN 'long_step' WHEN min(length(text)) < 5 THEN 'short_step' END AS reason FROM conversations GROUP BY conv_id")
def item_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason why a conversation can't become an item."""
    n = F.length("text")
    rules = [("one_step", F.count("*") < 2), ("one_agent", F.count_distinct("role") < 2), ("long_step", F.max(n) > 2000), ("short_step", F.min(n) < 5)]
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(first_reason(rules).alias("reason"))


@CATALOG.query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: length(x) > 4 AND i > 1), ' ') AS kept FROM part")
def node_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested nodes filtered by type and index, without an explode."""
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda x, i: (F.length(x) > 4) & (i > 0)), " ").alias("kept"))


@CATALOG.query(PREDS + "SELECT seed, item_id, array_to_string(list_transform(list_filter(range(1, 5), lambda i: probs[i] > 0.2), lambda i: ['A', 'B', 'C', 'D'][i] || '=' || CAST(round(probs[i] * 100) AS INT)), ',') AS shown FROM preds")
def probability_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-to-probability maps, their likely entries as text."""
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    m = F.map_filter(F.map_from_arrays(labels, F.col("probs")), lambda _, v: v > 0.2)
    shown = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("int").cast("string")))
    return predictions(spark, sf_dir).select("seed", "item_id", F.array_join(shown, ",").alias("shown"))


@CATALOG.query("SELECT r_regionkey, r_name FROM region")
def program_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested programs to JSON and back under a fixed schema."""
    r = Tables(spark, sf_dir).region
    code = F.to_json(F.struct(F.struct("r_regionkey", "r_name").alias("head"), F.array(F.struct(F.lit("+").alias("op"), F.array(F.lit(0), F.lit(1)).alias("args"))).alias("steps")))
    kind = r.schema["r_regionkey"].dataType.simpleString()
    back = F.from_json(code, f"head struct<r_regionkey:{kind},r_name:string>, steps array<struct<op:string,args:array<int>>>")
    return r.select(back.alias("p")).where(F.size("p.steps") == 1).select("p.head.r_regionkey", "p.head.r_name")


@CATALOG.query(
    PREDS
    + f""", ids AS (SELECT item_id, grp, correct AS c FROM sc WHERE seed = 0), p AS (SELECT draw, grp, sum(w * c) AS s, sum(w) AS n FROM {sql_draws("strata", "item_id")} d JOIN ids USING (item_id) GROUP BY ALL HAVING sum(w) > 0),
m AS (SELECT sum(s) / sum(n) AS item_weighted, avg(s / n) AS equal_weight FROM p GROUP BY draw)
SELECT """
    + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in ("item_weighted", "equal_weight") for n, p in (("low", 0.025), ("high", 0.975)))
    + " FROM m"
)
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-weighted and equal-weight means over strata, resampled within each stratum: strata sums per draw are combined."""
    s = scored(spark, sf_dir).where("seed = 0").select("grp", "item_id", "correct")
    per = drawn(s, "correct", "item_id", "strata", "grp")
    d = per.groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("item_weighted"), F.avg(F.col("s") / F.col("n")).alias("equal_weight"))
    q = lambda c, p: r6(F.percentile(c, p))
    return d.agg(*[q(c, p).alias(f"{c}_{n}") for c in ("item_weighted", "equal_weight") for n, p in (("low", 0.025), ("high", 0.975))])


@CATALOG.query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations) SELECT role, count(*) AS n, round(avg(w), 6) AS best_with, round(avg(o), 6) AS best_without FROM (SELECT conv_id, f.role, min(rank) FILTER (r.role = f.role) AS w, min(rank) FILTER (r.role <> f.role) AS o FROM r, (SELECT DISTINCT role FROM conversations) f GROUP BY conv_id, f.role) GROUP BY role")
def rank_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature (a role) the best rank of steps with and without it, over conversations; from two ranks per conversation."""
    c = Tables(spark, sf_dir).conversations
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))
    best = c.select("conv_id", "role", rank.alias("rank")).groupBy("conv_id", "role").agg(F.min("rank").alias("rank"))
    two = best.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "role"))).alias("b"))
    roles = c.agg(F.collect_set("role").alias("roles"))
    each = two.join(roles).select("b", F.explode("roles").alias("role"))
    first = lambda cond: F.get(F.transform(F.filter("b", cond), lambda x: x["rank"]), F.lit(0))
    return each.groupBy("role").agg(F.count("*").alias("n"), r6(F.avg(first(lambda x: x["role"] == F.col("role")))).alias("best_with"), r6(F.avg(first(lambda x: x["role"] != F.col("role")))).alias("best_without"))
