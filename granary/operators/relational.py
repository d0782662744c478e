"""Joins, windows and text projections over the relational and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()


def r6(c):
    return F.round(c, 6)


@CATALOG.query("SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, coalesce(round(sum(CAST(l_extendedprice AS DOUBLE)), 2), 0) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY ALL")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its returned lines, none included."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("s"))
    out = t.orders.select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("s", F.lit(0.0)).alias("total"))


@CATALOG.query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("k")).join(dim, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("k").alias("n"))


@CATALOG.query("WITH a AS (SELECT vec_id, label FROM embeddings), b AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0) SELECT count(*) AS n, count(*) FILTER (b.vec_id IS NULL) AS missing, count(*) FILTER (a.label <> b.label) AS gold_conflicts FROM a FULL JOIN b USING (vec_id)")
def aligned_set_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do two runs hold the same keys and gold: rows, missing keys, conflicts."""
    e = Tables(spark, sf_dir).embeddings
    a = e.select("vec_id", F.col("label").alias("ga"), F.lit(1).alias("ina"))
    b = e.where("vec_id % 3 <> 0").select("vec_id", F.col("label").alias("gb"), F.lit(1).alias("inb"))
    return a.join(b, "vec_id", "full").agg(F.count("*").alias("n"), F.count_if(F.col("inb").isNull()).alias("missing"), F.count_if(F.col("ga") != F.col("gb")).alias("gold_conflicts"))


@CATALOG.query("WITH m AS (SELECT avg(value) AS m FROM events WHERE event_type = 'purchase') SELECT e.user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE m.m END), 4) AS cost, count(*) FILTER (event_type <> 'purchase') AS imputed FROM events e, m GROUP BY e.user_id")
def cost_join_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a cost of their own take the mean one."""
    e = Tables(spark, sf_dir).events
    m = e.where("event_type = 'purchase'").agg(F.avg("value").alias("m"))
    own = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.col("m"))
    return e.join(m).groupBy("user_id").agg(F.round(F.sum(own), 4).alias("cost"), F.count_if(F.col("event_type") != "purchase").alias("imputed"))


@CATALOG.query("WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS click_id, ts FROM events WHERE event_type = 'click'), j AS (SELECT p.event_id, c.click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.click_id DESC) AS k FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.ts <= p.ts) SELECT event_id, click_id FROM j WHERE k = 1")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase, by one window over the union: no pairs are made."""
    e = Tables(spark, sf_dir).events.where(F.col("event_type").isin("click", "purchase"))
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    order = [F.col("ts"), F.col("event_type") != "click", F.col("event_id")]
    last = F.last(click, ignorenulls=True).over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", "event_type", last.alias("click_id")).where("event_type = 'purchase'").drop("event_type")


@CATALOG.query("SELECT conv_id, turn, lag(role) OVER w IS DISTINCT FROM role AS speaker_change, turn = min(turn) OVER p AS is_first, turn = max(turn) OVER p AS is_last, round(ln(1 + length(text)), 6) AS log_length, rank() OVER (PARTITION BY conv_id ORDER BY length(text) DESC) AS length_rank FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id)")
def step_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Window.partitionBy("conv_id")
    return Tables(spark, sf_dir).conversations.select(
        "conv_id",
        "turn",
        (~F.lag("role").over(p.orderBy("turn")).eqNullSafe(F.col("role"))).alias("speaker_change"),
        (F.col("turn") == F.min("turn").over(p)).alias("is_first"),
        (F.col("turn") == F.max("turn").over(p)).alias("is_last"),
        r6(F.log(1 + F.length("text"))).alias("log_length"),
        F.rank().over(p.orderBy(F.desc(F.length("text")))).cast("long").alias("length_rank"),
    )


@CATALOG.query("WITH e AS (SELECT user_id, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(min(m) FILTER (k <= greatest(1, n - 7)), 6) AS lowest, round(avg(m) FILTER (k <= greatest(1, n - 7)), 6) AS mean, round(avg(value) FILTER (k > n - 8), 6) AS tail FROM e GROUP BY user_id")
def sliding_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over full windows of eight: lowest, mean, and the mean of the tail."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = Tables(spark, sf_dir).events.select("user_id", "value", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), F.avg("value").over(w.rowsBetween(0, 7)).alias("m"))
    full = F.col("k") <= F.greatest(F.lit(1), F.col("n") - 7)
    return e.groupBy("user_id").agg(r6(F.min(F.when(full, F.col("m")))).alias("lowest"), r6(F.avg(F.when(full, F.col("m")))).alias("mean"), r6(F.avg(F.when(F.col("k") > F.col("n") - 8, F.col("value")))).alias("tail"))


@CATALOG.query("SELECT event_id, user_id, value, sum(CASE WHEN gap > 3600 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of events with gaps of an hour at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = Tables(spark, sf_dir).events.withColumn("gap", s - F.lag(s).over(w))
    new = F.when((F.col("gap") > 3600) | F.col("gap").isNull(), 1).otherwise(0)
    return e.select("event_id", "user_id", "value", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))


@CATALOG.query("SELECT date_trunc('hour', ts) AS hour_start, dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 9 AND 16 AS peak, count(*) AS n, round(sum(value * CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 9 AND 16 THEN 2 ELSE 1 END), 4) AS spend FROM events GROUP BY ALL")
def peak_hour_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by hour, doubled in weekday peak hours."""
    peak = (F.weekday("ts") < 5) & F.hour("ts").between(9, 16)
    return Tables(spark, sf_dir).events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"), peak.alias("peak")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.when(peak, 2).otherwise(1)), 4).alias("spend"))


@CATALOG.query("SELECT user_id, max(n) AS longest, round(max(total), 4) AS spent, count(*) AS n FROM (SELECT user_id, row_number() OVER w AS n, sum(value) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE total < 500 GROUP BY user_id")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that started while the running total was under the budget."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = Tables(spark, sf_dir).events.select("user_id", F.count("*").over(w).alias("n"), F.sum("value").over(w).alias("total")).where("total < 500")
    return e.groupBy("user_id").agg(F.max("n").alias("longest"), F.round(F.max("total"), 4).alias("spent"), F.count("*").alias("n"))


@CATALOG.query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 200) || ' [...] ' || right(text, 100) ELSE text END AS cut FROM documents")
def head_tail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", T.head_tail(F.col("text"), 300).alias("cut"))


@CATALOG.query("WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS l FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, cap, list_sum(list_transform(l, lambda x: least(x, cap) + 8)) AS total FROM c, (SELECT 20 * (1 + i) AS cap FROM range(50) r(i))) SELECT conv_id, coalesce(max(cap) FILTER (total <= 600), 20) AS cap FROM f GROUP BY conv_id")
def fitted_step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest per-step cap with which a rendered log fits its budget; sums by cap, not texts, are kept."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", F.length("text").alias("x"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 20)).alias("cap"))
    f = c.groupBy("conv_id", "cap").agg(F.sum(F.least("x", "cap") + 8).alias("total"))
    return f.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("total") <= 600, F.col("cap"))), F.lit(20)).cast("long").alias("cap"))


@CATALOG.query("SELECT doc_id, [CAST(replace(x, ',', '') AS DOUBLE) for x in regexp_extract_all(text, '-?[0-9][0-9,]*(?:\\.[0-9]+)?')] AS nums FROM documents")
def number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", T.numbers(F.col("text")).alias("nums"))


@CATALOG.query("SELECT l_orderkey, l_linenumber, 'A) ' || l_linestatus || chr(10) || 'B) ' || l_returnflag || chr(10) || 'C) ' || CAST(l_suppkey AS VARCHAR) AS block, ['A', 'B', 'C'][1 + l_orderkey % 3] AS gold FROM lineitem")
def option_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered options, and the letter of the gold one."""
    labels = F.array(*[F.lit(x) for x in "ABC"])
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", T.option_block(labels, F.array("l_linestatus", "l_returnflag", F.col("l_suppkey").cast("string"))).alias("block"), F.get(labels, (F.col("l_orderkey") % 3).cast("int")).alias("gold"))


@CATALOG.query("WITH o AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS o, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part), s AS (SELECT p_partkey, o, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws('|', 'opt', CAST(p_partkey AS VARCHAR), o)), pos) AS k FROM o) SELECT p_partkey, string_agg(o, ' ' ORDER BY k) AS shuffled, CAST(max(k) FILTER (pos = 1) AS BIGINT) AS gold_at FROM s GROUP BY p_partkey")
def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in hash order, and where the gold one (the first) went."""
    p = Tables(spark, sf_dir).part.select("p_partkey", F.split("p_name", " ").alias("o"))
    pairs = F.transform("o", lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit("opt"), F.col("p_partkey").cast("string"), x).cast("binary")).alias("h"), (i + 1).alias("pos"), x.alias("x")))
    s = p.select("p_partkey", F.array_sort(pairs).alias("s"))
    return s.select("p_partkey", F.array_join(F.transform("s", lambda z: z["x"]), " ").alias("shuffled"), F.array_position(F.transform("s", lambda z: z["pos"]), 1).cast("long").alias("gold_at"))


#: DuckDB's distance counts bytes: letters of the tables beyond ASCII become single bytes that the texts don't have.
_BYTES = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '" + "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 25)])) + "')"


@CATALOG.query(f"WITH q AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT conv_id, turn, levenshtein({_BYTES.format('text')}, {_BYTES.format('prev')}) AS d FROM q WHERE prev IS NOT NULL")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each turn to the one before, over whole texts and all characters."""
    q = Tables(spark, sf_dir).conversations.withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return q.select("conv_id", "turn", F.levenshtein("text", "prev").cast("long").alias("d"))


@CATALOG.query("SELECT conv_id, turn, upper(NULLIF(regexp_extract(text, '\\(?([A-Z])\\)?\\.?\\s*$', 1), '')) AS letter FROM conversations WHERE NOT regexp_matches(text, '(?i)answer\\s*[:=]')")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter that a text ends with, where no explicit answer stands."""
    c = Tables(spark, sf_dir).conversations.where(~F.col("text").rlike(r"(?i)answer\s*[:=]"))
    return c.select("conv_id", "turn", T.answer_letter(F.col("text")).alias("letter"))


_BARE = "regexp_replace({}, '[\t\n\f\r ]+', '', 'g')"


@CATALOG.query(f"""
WITH q AS (SELECT conv_id, turn, {_BARE.format('text')} AS bare, {_BARE.format("string_split(text, '.')[1] || '.'")} AS quote FROM conversations)
SELECT a.conv_id, a.turn, min(b.turn) AS found_turn, arg_min(instr(b.bare, a.quote), b.turn) AS found_at, count(*) AS n_turns FROM q a JOIN q b ON a.conv_id = b.conv_id AND contains(b.bare, a.quote) GROUP BY a.conv_id, a.turn
""")
def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's whole first sentence is said in its conversation, white space aside: the first turn that has it, the place there, and how many have it."""
    bare = lambda c: F.regexp_replace(c, r"[\t\n\f\r ]+", "")
    q = Tables(spark, sf_dir).conversations.select("conv_id", "turn", bare(F.col("text")).alias("bare"), F.concat(bare(F.substring_index("text", ".", 1)), F.lit(".")).alias("quote"))
    said = q.select("conv_id", F.col("turn").alias("in_turn"), F.col("bare").alias("text"))
    hits = q.select("conv_id", "turn", "quote").join(said, "conv_id").withColumn("at", F.call_function("instr", "text", "quote")).where("at > 0")
    return hits.groupBy("conv_id", "turn").agg(F.min("in_turn").alias("found_turn"), F.min_by("at", "in_turn").cast("long").alias("found_at"), F.count("*").alias("n_turns"))


@CATALOG.query("SELECT event_type, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS v, count(*) AS n FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the values of every JSON key."""
    e = Tables(spark, sf_dir).events
    return e.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")).groupBy("event_type", "key", "v").agg(F.count("*").alias("n"))


@CATALOG.query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)")
def pricing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Tables(spark, sf_dir).lineitem.where("l_shipdate <= date '1998-09-02'")
    return l.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))), 2).alias("revenue"))


_STEM = "CASE WHEN length(x) > 5 THEN regexp_replace(x, '(ing|edly|ed|es|ly|s)$', '') WHEN length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END"


def _sql_content(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda x: NOT list_contains([{stop}], x)), lambda x: {_STEM}))"


@CATALOG.query(f"""
WITH c AS (SELECT conv_id, turn, {_sql_content('text')} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM c)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, CASE WHEN len(w) > 0 AND q IS NOT NULL THEN round(len(list_intersect(w, q)) / len(w), 6) END AS contained FROM p
""")
def content_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a turn's content words, as stems, that the turn before has."""
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", T.content_words(F.col("text")).alias("w")).withColumn("q", before)
    share = F.size(F.array_intersect("w", "q")) / F.size("w")
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.when((F.size("w") > 0) & F.col("q").isNotNull(), F.round(share, 6)).alias("contained"))


@CATALOG.query("""
WITH p AS (SELECT conv_id, turn, concat('Question: ', coalesce(text, ''), chr(10), 'Question: and then?', chr(10), 'Options:', chr(10), 'A) yes') AS t FROM conversations),
h AS (SELECT conv_id, turn, t, length(t) - strpos(reverse(t), reverse('Options:')) - 7 AS o FROM p), b AS (SELECT conv_id, turn, substr(t, 1, o) AS body FROM h)
SELECT conv_id, turn, body, substr(body, 1, length(body) - strpos(reverse(body), reverse('Question:')) - 8) AS head FROM b
""")
def prompt_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the last options block of a prompt, and before its last question."""
    whole = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\nQuestion: and then?\nOptions:\nA) yes"))
    body = T.before_last(whole, "Options:")
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", body.alias("body"), T.before_last(body, "Question:").alias("head"))
