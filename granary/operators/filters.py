"""Projections, filters and drop reasons of the mixture builder, as single-pass expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.ranges import in_hash_order, ranges_for
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()

#: Licence classes from the freest to the most restrictive; unknown ones rank last.
LICENCES = ("PERM", "ATTR", "NC", "SA", "UNK")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does. A null condition does not hold."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def licence_rank(c: Column) -> Column:
    known = F.array_position(F.array(*[F.lit(x) for x in LICENCES]), c) - 1
    return F.when(known >= 0, known).otherwise(len(LICENCES) - 1)


def licence_max(*classes: Column) -> Column:
    """The most restrictive of several licence classes."""
    ranks = [licence_rank(c) for c in classes]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.get(F.array(*[F.lit(x) for x in LICENCES]), top.cast("int"))


@CATALOG.query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, 'src1') AND NOT regexp_matches(source, '[02468]$')")
def include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept iff the include pattern is found and the exclude pattern is not."""
    s = F.col("source")
    return Tables(spark, sf_dir).documents.select("doc_id", "source").where(s.rlike("src1") & ~s.rlike("[02468]$"))


@CATALOG.query("SELECT doc_id, coalesce(lang IN ('de', 'fr'), false) AS listed FROM documents")
def where_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing field is not in the list."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False)).alias("listed"))


_REASONS = """CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN contains(text, 'http') THEN 'link' WHEN contains(text, '|') THEN 'table'
WHEN contains(text, '!!') THEN 'shout' WHEN regexp_matches(text, '[0-9]{6,}') THEN 'digits' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN source = 'src3' THEN 'source' END"""


@CATALOG.query(f"SELECT doc_id, {_REASONS} AS excluded_by FROM documents")
def drop_reason_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine ordered predicates; the first that fires is the reason."""
    t = F.col("text")
    rules = [
        ("empty", t.isNull() | (t == "")),
        ("short", F.col("n_chars") < 200),
        ("long", F.col("n_chars") > 20000),
        ("link", F.contains(t, F.lit("http"))),
        ("table", F.contains(t, F.lit("|"))),
        ("shout", F.contains(t, F.lit("!!"))),
        ("digits", t.rlike("[0-9]{6,}")),
        ("language", ~F.col("lang").isin("en", "de")),
        ("source", F.col("source") == "src3"),
    ]
    return Tables(spark, sf_dir).documents.select("doc_id", first_reason(rules).alias("excluded_by"))


@CATALOG.query("WITH c AS (SELECT p_partkey, string_split(p_type, ' ') AS o, p_name FROM part) SELECT p_partkey, len(o) BETWEEN 2 AND 6 AND list_bool_and(list_transform(o, lambda x: length(x) >= 3)) AND length(p_name) <= 60 AS renderable, CASE WHEN len(o) < 3 THEN 'options' WHEN len(list_distinct(o)) < len(o) THEN 'duplicate' WHEN list_bool_or(list_transform(o, lambda x: length(x) < 4)) THEN 'short' WHEN contains(p_name, 'green') THEN 'image' END AS drop_reason FROM c")
def renderable_and_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate with options can be rendered, and the first reason it can't be used."""
    o, name = F.col("o"), F.col("p_name")
    ok = F.size(o).between(2, 6) & F.forall(o, lambda x: F.length(x) >= 3) & (F.length(name) <= 60)
    reason = first_reason([("options", F.size(o) < 3), ("duplicate", F.size(F.array_distinct(o)) < F.size(o)), ("short", F.exists(o, lambda x: F.length(x) < 4)), ("image", F.contains(name, F.lit("green")))])
    return Tables(spark, sf_dir).part.select("p_partkey", "p_name", F.split("p_type", " ").alias("o")).select("p_partkey", ok.alias("renderable"), reason.alias("drop_reason"))


@CATALOG.query("SELECT vec_id, label, list_transform(range(4), lambda i: CASE WHEN i = label % 4 THEN 1.0::DOUBLE ELSE 0.0 END) AS target, label % 4 = 0 AS kept FROM embeddings")
def label_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as a one-hot target; a program label is kept only if it is one-hot on its option."""
    target = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("label") % 4, 1.0).otherwise(0.0))
    one_hot = F.forall(target, lambda p: (F.abs(p) < 1e-9) | (F.abs(p - 1) < 1e-9)) & (F.abs(F.get(target, F.lit(0)) - 1) < 1e-9)
    return Tables(spark, sf_dir).embeddings.select("vec_id", "label", target.alias("target"), one_hot.alias("kept"))


_LIC = "list_position(['PERM', 'ATTR', 'NC', 'SA', 'UNK'], {})"


def _licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    pick = lambda m: F.get(F.array(*[F.lit(x) for x in ("PERM", "ATTR", "NC", "SA", "odd")]), k % m)
    return Tables(spark, sf_dir).documents.select("doc_id", "source", pick(5).alias("own"), pick(3).alias("generator"))


_LIC_SQL = "WITH l AS (SELECT doc_id, source, ['PERM', 'ATTR', 'NC', 'SA', 'odd'][1 + k % 5] AS own, ['PERM', 'ATTR', 'NC', 'SA', 'odd'][1 + k % 3] AS generator FROM (SELECT doc_id, source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM documents)), c AS (SELECT *, ['PERM', 'ATTR', 'NC', 'SA', 'UNK'][greatest(coalesce(" + _LIC.format("own") + ", 5), coalesce(" + _LIC.format("generator") + ", 5))] AS class FROM l) "


@CATALOG.query(_LIC_SQL + "SELECT doc_id, own, generator, class FROM c")
def licence_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most restrictive of two licence classes; unknown names rank last."""
    return _licensed(spark, sf_dir).select("doc_id", "own", "generator", licence_max(F.col("own"), F.col("generator")).alias("class"))


@CATALOG.query(_LIC_SQL + "SELECT doc_id, CASE WHEN class NOT IN ('PERM', 'ATTR') THEN 'licence:' || class WHEN source = 'src6' THEN 'flagged' END AS drop_reason FROM c")
def licence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release keeps permissive and attribution classes without a flag."""
    c = licence_max(F.col("own"), F.col("generator"))
    reason = F.when(~c.isin("PERM", "ATTR"), F.concat(F.lit("licence:"), c)).when(F.col("source") == "src6", "flagged")
    return _licensed(spark, sf_dir).select("doc_id", reason.alias("drop_reason"))


@CATALOG.query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN true ELSE list_position(e, list_max(e)) - 1 = label % 4 END AS kept FROM (SELECT vec_id, label, embedding[1:4] AS e FROM embeddings)")
def rejection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose teacher's top option is not the gold one go; rows without a teacher stay."""
    from granary.functions.arrays import first_argmax

    e = F.slice("embedding", 1, 4)
    return Tables(spark, sf_dir).embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, True).otherwise(first_argmax(e) == F.col("label") % 4).alias("kept"))


_CLEAN = "regexp_replace(regexp_replace(text, '[ ]{2,}', ' ', 'g'), '!{2,}', '!', 'g')"


@CATALOG.query(f"SELECT source, count(*) AS n, count(*) FILTER (cleaned <> text) AS changed FROM (SELECT source, text, CASE WHEN source IN ('src0', 'src1') THEN {_CLEAN} ELSE text END AS cleaned FROM documents) GROUP BY source")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered substitutions within a scope of sources, with change counts."""
    cleaned = F.regexp_replace(F.regexp_replace("text", "[ ]{2,}", " "), "!{2,}", "!")
    out = F.when(F.col("source").isin("src0", "src1"), cleaned).otherwise(F.col("text"))
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(out != F.col("text")).alias("changed"))


@CATALOG.query("WITH spec AS (SELECT n_nationkey, n_regionkey AS want FROM nation), got AS (SELECT c_nationkey, c_nationkey % 5 AS have, count(*) AS n FROM customer GROUP BY ALL) SELECT coalesce(n_nationkey, c_nationkey) AS k, want, have, want IS NOT DISTINCT FROM have AS ok FROM spec FULL JOIN got ON n_nationkey = c_nationkey")
def run_spec_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered settings against actual ones, either side missing included."""
    t = Tables(spark, sf_dir)
    spec = t.nation.select("n_nationkey", F.col("n_regionkey").alias("want"))
    got = t.customer.select("c_nationkey").distinct().select("c_nationkey", (F.col("c_nationkey") % 5).alias("have"))
    both = spec.join(got, F.col("n_nationkey") == F.col("c_nationkey"), "full")
    return both.select(F.coalesce("n_nationkey", "c_nationkey").alias("k"), "want", "have", F.col("want").eqNullSafe(F.col("have")).alias("ok"))


@CATALOG.query(f"WITH d AS (SELECT doc_id, source, lang, {_REASONS} AS own FROM documents) SELECT doc_id, coalesce(own, CASE WHEN bad IS NOT NULL THEN 'problem:' || bad END) AS drop_reason FROM (SELECT doc_id, own, arg_min(own, doc_id) FILTER (own IS NOT NULL) OVER (PARTITION BY source, doc_id // 4) AS bad FROM d)")
def group_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dropped row drops its whole problem; the others carry the first reason in row order."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source").join(drop_reason_chain(spark, sf_dir), "doc_id").withColumn("pid", F.floor(F.col("doc_id") / 4))
    first = F.min_by("excluded_by", F.when(F.col("excluded_by").isNotNull(), F.col("doc_id")))
    bad = d.groupBy("source", "pid").agg(first.alias("bad"))
    return d.join(bad, ["source", "pid"]).select("doc_id", F.coalesce("excluded_by", F.when(F.col("bad").isNotNull(), F.concat(F.lit("problem:"), F.col("bad")))).alias("drop_reason"))


_FILL = "WITH o AS (SELECT doc_id, source, n_chars, contains(text, '!!') AS bad, md5(concat_ws('|', 'fill', CAST(doc_id AS VARCHAR))) AS h FROM documents), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE n_chars END) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - CASE WHEN bad THEN 0 ELSE n_chars END AS before FROM o)"


@CATALOG.query(_FILL + " SELECT doc_id, CASE WHEN bad THEN 'contaminated' WHEN before >= 20000 THEN 'fill:not_needed' END AS drop_reason FROM r")
def fill_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in hash order until the total before a row reaches the target; bad rows are skipped and cost nothing."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", "n_chars", F.contains("text", F.lit("!!")).alias("bad"), F.md5(F.concat_ws("|", F.lit("fill"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    own = F.when(F.col("bad"), 0).otherwise(F.col("n_chars"))
    placed = in_hash_order(d, ["source"], F.col("h"), "doc_id", ranges_for(d.count()), before={"before": own})
    return placed.select("doc_id", F.when(F.col("bad"), "contaminated").when(F.col("before") >= 20000, "fill:not_needed").alias("drop_reason"))


@CATALOG.query("SELECT conv_id, turn, role, 1.0 / count(*) OVER (PARTITION BY conv_id) AS weight FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws('|', 'node', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), turn) AS k FROM conversations) WHERE k <= 3")
def node_cap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three nodes a problem by hash rank; weights are one over the nodes kept."""
    h = F.md5(F.concat_ws("|", F.lit("node"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(h, "turn"))
    kept = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", k.alias("k")).where("k <= 3")
    return kept.select("conv_id", "turn", "role", (1.0 / F.count("*").over(Window.partitionBy("conv_id"))).alias("weight"))


@CATALOG.query("SELECT conv_id, turn, contains(lower(text), 'answer') AS leaks, regexp_matches(text, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS has_word FROM conversations")
def leak_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a step name the answer; does it hold a whole word."""
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.contains(F.lower("text"), F.lit("answer")).alias("leaks"), T.has_phrase(F.col("text"), "the").alias("has_word"))


@CATALOG.query("SELECT source, count(*) AS n, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'short') AS short, count(*) FILTER (r = 'table') AS tables, count(*) FILTER (r = 'shout') AS shouts, md5(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) FILTER (r IS NULL)) AS kept_digest FROM (SELECT doc_id, source, " + _REASONS + " AS r FROM documents) GROUP BY source")
def mixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by drop reason and a digest of the kept ids of each source."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source").join(drop_reason_chain(spark, sf_dir), "doc_id")
    count = lambda r: F.count_if(F.col("excluded_by") == r)
    ids = F.array_sort(F.collect_list(F.when(F.col("excluded_by").isNull(), F.col("doc_id").cast("string"))))
    digest = F.when(F.size(ids) > 0, F.md5(F.array_join(ids, "\n").cast("binary")))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("excluded_by").isNull()).alias("kept"), count("short").alias("short"), count("table").alias("tables"), count("shout").alias("shouts"), digest.alias("kept_digest"))


@CATALOG.query(_LIC_SQL + "SELECT class, count(*) AS n, count(DISTINCT source) AS n_sources FROM c GROUP BY GROUPING SETS ((class), ())")
def release_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a release splits by licence class; the writer partitions by this column."""
    c = _licensed(spark, sf_dir).withColumn("class", licence_max(F.col("own"), F.col("generator")))
    return c.groupingSets([["class"], []], "class").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))
