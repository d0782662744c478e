"""Edits that make a true statement false: opposites and relations learnt from the corpus, checked against all it states.

*Statements* are texts cut at full stops, question and exclamation marks and line ends, as lower-case words.

*Opposites.* A frame is the word before and the word after a place; it contrasts
if exactly two words fill it in the whole corpus. Two words are opposites if they
share ``LEAST_FRAMES`` contrasting frames or more and each is the other's most
frequent rival (ties: smallest in code-point order). A frame gives one pair at most, so work grows with the
words read, whatever the frames that many words fill.

*Relations.* The first copula of a statement, with an article after it, joins a
subject and an object. A swap gives the object of another statement of the same
relation and object length, a permutation in which none keeps its own; a
reversal exchanges the two sides. The edit must read as another relation than its
statement does.

No edit is kept that some statement of the corpus makes: edits and statements meet by
SHA-256 of their words (relations: of both sides and the relation, without number,
the form of articles and an article in front), so long statements aren't shuffled.

Null and empty texts state nothing; repeated statements are edited once and
counted; where one object makes up over half of its class, no swap exists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrays import let
from granary.functions.hashing import hash_rank_key
from granary.operators.catalog import Catalog, Tables
from granary.operators.controls import placebo_partners
from granary.operators.phrases import COPULAS, sent_if_few_bytes
from granary.sources.scratch import written

CATALOG = Catalog()

LEAST_FRAMES = 2
#: What may fill a frame.
WORD = "^[a-z]{3,}$"
#: Bits of a word's hash in each of the two sums that tell frames of two words from frames of more, which pass for such with a chance of 2^-48; sums of 2^38 words fit a long.
PART_BITS = 24
ENDS = "[.!?\\n]+"
ARTICLES = ("a", "an")


def statements(texts: DataFrame) -> DataFrame:
    """(w): the words of every statement of texts(text), those without a word left out."""
    cut = texts.where("text is not null").select(F.explode(F.split("text", ENDS)).alias("s"))
    # Tested on the string, as a filter on the words would make them twice.
    return cut.where(F.lower("s").rlike("[a-z0-9]")).select(T.tokens(F.col("s")).alias("w"))


def sentence(w: Column) -> Column:
    return F.array_join(w, " ")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def two_fill(a: Column, b: Column, n: Column, low: Column, high: Column) -> Column:
    """Whether ``n`` values with the least ``a`` and the largest ``b`` are these two only, by the sums of their parts: p times a's and n - p times b's, for one whole p."""
    parts = [(part(a), part(b), total) for part, total in ((low_part, low), (high_part, high))]
    (d, e), (d2, e2) = [(x - y, total - n * y) for x, y, total in parts]
    p = F.when(d != 0, F.try_divide(e, d)).otherwise(F.try_divide(e2, d2)).cast("long")
    return (a != b) & (p > 0) & (p < n) & (p * d == e) & (p * d2 == e2)


def low_part(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long"))


def high_part(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - PART_BITS)


def opposites(stated: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """(word, opposite, n_frames) of statements(w), in both directions.

    Words and frames are hashes of 64 bits until pairs are left. A frame's state is five numbers that add up, whatever
    fills it, so the words are shuffled once, a hot frame as one row a task.
    """
    places = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda l, i: F.when(F.get("w", i + 1).rlike(WORD), F.struct(F.xxhash64(l, F.get("w", i + 2)).alias("frame"), F.xxhash64(F.get("w", i + 1)).alias("h"))))
    fills = stated.select(F.explode(F.array_compact(places)).alias("p")).select("p.*")
    h = F.col("h")
    sums = fills.groupBy("frame").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"), F.sum(low_part(h)).alias("low"), F.sum(high_part(h)).alias("high"))
    pairs = sums.where(two_fill(*[F.col(c) for c in ("a", "b", "n", "low", "high")])).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    names = stated.select(F.explode("w").alias("word")).where(F.col("word").rlike(WORD)).distinct().select(F.xxhash64("word").alias("h"), "word")
    named = lambda side, name: names.select(F.col("h").alias(side), F.col("word").alias(name))
    pairs = pairs.join(named("a", "x"), "a").join(named("b", "y"), "b").select("x", "y", "n")
    sides = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other")), F.struct(F.col("y").alias("word"), F.col("x").alias("other")))
    best = pairs.select(F.explode(sides).alias("s"), "n").groupBy("s.word").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("s.other").alias("other"))).alias("x")).select("word", F.col("x.other").alias("opposite"), (-F.col("x.n")).alias("n_frames"))
    back = best.select(F.col("word").alias("opposite"), F.col("opposite").alias("word"))
    return best.join(back, ["word", "opposite"])


def with_article(w: Column) -> Column:
    """Words in which 'a' and 'an' go by the letter that follows; one at the end stays."""
    follows = lambda i: F.get(w, i + 1)
    return F.transform(w, lambda x, i: F.when(x.isin(*ARTICLES) & follows(i).isNotNull(), F.when(follows(i).rlike("^[aeiou]"), "an").otherwise("a")).otherwise(x))


def opposite_edits(claims: DataFrame, table: DataFrame, stated: DataFrame) -> DataFrame:
    """(statement, n, at, word, opposite, variant): each word of claims(w) replaced by its opposite, where the statement has not both and ``stated`` does not say so.

    Only digests of statements travel with their words; a statement is met again by those that have an opposite.
    """
    once = claims.groupBy(sentence(F.col("w")).alias("statement")).agg(F.count("*").alias("n")).withColumn("key", digest(F.col("statement")))
    each = once.select("key", F.posexplode(F.split("statement", " ")).alias("at", "word"))
    hits = each.join(sent_if_few_bytes(table.select("word", "opposite")), "word").groupBy("key").agg(F.collect_list(F.struct("at", "word", "opposite")).alias("hits"))
    edits = once.join(hits, "key").withColumn("w", F.split("statement", " ")).select("statement", "n", "w", F.explode("hits").alias("h")).where(~F.array_contains("w", F.col("h.opposite")))
    put = F.transform("w", lambda x, i: F.when(i == F.col("h.at"), F.col("h.opposite")).when((i == F.col("h.at") - 1) & x.isin(*ARTICLES), F.when(F.col("h.opposite").rlike("^[aeiou]"), "an").otherwise("a")).otherwise(x))
    out = edits.select("statement", "n", (F.col("h.at") + 1).alias("at"), "h.word", "h.opposite", sentence(put).alias("variant"))
    known = stated.select(digest(sentence(F.col("w"))).alias("key")).distinct()
    return out.withColumn("key", digest(F.col("variant"))).join(known, "key", "left_anti").drop("key")


def relation_parts(w: Column) -> Column:
    """(subject, relation, object, canon) at the first copula of words, the article after it taken to the relation; null without a word on both sides."""
    forms = (("^are", "is"), ("^were", "was"), (" an$", " a"))
    cut = lambda p, n: F.struct(sentence(F.slice(w, F.lit(1), p)).alias("subject"), sentence(F.slice(w, p + 1, n)).alias("relation"), sentence(F.slice(w, p + n + 1, F.size(w))).alias("object"))
    first = F.array_min(F.filter(F.transform(w, lambda x, i: F.when(x.isin(*COPULAS), i)), lambda i: i.isNotNull()))
    parts = let(first, lambda p: F.when(p > 0, cut(p, F.when(F.get(w, p + 1).isin(*ARTICLES), 2).otherwise(1))))
    canon = lambda x: reduce(lambda c, f: F.regexp_replace(c, *f), forms, x["relation"])
    return let(parts, lambda x: F.when(x["object"] != "", F.struct(x["subject"], x["relation"], x["object"], canon(x).alias("canon"))))


def relations(stated: DataFrame) -> DataFrame:
    return stated.select(relation_parts(F.col("w")).alias("p")).where("p is not null").select("p.*")


def bare(subject: Column) -> Column:
    return F.regexp_replace(subject, "^an? ", "")


def fact(subject: Column, canon: Column, object: Column) -> Column:
    """What makes two statements the same relation: articles before the subject don't count."""
    return digest(bare(subject), canon, object)


def relation_edits_of(claims: DataFrame, stated: DataFrame) -> DataFrame:
    """(subject, relation, object, kind, variant): swapped objects and exchanged sides that nothing in ``stated`` says. An exchange leaves articles in front of the sides."""
    words = lambda c: F.split(c, " ")
    key, kind = digest(F.col("subject"), F.col("relation"), F.col("object")), F.concat_ws("|", "canon", F.size(words(F.col("object"))).cast("string"))
    mine = written(relations(claims).distinct().withColumns({"key": key, "class": kind}), "relations")
    paired = placebo_partners(mine.select("class", "object", "key"), "class", "object", "key", hash_rank_key("swap", F.col("object"))).where("partner is not null").select("key", "partner")
    donors = paired.join(mine.select(F.col("key").alias("partner"), F.col("object").alias("new")), "partner").select("key", "new")
    as_variant = lambda kind, left, right: [F.lit(kind).alias("kind"), sentence(with_article(words(F.concat_ws(" ", left, "relation", right)))).alias("variant")]
    own = ["subject", "relation", "object", "canon"]
    swaps = mine.join(donors, "key").where(~F.arrays_overlap(words(F.col("new")), words(F.col("subject")))).select(*own, *as_variant("swap", F.col("subject"), F.col("new")))
    led = F.col("subject").rlike("^an? ") & F.col("relation").rlike(" an?$")
    turned = mine.select(*own, *as_variant("reverse", F.when(led, F.concat(F.lit("a "), "object")).otherwise(F.col("object")), F.when(led, bare(F.col("subject"))).otherwise(F.col("subject"))))
    said = lambda p: fact(p["subject"], p["canon"], p["object"])
    both = swaps.unionByName(turned).withColumn("w", words(F.col("variant"))).withColumn("fact", said(relation_parts(F.col("w"))))
    other = both.where(F.col("fact").isNull() | (F.col("fact") != fact(F.col("subject"), F.col("canon"), F.col("object"))))
    known = relations(stated).select(fact(F.col("subject"), F.col("canon"), F.col("object")).alias("fact")).distinct()
    return other.join(known, "fact", "left_anti").select("subject", "relation", "object", "kind", "variant")


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements of conversations, and all statements there are."""
    t = Tables(spark, sf_dir)
    claims = statements(t.conversations.select("text"))
    return claims, claims.unionByName(statements(t.documents.select("text"))).unionByName(statements(t.benchmark.select("text")))


def _sql_statements(table: str) -> str:
    return f"SELECT regexp_extract_all(lower(s), '[a-z0-9]+') AS w FROM (SELECT unnest(regexp_split_to_array(text, '{ENDS}')) AS s FROM {table} WHERE text IS NOT NULL) WHERE regexp_matches(lower(s), '[a-z0-9]')"


_JOIN = "array_to_string({0}, ' ')"
_OPPOSITES = f"""
WITH d AS MATERIALIZED ({_sql_statements('documents')}),
c AS MATERIALIZED ({_sql_statements('conversations')}),
k AS MATERIALIZED (SELECT w FROM c UNION ALL SELECT w FROM d UNION ALL {_sql_statements('benchmark')}),
p AS (SELECT w[i] AS l, w[i + 1] AS m, w[i + 2] AS r FROM d, unnest(range(1, greatest(len(w) - 1, 1))) t(i)),
f AS (SELECT l, r, min(m) AS a, max(m) AS b FROM (SELECT DISTINCT l, m, r FROM p WHERE regexp_full_match(m, '[a-z]{{3,}}')) GROUP BY l, r HAVING count(*) = 2),
g AS (SELECT a, b, count(*) AS n FROM f GROUP BY a, b HAVING count(*) >= {LEAST_FRAMES}),
s AS (SELECT a AS word, b AS other, n FROM g UNION ALL SELECT b, a, n FROM g),
x AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM s),
o AS MATERIALIZED (SELECT y.word, y.other AS opposite, y.n AS n_frames FROM x y JOIN x z ON y.word = z.other AND y.other = z.word WHERE y.k = 1 AND z.k = 1)
"""


@CATALOG.query(_OPPOSITES + "SELECT word, opposite, n_frames FROM o")
def contrast_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposites learnt from the frames of all documents."""
    return opposites(statements(Tables(spark, sf_dir).documents.select("text")))


@CATALOG.query(
    _OPPOSITES
    + f""", u AS (SELECT {_JOIN.format('w')} AS statement, any_value(w) AS w, count(*) AS n FROM c GROUP BY 1),
e AS (SELECT statement, w, n, unnest(range(1, len(w) + 1)) AS pos FROM u),
v AS (SELECT statement, n, pos, word, opposite, {_JOIN.format("list_transform(w, lambda y, i: CASE WHEN i = pos THEN opposite WHEN i = pos - 1 AND y IN ('a', 'an') THEN CASE WHEN regexp_matches(opposite, '^[aeiou]') THEN 'an' ELSE 'a' END ELSE y END)")} AS variant
  FROM e JOIN o ON w[pos] = word WHERE NOT list_contains(w, opposite))
SELECT statement, n, CAST(pos AS INTEGER) AS at, word, opposite, variant FROM v WHERE variant NOT IN (SELECT {_JOIN.format('w')} FROM k)"""
)
def opposite_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements of conversations with one word turned into its opposite."""
    claims, stated = corpus(spark, sf_dir)
    return opposite_edits(claims, contrast_words(spark, sf_dir), stated)


_COPULAS = "[" + ", ".join(f"'{c}'" for c in COPULAS) + "]"
_CANON = "regexp_replace(regexp_replace(regexp_replace(relation, '^are', 'is'), '^were', 'was'), ' an$', ' a')"


def _sql_parts(source: str, kept: str = "") -> str:
    """The parts of the words ``w`` of ``source``, beside the columns ``kept``."""
    first = f"list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains({_COPULAS}, w[i])))"
    cut = f"""SELECT {kept} {_JOIN.format('w[:q - 1]')} AS subject, {_JOIN.format('w[q:q + art]')} AS relation, {_JOIN.format('w[q + art + 1:]')} AS object
      FROM (SELECT *, CASE WHEN w[q + 1] IN ('a', 'an') THEN 1 ELSE 0 END AS art FROM (SELECT *, {first} AS q FROM {source})) WHERE q > 1"""
    return f"SELECT *, {_CANON} AS canon, regexp_replace(subject, '^an? ', '') AS bare FROM ({cut}) WHERE object <> ''"


@CATALOG.query(
    f"""
WITH c AS MATERIALIZED ({_sql_statements('conversations')}),
k AS MATERIALIZED (SELECT w FROM c UNION ALL {_sql_statements('documents')} UNION ALL {_sql_statements('benchmark')}),
m AS MATERIALIZED (SELECT DISTINCT *, sha256(concat_ws('|', subject, relation, object)) AS key, md5(concat_ws('|', 'swap', object)) AS h, canon || '|' || len(string_split(object, ' ')) AS class FROM ({_sql_parts('c')})),
known AS MATERIALIZED (SELECT DISTINCT bare, canon, object FROM ({_sql_parts('k')})),
z AS (SELECT class, max(q) AS most FROM (SELECT class, object, count(*) AS q FROM m GROUP BY ALL) GROUP BY class),
r AS (SELECT m.*, most, row_number() OVER (PARTITION BY class ORDER BY h, key) AS k, count(*) OVER (PARTITION BY class) AS n FROM m JOIN z USING (class)),
e AS (SELECT a.subject, a.relation, a.object, 'swap' AS kind, a.subject AS l, b.object AS r FROM r a JOIN r b ON a.class = b.class AND 2 * a.most <= a.n AND b.k = (a.k - 1 + a.most) % a.n + 1 WHERE NOT list_has_any(string_split(b.object, ' '), string_split(a.subject, ' '))
  UNION ALL SELECT subject, relation, object, 'reverse', CASE WHEN led THEN 'a ' || object ELSE object END, CASE WHEN led THEN bare ELSE subject END FROM (SELECT *, subject <> bare AND regexp_matches(relation, ' an?$') AS led FROM m)),
t AS (SELECT *, string_split(concat_ws(' ', l, relation, r), ' ') AS q FROM e),
v AS (SELECT row_number() OVER () AS i, subject AS s0, relation AS r0, object AS o0, kind, list_transform(q, lambda y, i: CASE WHEN y IN ('a', 'an') AND i < len(q) THEN CASE WHEN regexp_matches(q[i + 1], '^[aeiou]') THEN 'an' ELSE 'a' END ELSE y END) AS w FROM t),
f AS ({_sql_parts('v', 'i, s0, r0, o0,')}),
bad AS (SELECT i FROM f WHERE (bare, canon, object) IN (SELECT bare, canon, object FROM known) OR (bare = regexp_replace(s0, '^an? ', '') AND object = o0 AND canon = {_CANON.replace('relation', 'r0')}))
SELECT s0 AS subject, r0 AS relation, o0 AS object, kind, {_JOIN.format('w')} AS variant FROM v WHERE i NOT IN (SELECT i FROM bad)"""
)
def relation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of conversations with swapped objects or exchanged sides."""
    return relation_edits_of(*corpus(spark, sf_dir))
