"""Noun phrases over a vocabulary made from the corpus, and the kinds of things that sentences define.

*Vocabulary.* Word sequences of up to ``LONGEST`` words that several documents have, without
function words at their ends. *Matching.* Every text's sequences are looked up by hash in the
vocabulary, which is sent to all tasks if its written bytes are few and joined by
a shuffle else; of the hits, one fold a text takes the longest at each place from the
left, without overlaps. A text is read once, whatever the number of patterns.

*Kinds.* The head of the noun phrase after a sentence's first copula is found by
position: words up to the first preposition, conjunction or relative, "one of"
passed over. A table says which kind a head is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrays import let
from granary.operators.catalog import Catalog, Tables
from granary.sources.scratch import scratch_path

CATALOG = Catalog()

LONGEST, LEAST_DOCS = 3, 3
#: A written vocabulary of at most so many bytes is sent to all tasks.
SENT_BYTES = 8 << 20

#: Words that end no phrase, in the languages of the tables.
FUNCTION_WORDS = "the a an of and or in on at to for by with from is was are were be as it that this de la le les des du et en el los las una un y que der die das und ist den dem von zu mit".split()
COPULAS = ("is", "are", "was", "were")
#: What a noun phrase ends before.
ENDS = ("of", "in", "on", "at", "from", "by", "with", "for", "to", "that", "which", "who", "and", "or", "but")


def sequences(words: Column, longest: int) -> Column:
    """(at, n, key) of all word sequences of at most ``longest`` words, by 64-bit hash, which two different ones share with a chance of 2^-64 a pair."""
    at = F.sequence(F.lit(1), F.size(words))
    one = lambda i, n: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice(words, i, F.lit(n))).alias("key"))
    each = lambda n: F.when(F.size(words) >= n, F.transform(F.slice(at, F.lit(1), F.size(words) - (n - 1)), lambda i: one(i, n))).otherwise(F.array().cast("array<struct<at:int,n:int,key:bigint>>"))
    return F.flatten(F.array(*[each(n) for n in range(1, longest + 1)]))


def vocabulary(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_DOCS) -> DataFrame:
    """(key, phrase, n_docs) of the word sequences of two words or more that ``least`` documents have and no function word starts or ends."""
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w"))
    open_ = lambda i: ~F.array_contains(stop, F.get("w", i))
    starts = lambda n: F.filter(F.sequence(F.lit(0), F.size("w") - n), lambda i: open_(i) & open_(i + (n - 1)))
    grams = lambda n: F.when(F.size("w") >= n, F.transform(starts(n), lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    found = words.select(F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(2, longest + 1)])))).alias("phrase"))
    often = found.groupBy("phrase").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)
    return often.select(F.xxhash64(F.split("phrase", " ")).alias("key"), "phrase", "n_docs")


def sent_if_few_bytes(frame: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``frame`` written once, to be broadcast if its files have ``most`` bytes at most."""
    spark = frame.sparkSession
    path = scratch_path(spark, "reference")
    frame.write.parquet(path)
    out, at = spark.read.schema(frame.schema).parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(out) if size <= most else out


def leftmost_longest(hits: Column) -> Column:
    """Of an array of (at, n, ...) the longest at each place from the left, none overlapping."""
    order = F.array_sort(hits, lambda x, y: F.when(x["at"] != y["at"], x["at"] - y["at"]).otherwise(y["n"] - x["n"]))
    kind = "struct<end:int,taken:array<int>>"
    start = F.named_struct(F.lit("end"), F.lit(0), F.lit("taken"), F.array().cast("array<int>")).cast(kind)

    def pick(a: Column) -> Column:
        step = lambda s, i: F.when(F.get(a, i)["at"] > s["end"], F.named_struct(F.lit("end"), F.get(a, i)["at"] + F.get(a, i)["n"] - 1, F.lit("taken"), F.concat(s["taken"], F.array(i))).cast(kind)).otherwise(s)
        return F.transform(F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step)["taken"], lambda i: F.get(a, i))

    return let(order, pick)


def phrase_spans(texts: DataFrame, keys: list[str], vocab: DataFrame, longest: int = LONGEST, most: int = SENT_BYTES) -> DataFrame:
    """(keys, at, n, phrase): vocabulary phrases in texts(keys, text), by word from 1, longest first from the left."""
    grams = texts.select(*keys, let(T.tokens(F.col("text")), lambda w: sequences(w, longest)).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*").where("n > 1")
    hits = grams.join(sent_if_few_bytes(vocab.select("key", "phrase"), most), "key")
    by = hits.groupBy(*keys).agg(F.collect_list(F.struct("at", "n", "phrase")).alias("h"))
    return by.select(*keys, F.explode(leftmost_longest(F.col("h"))).alias("x")).select(*keys, "x.at", "x.n", "x.phrase")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_STOP = "['" + "','".join(FUNCTION_WORDS) + "']"


@CATALOG.query(f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS phrase, n FROM w, (VALUES (2), (3)) v(n) WHERE len(w) >= n),
v AS MATERIALIZED (SELECT phrase FROM g WHERE NOT list_contains({_STOP}, string_split(phrase, ' ')[1]) AND NOT list_contains({_STOP}, string_split(phrase, ' ')[-1]) GROUP BY phrase HAVING count(*) >= {LEAST_DOCS}),
c AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
p AS (SELECT conv_id, turn, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM c, (VALUES (2), (3)) x(n) WHERE len(w) >= n),
h AS MATERIALIZED (SELECT conv_id, turn, pos, max(n) AS n, arg_max(array_to_string(w[pos:pos + n - 1], ' '), n) AS phrase FROM p WHERE array_to_string(w[pos:pos + n - 1], ' ') IN (SELECT phrase FROM v) GROUP BY ALL),
f AS MATERIALIZED (SELECT a.conv_id, a.turn, a.pos, min(b.pos) AS nxt FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos >= a.pos + a.n GROUP BY ALL),
t AS (SELECT conv_id, turn, min(pos) AS pos FROM h GROUP BY ALL UNION ALL SELECT f.conv_id, f.turn, f.nxt FROM t JOIN f USING (conv_id, turn, pos) WHERE f.nxt IS NOT NULL)
SELECT conv_id, turn, CAST(h.pos AS INTEGER) AS word_at, CAST(h.n AS INTEGER) AS n, phrase FROM t JOIN h USING (conv_id, turn, pos)
""")
def vocabulary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that three documents or more have, found in all turns of conversations."""
    t = Tables(spark, sf_dir)
    return phrase_spans(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"], vocabulary(t.documents)).withColumnRenamed("at", "word_at")


def defined_head(text: Column) -> Column:
    """The head noun that a text's first sentence says its subject is, in the singular; null without a copula or a noun phrase."""

    def after_copula(w: Column) -> Column:
        at = F.array_min(F.filter(F.transform(w, lambda x, i: F.when(x.isin(*COPULAS), i + 1)), lambda i: i.isNotNull()))
        return let(F.when(at.isNotNull(), F.slice(w, at + 1, F.size(w))), lambda r: F.when((F.get(r, F.lit(0)) == "one") & (F.get(r, F.lit(1)) == "of"), F.slice(r, F.lit(3), F.size(r))).otherwise(r))

    def head(r: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(F.transform(r, lambda x, i: F.when(x.isin(*ENDS), i)), lambda i: i.isNotNull())), F.size(r))
        return F.nullif(F.regexp_replace(F.get(r, end - 1), "s$", ""), F.lit(""))

    first = F.get(F.split(F.lower(text), r"[.!?](?: |$)", 2), F.lit(0))
    return let(let(F.regexp_extract_all(first, F.lit("[a-z0-9#-]+"), F.lit(0)), after_copula), head)


#: The kinds of the heads that sentences about the tables' rows have.
KINDS = [("country", "place"), ("region", "place"), ("customer", "party"), ("supplier", "party"), ("good", "thing"), ("order", "event")]


def _sql_head(t: str) -> str:
    ins = lambda words: "['" + "','".join(words) + "']"
    w = f"regexp_extract_all(string_split_regex(lower({t}), '[.!?]( |$)')[1], '[a-z0-9#-]+')"
    return f"""(SELECT nullif(regexp_replace(r[coalesce(list_min(list_filter(range(1, len(r) + 1), lambda i: list_contains({ins(ENDS)}, r[i]))), len(r) + 1) - 1], 's$', ''), '')
      FROM (SELECT CASE WHEN q[1] = 'one' AND q[2] = 'of' THEN q[3:] ELSE q END AS r FROM (SELECT CASE WHEN pos IS NOT NULL THEN w[pos + 1:] END AS q
      FROM (SELECT w, list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains({ins(COPULAS)}, w[i]))) AS pos FROM (SELECT {w} AS w)))))"""


_LEADS = """
SELECT 'nation' AS origin, CAST(n_nationkey AS BIGINT) AS id, n_name || ' is a large country in ' || r_name || '. It was an order.' AS t FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT), s_name || ' was one of the oldest suppliers that are left' FROM supplier
UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), c_name || CASE WHEN c_custkey % 2 = 0 THEN ' of ' || c_mktsegment ELSE ' is a regular customer' END FROM customer
UNION ALL SELECT 'part', CAST(p_partkey AS BIGINT), 'Those are ' || p_type || ' goods.' FROM part
UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), text FROM benchmark
"""


@CATALOG.query(f"WITH k(noun, kind) AS (VALUES {', '.join(str(k) for k in KINDS)}), h AS (SELECT origin, id, {_sql_head('t')} AS head FROM ({_LEADS})) SELECT origin, id, head, kind FROM h LEFT JOIN k ON noun = head")
def lead_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first sentences about nations, suppliers, customers, parts and benchmark items say that they are, and of which kind."""
    t = Tables(spark, sf_dir)
    line = lambda origin, key, *text: F.struct(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("id"), F.concat(*[F.lit(x[1:]) if x[0] == "=" else F.col(x) for x in text]).alias("t")).alias("x")
    even = t.customer.where("c_custkey % 2 = 0")
    parts = [
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(line("nation", "n_nationkey", "n_name", "= is a large country in ", "r_name", "=. It was an order.")),
        t.supplier.select(line("supplier", "s_suppkey", "s_name", "= was one of the oldest suppliers that are left")),
        even.select(line("customer", "c_custkey", "c_name", "= of ", "c_mktsegment")),
        t.customer.where("c_custkey % 2 <> 0").select(line("customer", "c_custkey", "c_name", "= is a regular customer")),
        t.part.select(line("part", "p_partkey", "=Those are ", "p_type", "= goods.")),
        t.benchmark.select(line("benchmark", "item_id", "text")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    kinds = spark.createDataFrame(KINDS, "noun string, kind string")
    heads = rows.select("x.origin", "x.id", defined_head(F.col("x.t")).alias("head"))
    return heads.join(F.broadcast(kinds), F.col("head") == F.col("noun"), "left").select("origin", "id", "head", "kind")
