"""Foreign records of several nested layouts to typed decision records, by a table of paths over VARIANT.

A layout says where its parts stand (paths), what kind of options it has (an
array of texts, an array of objects, or a map from option to probability) and
how it names the right one (by place, by label, or by the largest probability).
Records are parsed once to VARIANT; paths of the layout that a record names are
taken out with ``try_variant_get``, so a part of another type is a missing part.
Records that make no decision are counted by what they lack. Options are
shuffled by digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.arrays import let
from granary.functions.hashing import hash_rank_key
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()

LAYOUTS = [
    {"layout": "listed", "id": "$.id", "question": "$.q", "options": "$.choices", "kind": "texts", "gold": "$.answer", "named": "place"},
    {"layout": "keyed", "id": "$.meta.key", "question": "$.item.stem", "options": "$.item.options", "kind": "objects", "gold": "$.answerKey", "named": "label"},
    {"layout": "weighed", "id": "$.uid", "question": "$.prompt", "options": "$.candidates", "kind": "weights", "gold": "$.candidates", "named": "weight"},
]
OPTION = "struct<label:string,text:string>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _options(v: Column, layout: dict) -> Column:
    """array<struct<label, text>> of one layout."""
    get = lambda kind: F.try_variant_get(v, layout["options"], kind)
    if layout["kind"] == "texts":
        return F.transform(get("array<string>"), lambda x, i: F.struct(i.cast("string").alias("label"), x.alias("text")).cast(OPTION))
    if layout["kind"] == "objects":
        return get(f"array<{OPTION}>")
    return F.transform(F.array_sort(F.map_keys(get("map<string,double>"))), lambda k: F.struct(k.alias("label"), k.alias("text")).cast(OPTION))


def _gold(v: Column, layout: dict) -> Column:
    """The label of the right option."""
    if layout["named"] == "weight":
        best = lambda m: F.array_min(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))["k"]
        return let(F.try_variant_get(v, layout["gold"], "map<string,double>"), best)
    return F.try_variant_get(v, layout["gold"], "string")


def converted(records: DataFrame, layouts: list[dict] = LAYOUTS, seed: str = "options") -> DataFrame:
    """(line, layout, item_id, question, labels, options, gold_label, reject) of records(line, layout, json).

    ``reject``, the first that holds: ``not_json``, ``layout`` (none of the
    table), ``id``, ``question``, ``options`` (under two, a null or equal texts), ``gold`` (none of the
    options); null for a decision, whose options stand in order of a digest of
    the seed, the id and their text.
    """
    v = F.col("v")
    of = lambda part: reduce(lambda w, l: w.when(F.col("layout") == l["layout"], part(v, l)), layouts[1:], F.when(F.col("layout") == layouts[0]["layout"], part(v, layouts[0])))
    known = F.col("layout").isin(*[l["layout"] for l in layouts])
    text = lambda name: lambda v, l: F.nullif(F.trim(F.try_variant_get(v, l[name], "string")), F.lit(""))
    parsed = records.select("line", "layout", F.try_parse_json("json").alias("v"))
    parts = parsed.select("line", "layout", F.col("v").isNull().alias("broken"), known.alias("known"), of(text("id")).alias("item_id"), of(text("question")).alias("question"), of(_options).alias("o"), of(_gold).alias("gold"))
    texts = F.transform("o", lambda x: x["text"])
    few = F.col("o").isNull() | (F.size("o") < 2) | F.exists("o", lambda x: x["text"].isNull()) | (F.size(F.array_distinct(texts)) < F.size("o"))
    reject = F.when(F.col("broken"), "not_json").when(~F.coalesce("known", F.lit(False)), "layout").when(F.col("item_id").isNull(), "id").when(F.col("question").isNull(), "question").when(few, "options")
    reject = reject.when(~F.coalesce(F.exists("o", lambda x: x["label"] == F.col("gold")), F.lit(False)), "gold")
    drawn = F.array_sort(F.transform("o", lambda x: F.struct(hash_rank_key(seed, F.col("item_id"), x["text"]).alias("h"), x["label"].alias("label"), x["text"].alias("text"))))
    shuffled = parts.withColumn("reject", reject).withColumn("s", F.when(F.col("reject").isNull(), drawn))
    letter = lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))
    at = F.array_position(F.transform("s", lambda x: x["label"]), F.col("gold")).cast("int") - 1
    ok = F.col("reject").isNull()
    return shuffled.select("line", "layout", F.when(ok, F.col("item_id")).alias("item_id"), F.when(ok, F.col("question")).alias("question"), F.transform("s", lambda _, i: letter(i)).alias("labels"), F.transform("s", lambda x: x["text"]).alias("options"), F.when(ok, letter(at)).alias("gold_label"), "reject")


def foreign_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, layout, json): parts as questions in one of three layouts, some of them broken."""
    p = Tables(spark, sf_dir).part
    k = F.col("p_partkey")
    q, brand, kind = F.concat(F.lit("What is part "), k.cast("string"), F.lit("?")), F.col("p_brand"), F.col("p_type")
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    listed = F.to_json(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.when(k % 11 == 0, F.lit(" ")).otherwise(q).alias("q"), F.array(brand, kind, size).alias("choices"), (k % F.when(k % 5 == 0, 9).otherwise(3)).alias("answer")))
    one = lambda label, t: F.struct(F.lit(label).alias("label"), t.alias("text"))
    keyed = F.to_json(F.struct(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("key")).alias("meta"), F.struct(q.alias("stem"), F.when(k % 13 == 0, F.array(one("A", brand))).otherwise(F.array(one("A", brand), one("B", kind), one("C", size))).alias("options")).alias("item"), F.when(k % 2 == 0, "B").otherwise("C").alias("answerKey")))
    weighed = F.to_json(F.struct(F.when(k % 17 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("uid"), q.alias("prompt"), F.map_from_arrays(F.array(brand, kind, size), F.array(F.lit(0.25), (k % 4) / 4, F.lit(0.5))).alias("candidates")))
    layout = F.when(k % 19 == 0, "other").when(k % 3 == 0, "listed").when(k % 3 == 1, "keyed").otherwise("weighed")
    json = F.when(k % 3 == 0, listed).when(k % 3 == 1, keyed).otherwise(weighed)
    return p.select(k.cast("long").alias("line"), layout.alias("layout"), F.when(k % 23 == 0, F.substring(json, F.lit(1), F.length(json) - 1)).otherwise(json).alias("json"))


@CATALOG.query(f"""
WITH p AS (SELECT p_partkey AS k, 'What is part ' || p_partkey || '?' AS q, [p_brand, p_type, 'size ' || p_size] AS o FROM part),
c AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'other' WHEN k % 3 = 0 THEN 'listed' WHEN k % 3 = 1 THEN 'keyed' ELSE 'weighed' END AS layout,
  CASE k % 3 WHEN 0 THEN 1 + k % CASE WHEN k % 5 = 0 THEN 9 ELSE 3 END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END ELSE CASE WHEN k % 4 = 3 THEN 2 WHEN k % 4 = 2 AND o[2] < o[3] THEN 2 ELSE 3 END END AS g FROM p),
r AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'not_json' WHEN layout = 'other' THEN 'layout' WHEN k % 3 = 2 AND k % 17 = 0 THEN 'id' WHEN k % 3 = 0 AND k % 11 = 0 THEN 'question' WHEN k % 3 = 1 AND k % 13 = 0 THEN 'options' WHEN g > 3 THEN 'gold' END AS reject FROM c),
s AS (SELECT *, list_transform(list_sort(list_transform(o, lambda x: md5(concat_ws('|', 'options', 'p' || k, x)) || x)), lambda x: x[33:]) AS s FROM r)
SELECT CAST(k AS BIGINT) AS line, layout, reject, CASE WHEN reject IS NULL THEN 'p' || k END AS item_id, CASE WHEN reject IS NULL THEN q END AS question, CASE WHEN reject IS NULL THEN ['A', 'B', 'C'] END AS labels,
       CASE WHEN reject IS NULL THEN s END AS options, CASE WHEN reject IS NULL THEN substr('{LETTERS}', CAST(list_position(s, o[g]) AS INTEGER), 1) END AS gold_label FROM s
""")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' questions from three foreign layouts as decision records, with what is rejected and why."""
    return converted(foreign_records(spark, sf_dir))
