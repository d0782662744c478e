"""Trees and DAGs of reasoning steps: depth, closure, rewiring, views and audits.

Conversations give the graphs: a turn depends on earlier turns of its
conversation, chosen by a rule on the turn number. Nodes that belong to one
item are a bounded array, and depth is a fold over it in order (parents come
before children); closure and rewiring run as joins, round by round, until
nothing changes, with each round written down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.catalog import Catalog, Tables
from granary.sources.scratch import scratch_path

CATALOG = Catalog()

#: The parents of turn t: t // 2 (if t > 0), and t - 3 (if that is a turn and t is even).
_EDGES = "e AS (SELECT conv_id, turn AS child, turn // 2 AS parent FROM conversations WHERE turn > 0 UNION SELECT conv_id, turn, turn - 3 FROM conversations WHERE turn >= 3 AND turn % 2 = 0)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, child, parent)."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn")
    both = F.array(F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2)), F.when((F.col("turn") >= 3) & (F.col("turn") % 2 == 0), F.col("turn") - 3))
    return c.select("conv_id", F.col("turn").alias("child"), F.explode(F.array_distinct(F.array_compact(both))).alias("parent")).distinct()


def node_depths(nodes: Column) -> Column:
    """Array of structs (id, parents) in order, parents first, to a map id -> depth; unknown and self parents don't count."""

    def step(acc: Column, n: Column) -> Column:
        known = F.transform(F.filter(n["parents"], lambda p: (p != n["id"]) & F.map_contains_key(acc, p)), lambda p: F.element_at(acc, p))
        depth = F.coalesce(F.array_max(known) + 1, F.lit(0))
        return F.when(F.map_contains_key(acc, n["id"]), acc).otherwise(F.map_concat(acc, F.map_from_arrays(F.array(n["id"]), F.array(depth))))

    return F.aggregate(nodes, F.create_map().cast("map<bigint,int>"), step)


_DEPTH = f"""WITH RECURSIVE {_EDGES}, k AS (SELECT DISTINCT e.* FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.parent),
d AS (SELECT conv_id, turn AS node, 0 AS depth FROM conversations UNION SELECT d.conv_id, k.child, d.depth + 1 FROM d JOIN k ON k.conv_id = d.conv_id AND k.parent = d.node),
nd AS (SELECT conv_id, node, max(depth) AS depth FROM d GROUP BY ALL) """


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, node, depth)."""
    parents = edges(spark, sf_dir).groupBy("conv_id", F.col("child").alias("turn")).agg(F.collect_list("parent").alias("parents"))
    nodes = Tables(spark, sf_dir).conversations.select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left")
    none = F.array().cast("array<bigint>")
    item = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), F.coalesce("parents", none).alias("parents"))))
    return nodes.groupBy("conv_id").agg(item.alias("nodes")).select("conv_id", F.explode(node_depths(F.col("nodes"))).alias("node", "depth"))


@CATALOG.query(_DEPTH + "SELECT conv_id, node, depth FROM nd")
def node_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 for roots, else one more than the deepest parent."""
    return depths(spark, sf_dir)


@CATALOG.query(_DEPTH + "SELECT depth, count(*) AS n, count(DISTINCT conv_id) AS n_items FROM nd GROUP BY depth")
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_items"))


def closure(e: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys, child, ancestor) of edges (keys, child, parent), by doubling; rounds grow with the log of the depth."""
    reach = e.select(*keys, "child", F.col("parent").alias("ancestor")).distinct()
    n = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.ancestor") == F.col("b.child")])
        reach = reach.unionByName(further.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"))).distinct().checkpoint()
        m = reach.count()
        if m == n:
            return reach
        n = m


def _checkpoints(spark: SparkSession) -> None:
    """The session's shared checkpoint folder; one of our own only where none is set, in local mode."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "closure"))


@CATALOG.query(f"WITH RECURSIVE {_EDGES}, a AS (SELECT conv_id, child, parent AS ancestor FROM e UNION SELECT a.conv_id, a.child, e.parent FROM a JOIN e ON e.conv_id = a.conv_id AND e.child = a.ancestor) SELECT conv_id, child, count(DISTINCT ancestor) AS n_ancestors, min(ancestor) AS first FROM a GROUP BY ALL")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return closure(edges(spark, sf_dir), ["conv_id"]).groupBy("conv_id", "child").agg(F.count("*").alias("n_ancestors"), F.min("ancestor").alias("first"))


@CATALOG.query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT conv_id, child, parent FROM e UNION SELECT r.conv_id, r.child, e.parent FROM r JOIN e ON e.conv_id = r.conv_id AND e.child = r.parent WHERE r.parent % 3 = 1)
SELECT DISTINCT conv_id, child, parent FROM r WHERE child % 3 <> 1 AND parent % 3 <> 1""")
def dag_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped parents are replaced by their nearest kept ancestors."""
    _checkpoints(spark)
    e = edges(spark, sf_dir)
    up = e.select("conv_id", F.col("child").alias("parent"), F.col("parent").alias("above"))
    open_ = e
    done = e.where("parent % 3 <> 1")
    while True:
        open_ = open_.where("parent % 3 = 1").join(up, ["conv_id", "parent"]).select("conv_id", "child", F.col("above").alias("parent")).distinct().checkpoint()
        if not open_.limit(1).count():
            break
        done = done.unionByName(open_.where("parent % 3 <> 1"))
    return done.where("child % 3 <> 1").distinct()


@CATALOG.query(f"WITH {_EDGES} SELECT e.conv_id AS conv_id, e.child AS child, string_agg('[' || CAST(e.parent AS VARCHAR) || '] ' || c.text, chr(10) ORDER BY e.parent) AS context FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.parent GROUP BY e.conv_id, e.child")
def view_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's context: the whole texts of its parents, in order."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", F.col("turn").alias("parent"), F.col("text").alias("t"))
    lines = edges(spark, sf_dir).join(c, ["conv_id", "parent"]).groupBy("conv_id", "child").agg(F.array_sort(F.collect_list(F.struct("parent", "t"))).alias("s"))
    render = lambda x: F.concat(F.lit("["), x["parent"].cast("string"), F.lit("] "), x["t"])
    return lines.select("conv_id", "child", F.array_join(F.transform("s", render), "\n").alias("context"))


@CATALOG.query(_DEPTH + "SELECT conv_id, node, depth, 1.0 / count(*) OVER (PARTITION BY conv_id) AS weight FROM nd WHERE depth <= 2")
def stage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes up to a stage, their weights split anew."""
    d = depths(spark, sf_dir).where("depth <= 2")
    return d.select("conv_id", "node", "depth", (1.0 / F.count("*").over(Window.partitionBy("conv_id"))).alias("weight"))


_MATCH = _DEPTH + """, p AS (SELECT e.conv_id, e.child, e.parent, nd.depth FROM e JOIN nd ON nd.conv_id = e.conv_id AND nd.node = e.parent),
c AS (SELECT p.conv_id, p.child, p.parent, nd.node AS other, row_number() OVER (PARTITION BY p.conv_id, p.child, p.parent ORDER BY abs(nd.depth - p.depth), md5(concat_ws('|', 'match', CAST(p.conv_id AS VARCHAR), CAST(nd.node AS VARCHAR))), nd.node) AS k
  FROM p JOIN nd ON nd.conv_id = p.conv_id AND nd.node < p.child AND NOT EXISTS (SELECT 1 FROM e x WHERE x.conv_id = p.conv_id AND x.child = p.child AND x.parent = nd.node))"""


@CATALOG.query(_MATCH + " SELECT conv_id, child, parent, other FROM c WHERE k = 1")
def matched_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each true parent the non-parent of the same item, earlier than the child, of nearest depth; ties by hash."""
    d = depths(spark, sf_dir)
    e = edges(spark, sf_dir)
    p = e.join(d.select("conv_id", F.col("node").alias("parent"), F.col("depth").alias("pd")), ["conv_id", "parent"])
    c = p.join(d, "conv_id").where("node < child").join(e.select("conv_id", "child", F.col("parent").alias("node")), ["conv_id", "child", "node"], "left_anti")
    h = F.md5(F.concat_ws("|", F.lit("match"), F.col("conv_id").cast("string"), F.col("node").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("conv_id", "child", "parent").orderBy(F.abs(F.col("depth") - F.col("pd")), h, "node"))
    return c.withColumn("k", k).where("k = 1").select("conv_id", "child", "parent", F.col("node").alias("other"))


@CATALOG.query(_MATCH + ", m AS (SELECT c.*, a.depth AS da, b.depth AS db FROM c JOIN nd a ON a.conv_id = c.conv_id AND a.node = c.parent JOIN nd b ON b.conv_id = c.conv_id AND b.node = c.other WHERE k = 1) SELECT count(*) AS n, round(avg(da), 6) AS true_depth, round(avg(db), 6) AS matched_depth FROM m")
def covariate_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of true against matched parents."""
    d = depths(spark, sf_dir)
    m = matched_parents(spark, sf_dir).join(d.select("conv_id", F.col("node").alias("parent"), F.col("depth").alias("da")), ["conv_id", "parent"]).join(d.select("conv_id", F.col("node").alias("other"), F.col("depth").alias("db")), ["conv_id", "other"])
    return m.agg(F.count("*").alias("n"), F.round(F.avg("da"), 6).alias("true_depth"), F.round(F.avg("db"), 6).alias("matched_depth"))


@CATALOG.query("WITH o AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws('|', 'perm', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT a.conv_id, a.turn, b.turn AS target_of FROM o a JOIN o b ON a.conv_id = b.conv_id AND b.k = 1 + a.k % a.n")
def shuffled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control: each node gets the target of the next node of its item in hash order."""
    w = Window.partitionBy("conv_id")
    h = F.md5(F.concat_ws("|", F.lit("perm"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    o = w.orderBy(h, "turn")
    nxt = F.coalesce(F.lead("turn").over(o), F.first("turn").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", nxt.alias("target_of"))


@CATALOG.query(f"WITH {_EDGES} SELECT c.conv_id, array_to_string(list_filter([CASE WHEN count(*) < 2 THEN 'few_nodes' END, CASE WHEN min(turn) <> 0 THEN 'no_root' END, CASE WHEN max(turn) + 1 <> count(*) THEN 'gap' END, CASE WHEN count(text) < count(*) THEN 'empty_text' END], lambda x: x IS NOT NULL), ',') AS failures FROM conversations c GROUP BY c.conv_id")
def node_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant checks of each item as a list of failures."""
    rules = [F.when(F.count("*") < 2, "few_nodes"), F.when(F.min("turn") != 0, "no_root"), F.when(F.max("turn") + 1 != F.count("*"), "gap"), F.when(F.count("text") < F.count("*"), "empty_text")]
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.concat_ws(",", *rules).alias("failures"))


@CATALOG.query("SELECT conv_id, turn, unnest(['claim', 'negation']) AS kind, unnest([text, 'It is not so that ' || text]) AS text FROM conversations")
def claim_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim and its negation as matched rows."""
    pair = F.array(F.struct(F.lit("claim").alias("kind"), F.col("text").alias("t")), F.struct(F.lit("negation").alias("kind"), F.concat(F.lit("It is not so that "), F.col("text")).alias("t")))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.explode(pair).alias("p")).select("conv_id", "turn", "p.kind", F.col("p.t").alias("text"))


@CATALOG.query("SELECT conv_id, turn, sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) // 400 AS pack FROM (SELECT conv_id, turn, length(text) AS size FROM conversations)")
def pack_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an item dealt into packs by running length; a longer node leaves packs empty."""
    size = F.length("text")
    run = F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.floor(run / 400).alias("pack"))


@CATALOG.query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, abs(length(text) - 100), md5(concat_ws('|', 'cand', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), turn) AS k FROM conversations) WHERE k <= 2")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best candidates by tier, length gap and hash."""
    h = F.md5(F.concat_ws("|", F.lit("cand"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "user", 0).otherwise(1), F.abs(F.length("text") - 100), h, "turn"))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", k.alias("k")).where("k <= 2").drop("k")
