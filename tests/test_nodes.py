"""False variants, wrong values, negation pairs, kinds, policies and power on cases whose results are known."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from granary.operators import nodes as N
from granary.operators import records as R
from tests.compare import connect, same
from tests.test_units import one


#: Pairs of texts with the overlap worked out by hand; None: no near-negations.
CASES = [
    ("The cat is on the mat", "The cat isn't on the mat", 1.0),  # cat on mat twice, one negation
    ("Tom walked home", "Tom did not walk home", 1.0),  # "did" is light, "walked" loses its ending
    ("Tea with sugar", "Tea without sugar", 1.0),  # "without" is a negated "with"
    ("the dog ran and the dog sat", "the dog never ran and sat", 0.889),  # 4 of 5 and 4 words in order: 8/9
    ("Two doors stay open all day", "Two doors never stay open all", 0.909),  # 5 of 6 and 5: 10/11
    ("b times d is e", "d times b is not e", None),  # the same words, but two in order only: 4/8
    ("red green blue", "blue green not red", None),  # one in order: 2/6
    ("one two three four", "one two three not five six", None),  # three words are not shared
    ("studies show it", "no study shows that", None),  # 4/5 is under the least overlap
    ("not this cat here", "not that cat here", None),  # both negated
    ("cats sleep", "cats eat", None),  # none negated
    ("not", "yes", None),
    ("", "no", None),
    (None, "not a thing", None),
]


def test_negation_pairs_by_hand(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(CASES)] + [(100 + i, b, a) for i, (a, b, _) in enumerate(CASES)]
    got = {r["i"]: r["overlap"] for r in N.negation_pairs_of(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b").collect()}
    want = {i: v for i, (_, _, v) in enumerate(CASES) if v}
    assert got == want | {100 + i: v for i, v in want.items()}


def test_negation_pairs_of_all_lines(spark, tmp_path):
    """Every line of a turn meets its own negation and the line after it, which may stand in the next turn."""
    turns = [(1, 0, "user", "Water is wet today\nThe two doors are shut\nno verb here"), (1, 1, "assistant", "The two doors are not shut\nThe two doors are shut"), (2, 0, "user", None), (3, 0, "user", "It never rains here")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in N.negation_pairs(spark, f"file://{tmp_path}").collect()}
    assert got == {(1, 0, 1, "negation", 1.0), (1, 0, 2, "negation", 1.0), (1, 1, 1, "negation", 1.0), (1, 1, 1, "next", 1.0), (1, 1, 2, "negation", 1.0)}


def test_negated(spark):
    n = lambda t: one(spark, N.negated(F.lit(t).cast("string")))
    assert n("Water is wet and is cold") == "Water is not wet and is cold"
    assert n("Water is not wet") == "Water is wet"
    assert n("It can") == "It can not"
    assert [n(t) for t in ("Water flows", "It never is", "", None, "this island")] == [None] * 5


def test_wrong_values(spark):
    w = lambda v, gold, others: one(spark, N.wrong_value(F.lit(v).cast("long"), F.lit(gold).cast("long"), F.array(*[F.lit(x).cast("long") for x in others]), F.lit(1)))
    assert w(1, 2, [1, 2]) == 11
    assert w(1, 2, [1, 2, 11]) is None
    assert {w(v, 0, [v]) for v in range(1, 40)}.isdisjoint({0, None})


def test_forms_of_answers(spark):
    c = lambda t: one(spark, N.answer_class(F.lit(t).cast("string")))
    assert [c(t) for t in ("1999", "2024-01-31", "3 May 1999", "1,200.5", "$7", "no", "New York", "in the end", "", None)] == ["year", "date", "date", "number", "number", "yes_no", "name", "phrase", "phrase", None]


def test_policies(spark):
    rows = [(1, 0, "train", ["x"]), (2, 1, "train", ["x", "y"]), (3, 1, "val", ["x"]), (4, 2, "train", []), (5, 9, "train", ["x"])]
    items = spark.createDataFrame(rows, "id int, part int, split string, nodes array<string>")
    policies = R.readers.config_table(spark, R.POLICIES, "part int, nodes string, licence_class string, node_basis string")
    got = {r["id"]: (r["nodes"], r["n_dropped"], r["node_basis"], r["lab_only"]) for r in R.apply_policy(items, policies, "part").collect()}
    assert got == {1: (["x"], 0, "program", False), 2: ([], 2, "none", False), 3: (["x"], 0, "program", False), 4: ([], 0, "none", True)}


def test_power_and_units(spark):
    p = lambda a, b, n: one(spark, R.power_of_pairs(F.lit(a), F.lit(b), F.lit(n)))
    z = NormalDist().inv_cdf(0.975)
    assert p(0.3, 0.1, 400) == pytest.approx(NormalDist().cdf((0.1 * 20 - z * math.sqrt(0.3)) / math.sqrt(0.29)))
    assert [p(0.01, 0.1, 400), p(0.3, 0.1, 0)] == [None, None]
    u = lambda v, d: one(spark, R.units_needed(F.lit(v), F.lit(d)))
    assert u(2.0, 0.5) == pytest.approx((z + NormalDist().inv_cdf(0.8)) ** 2 * 2 / 0.25)
    assert [u(0.0, 0.5), u(2.0, 0.0)] == [None, None]


def test_paired_power_of_the_table(spark, small):
    df = R.paired_power(spark, small)
    same(df.drop("power", "pairs", "units"), connect(small), R.PAIRED_POWER_SQL)
    z, q = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)
    for r in df.collect():
        left = r["discordant"] - r["difference"] ** 2
        assert r["power"] == pytest.approx(NormalDist().cdf((r["difference"] * math.sqrt(r["n"]) - z * math.sqrt(r["discordant"])) / math.sqrt(left)))
        assert r["pairs"] == math.ceil(((z * math.sqrt(r["discordant"]) + q * math.sqrt(left)) / r["difference"]) ** 2)


def test_append_goes_on_where_it_was(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "run long, step long, loss double"
    first = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], schema)
    first.write.json(path)
    more = spark.createDataFrame([(1, 2, 9.0), (1, 3, 0.3), (2, 1, 0.1)], schema)
    for _ in range(2):
        R.append_new(more, path, ["run", "step"], schema)
    assert sorted(map(tuple, spark.read.schema(schema).json(path).collect())) == [(1, 1, 0.5), (1, 2, 0.4), (1, 3, 0.3), (2, 1, 0.1)]


def test_negation_of_long_lines(spark):
    """Lines of thousands of words, of which each was looked for among all others; repeated and swapped words, and words that only look like negations."""
    import time

    words = [f"w{k}" for k in range(6000)]
    rows = [(k, " ".join(words), " ".join([*words[:k], "not", *words[k:]])) for k in range(24)]
    rows += [(100, "a1 b1 b1 c1", "a1 never b1 c1 b1"), (101, "a1 b1 b1 c1", "a1 b1 c1 not"), (102, "noble another", "noble another"), (103, "a1 b1 knot", "a1 b1 knots without"), (104, None, "not a1"), (105, "x1 y1", "x1 don’t y1")]
    began = time.time()
    got = {r["i"]: r["overlap"] for r in N.negation_pairs_of(spark.createDataFrame(rows, "i int, a string, b string").repartition(4), "a", "b").collect()}
    assert time.time() - began < 40
    # One word of seven stands alone, as "knots" loses its ending and "without" counts as "with".
    assert got == dict.fromkeys(range(24), 1) | {101: 0.857, 103: 0.857, 105: 1}
