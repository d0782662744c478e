"""Generators of reasoning items, as table functions over orders: an item depends on (seed, order key, number of lines) alone.

Cases are made in executors from a seeded generator per row, so any row can be
made again anywhere. Every generator solves what it makes by an independent
rule before it yields it.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import hash_number, hash_rank_key
from granary.operators.catalog import Catalog, Tables

CATALOG = Catalog()


def generate(spark: SparkSession, sf_dir: str, make: Callable[[random.Random, int, int], list[tuple]], schema: str, seed: int = 1) -> DataFrame:
    """The rows of ``make(generator, key, size)`` for every order: its key seeds the generator, its number of lines is the case's size."""
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for i, n in zip(b["i"], b["n"], strict=True) for r in make(random.Random(f"{seed}|{i}"), int(i), int(n))]
            yield pd.DataFrame(out, columns=names)

    t = Tables(spark, sf_dir)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    cases = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("i"), F.coalesce("n", F.lit(0)).alias("n"))
    return cases.mapInPandas(rows, schema)


def solve_knights(people: int, statements: list[tuple[int, int, bool]]) -> list[int]:
    """Role masks (bit set: knight) under which each statement (speaker, about, says knight) is true iff its speaker is one."""
    return [m for m in range(1 << people) if all(((m >> s) & 1) == (((m >> a) & 1) == int(k)) for s, a, k in statements)]


def make_knights(rng: random.Random, i: int, size: int) -> list[tuple]:
    people = 3 + size % 4
    while True:
        roles = rng.getrandbits(people)
        said = [(s, (a := rng.choice([x for x in range(people) if x != s])), bool((roles >> a & 1) == (roles >> s & 1))) for s in range(people) for _ in range(2)]
        if solve_knights(people, said) == [roles]:
            return [(i, people, ";".join(f"{s}>{a}={int(k)}" for s, a, k in said), roles)]
        # Statements about others alone leave the mirrored solution; a fixed point breaks the tie.
        said.append((0, 0, True)) if roles & 1 else None
        both = solve_knights(people, said)
        if len(both) == 2:
            return [(i, people, ";".join(f"{s}>{a}={int(k)}" for s, a, k in said) + f";0={roles & 1}", roles)]


@CATALOG.query()
def knights_and_knaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzles with one solution, checked over all role masks."""
    return generate(spark, sf_dir, make_knights, "item_id long, people int, statements string, roles int")


@CATALOG.query("""
WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus) AS k, CAST(l_linestatus = 'O' AS INT) AS same FROM lineitem),
f AS (SELECT o, k, count(*) OVER (PARTITION BY o) AS n, coalesce(sum(1 - same) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS role, sum(1 - same) OVER (PARTITION BY o) % 2 AS odd FROM l)
SELECT o AS l_orderkey, CAST(max(n) AS INT) AS people, CAST(CASE WHEN max(odd) = 1 THEN 0 ELSE 2 END AS BIGINT) AS n_models, CASE WHEN max(odd) = 0 THEN CAST(least(sum(role << (k - 1)), (1 << max(n)) - 1 - sum(role << (k - 1))) AS BIGINT) END AS first FROM f GROUP BY o
""")
def truth_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many role masks satisfy each order's statements, and the first, by enumeration in array functions.

    Line k says of the next one, and the last of the first, that it is a knight if it is open, else a knave; a statement is true iff its
    speaker is a knight. All masks of an order are tried in turn by one fold, which keeps two numbers.
    """
    w = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus")
    o = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["l_linestatus"] == "O").alias("says"))
    n = F.size("says")
    bit = lambda m, k: F.shiftright(m, k).bitwiseAND(1) == 1 if isinstance(k, int) else F.call_function("getbit", m, k) == 1
    holds = lambda m: F.forall(F.transform("says", lambda knight, k: F.struct(knight.alias("knight"), bit(m, k).alias("a"), bit(m, F.pmod(k + 1, n)).alias("b"))), lambda s: (s["a"] == (s["b"] == s["knight"])))
    start = F.named_struct(F.lit("n"), F.lit(0).cast("long"), F.lit("first"), F.lit(None).cast("long"))
    step = lambda s, m: F.when(holds(m), F.named_struct(F.lit("n"), s["n"] + 1, F.lit("first"), F.coalesce(s["first"], m))).otherwise(s)
    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)
    return o.select("l_orderkey", n.alias("people"), F.aggregate(masks, start, step).alias("m")).select("l_orderkey", "people", F.col("m.n").alias("n_models"), F.col("m.first").alias("first"))


def rule_levels(rules: list[tuple[tuple[str, ...], str]]) -> dict[str, int]:
    """A level for each head: not under that of a premise, and over that of a negated one. ValueError if negation runs in a circle."""
    level: dict[str, int] = {}
    heads = {head for _, head in rules}
    changed = True
    while changed:
        changed = False
        for premises, head in rules:
            least = max((level.get(p.removeprefix("not "), 0) + p.startswith("not ") for p in premises), default=0)
            if least > len(heads):
                raise ValueError("negation runs in a circle")
            if least > level.get(head, -1):
                level[head] = least
                changed = True
    return level


def forward_chain(facts: set[str], rules: list[tuple[tuple[str, ...], str]], closed: bool = False) -> set[str]:
    """Closure of facts under rules. With ``closed``, 'not x' holds if x can't be derived: levels are closed one after another, so x is settled before; without it, rules with negation don't fire."""
    known = set(facts)
    usable = rules if closed else [r for r in rules if not any(p.startswith("not ") for p in r[0])]
    level = rule_levels(usable)
    for at in sorted(set(level.values())):
        stage, grew = [r for r in usable if level[r[1]] == at], True
        while grew:
            new = {head for premises, head in stage if all((p[4:] not in known) if p.startswith("not ") else (p in known) for p in premises)} - known
            known |= new
            grew = bool(new)
    return known


def make_rules(rng: random.Random, i: int, size: int) -> list[tuple]:
    atoms = [f"p{k}" for k in range(8)]
    facts = set(rng.sample(atoms, 2))
    rules = [(tuple(rng.sample(atoms, rng.randint(1, 2))), rng.choice(atoms)) for _ in range(4 + size)]
    closure = forward_chain(facts, rules)
    target = rng.choice(atoms)
    other = facts ^ {rng.choice(atoms)}
    return [(i, kind, ",".join(sorted(f)), ";".join("&".join(p) + ">" + h for p, h in rules), target, target in forward_chain(f, rules)) for kind, f in (("base", facts), ("twin", other))] if closure else []


@CATALOG.query()
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets with a counterfactual twin each, labelled by forward chaining."""
    return generate(spark, sf_dir, make_rules, "item_id long, kind string, facts string, rules string, target string, holds boolean")


def eval_chain(gates: list[tuple[str, int, int]], inputs: list[bool]) -> list[bool]:
    values = list(inputs)
    for op, a, b in gates:
        values.append(values[a] and values[b] if op == "and" else values[a] or values[b] if op == "or" else values[a] != values[b])
    return values


def make_chain(rng: random.Random, i: int, size: int) -> list[tuple]:
    inputs = [rng.random() < 0.5 for _ in range(4)]
    gates = [(rng.choice(("and", "or", "xor")), rng.randrange(4 + k), rng.randrange(4 + k)) for k in range(2 + size)]
    final = eval_chain(gates, inputs)[-1]
    pivotal = [k for k in range(4) if eval_chain(gates, [v != (j == k) for j, v in enumerate(inputs)])[-1] != final]
    return [(i, len(gates), "".join("01"[v] for v in inputs), ";".join(f"{o}({a},{b})" for o, a, b in gates), final, ",".join(map(str, pivotal)))]


@CATALOG.query()
def decision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean circuits with their value and the inputs that decide it."""
    return generate(spark, sf_dir, make_chain, "item_id long, depth int, inputs string, gates string, value boolean, pivotal string")


def run_program(steps: list[tuple[str, int, int]], start: list[Fraction], swap: tuple[int, str] | None = None) -> list[Fraction]:
    """Exact values of a straight-line program; ``swap`` replaces the operator of one step."""
    values = list(start)
    for k, (op, a, b) in enumerate(steps):
        op = swap[1] if swap and swap[0] == k else op
        x, y = values[a], values[b]
        values.append(x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y if y else Fraction(0))
    return values


def make_numeric(rng: random.Random, i: int, size: int) -> list[tuple]:
    start = [Fraction(rng.randint(2, 30)) for _ in range(3)]
    steps = [(rng.choice("+-*/"), rng.randrange(3 + k), rng.randrange(3 + k)) for k in range(2 + size % 4)]
    gold = run_program(steps, start)[-1]
    slips = {run_program(steps, start, (k, o))[-1] for k in range(len(steps)) for o in "+-*/" if o != steps[k][0]} - {gold}
    return [(i, ";".join(f"{o}({a},{b})" for o, a, b in steps), ",".join(map(str, start)), str(gold), "|".join(sorted(map(str, slips))[:5]))]


@CATALOG.query()
def numeric_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic programs in exact fractions, with wrong values from swapped operators as distractors."""
    return generate(spark, sf_dir, make_numeric, "item_id long, program string, inputs string, gold string, distractors string")


def replay(moves: list[int], fault: int | None = None) -> tuple[int, bool]:
    """A running sum that must stay even at the end; a fault adds one at its step."""
    total = sum(moves) + (0 if fault is None else 1)
    return total, total % 2 == 0


def make_trajectory(rng: random.Random, i: int, size: int) -> list[tuple]:
    agents = ("planner", "coder", "checker")
    moves = [2 * rng.randint(0, 9) for _ in range(3 + size)]
    fault = rng.randrange(len(moves))
    if not replay(moves)[1] or replay(moves, fault)[1]:
        return []
    return [(i, k, agents[k % 3], m + (k == fault), k == fault) for k, m in enumerate(moves)]


@CATALOG.query()
def simulated_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent logs with one injected fault that replay shows to decide the failure."""
    return generate(spark, sf_dir, make_trajectory, "uid long, step int, agent string, value int, at_fault boolean")


@CATALOG.query("SELECT vec_id, round(a, 6) AS surface, round(b, 6) AS structural, CAST('0x' || substr(md5('bias|' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, b / a) AS kept FROM (SELECT vec_id, 1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS a, 1 / (1 + exp(-4 * CAST(embedding[2] AS DOUBLE))) AS b FROM embeddings WHERE embedding IS NOT NULL)")
def bias_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection of easy rows: kept iff a hash-uniform number is under min(1, structural / surface probability)."""
    e = Tables(spark, sf_dir).embeddings.where("embedding is not null")
    surface = 1 / (1 + F.exp(-4 * F.get("embedding", F.lit(0)).cast("double")))
    structural = 1 / (1 + F.exp(-4 * F.get("embedding", F.lit(1)).cast("double")))
    u = hash_number(hash_rank_key("bias", F.col("vec_id"))) / F.lit(float(1 << 32))
    return e.select("vec_id", F.round(surface, 6).alias("surface"), F.round(structural, 6).alias("structural"), (u < F.least(F.lit(1.0), structural / surface)).alias("kept"))


@CATALOG.query("SELECT n, unnest(list_sort(list_distinct(list_filter([n + 1, n - 1, n * 2, n + 10, n - 10, n * 10], lambda x: x > 0 AND x <> n)))[1:5]) AS distractor FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part)")
def numeric_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five distinct plausible wrong numbers."""
    n = F.col("n")
    near = F.array(n + 1, n - 1, n * 2, n + 10, n - 10, n * 10)
    each = F.slice(F.array_sort(F.array_distinct(F.filter(near, lambda x: (x > 0) & (x != F.col("n"))))), 1, 5)
    return Tables(spark, sf_dir).part.select(F.col("p_size").cast("long").alias("n")).distinct().select("n", F.explode(each).alias("distractor"))


@CATALOG.query()
def exact_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over quantities as exact fractions in lowest terms, by Arrow batches."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [Fraction(str(p)) / Fraction(str(q)) for p, q in zip(b["p"], b["q"], strict=True)]
            yield b[["l_orderkey", "l_linenumber"]].assign(ratio=[str(x) for x in got])

    l = Tables(spark, sf_dir).lineitem
    kinds = {f.name: f.dataType.simpleString() for f in l.schema}
    rows = l.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("p"), F.col("l_quantity").cast("string").alias("q"))
    return rows.mapInPandas(reduce, f"l_orderkey {kinds['l_orderkey']}, l_linenumber {kinds['l_linenumber']}, ratio string")
