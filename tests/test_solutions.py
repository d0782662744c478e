"""Exact expressions against Python's fractions, and solution graphs against a plain loop."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import exact
from granary.operators import solutions

PROBLEMS = {
    "": "empty", "  ": "empty", "1+": "operand", "*2": "operand", "()": "operand", "5//2": "operand", "2(3)": "operator", "(1)2": "operator", "1..2": "operator", "(1+2": "parenthesis",
    "1+2)": "parenthesis", "a+1": "symbol", "1^2": "symbol", "%5": "percent", "(3)%": "percent", "3%%": "percent", "1/0": "zero", "1/(2-2)": "zero", "9" * 39: "large", "9" * 20 + "*" + "9" * 20: "large",
}


def run(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", exact.expression(F.col("t")).alias("e")).select("i", "e.*").orderBy("i").collect()
    return [(r["num"], r["den"], r["problem"]) for r in rows]


def test_problems_are_named(spark):
    assert dict(zip(PROBLEMS, [p for _, _, p in run(spark, list(PROBLEMS))], strict=True)) == PROBLEMS
    assert run(spark, [None])[0] == (None, None, "empty")


def test_percent_commas_and_signs(spark):
    want = {"50%*80": 40, "1,000*$2": 2000, "1.25x4": 5, "6÷4": Fraction(3, 2), "--5": 5, "-+-2": 2, "2--3": 5, "-2*-3": 6, "3*-2+1": -5, "7%": Fraction(7, 100), ".5+1.": Fraction(3, 2), "0/5": 0, "-(-4)/-6": Fraction(-2, 3)}
    assert [Fraction(int(n), int(d)) for n, d, _ in run(spark, list(want))] == list(want.values())


def value(node):
    """(text, exact value or None) of a nested tuple, by plain recursion."""
    if isinstance(node, str):
        return node, Fraction(node)
    if node[0] == "neg":
        t, v = value(node[1])
        return f"-({t})", None if v is None else -v
    (a, x), (b, y) = value(node[1]), value(node[2])
    text = f"({a}){node[0]}({b})"
    if x is None or y is None or node[0] == "/" and y == 0:
        return text, None
    return text, {"+": x + y, "-": x - y, "*": x * y}[node[0]] if node[0] != "/" else x / y


TREES = st.recursive(
    st.one_of(st.integers(0, 999).map(str), st.tuples(st.integers(0, 99), st.integers(0, 99)).map(lambda p: f"{p[0]}.{p[1]:02d}")),
    lambda s: st.one_of(st.tuples(st.sampled_from("+-*/"), s, s), st.tuples(st.just("neg"), s)),
    max_leaves=6,
)


@settings(max_examples=6, deadline=None)
@given(st.lists(TREES, min_size=40, max_size=40))
def test_trees_equal_fractions(spark, trees):
    both = [value(t) for t in trees]
    for (text, v), (n, d, p) in zip(both, run(spark, [t for t, _ in both]), strict=True):
        assert (p == "zero") if v is None else Fraction(int(n), int(d)) == v and (int(n), int(d)) == (v.numerator, v.denominator), text


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["+", "-", "*", "/", "+-", "*-"]), st.integers(1, 60)), max_size=7), min_size=30, max_size=30))
def test_precedence_without_parentheses(spark, rows):
    texts = ["7" + "".join(f"{op}{k}" for op, k in r) for r in rows]
    want = [eval(re.sub(r"\d+", r"Fraction(\g<0>)", t)) for t in texts]
    assert [Fraction(int(n), int(d)) for n, d, _ in run(spark, texts)] == want


def plain_fraction(text):
    """Value of an expression without malformed parts, by Python's own parser; None if it has some."""
    text = re.sub(r"[\s,$]", "", text)
    try:
        return eval(re.sub(r"\d+(?:\.\d*)?|\.\d+", lambda m: f"Fraction('{m.group()}')", text)) if re.fullmatch(r"[\d.+*/()-]+", text) else None
    except (SyntaxError, ZeroDivisionError, TypeError):
        return None


def shown(v):
    return None if v is None else str(v)


def plain_solution(question, solution):
    """([(expr, value, stated, verdict)], {step: (level, parents, state)} or None) of one solution."""
    work, _, answer = solution.partition("####")
    steps = []
    for e, s in re.findall(r"<<([^<>=]*)=([^<>=]*)>>", work):
        v, w = plain_fraction(e), plain_fraction(s)
        places = len(s.strip().partition(".")[2])
        ok = "unparsable" if w is None else "expr_parenthesis" if v is None else "ok" if v == w else "rounded" if abs(v - w) * 2 * 10**places <= 1 else "wrong"
        steps.append((e, v, w, ok))
    gold = plain_fraction(answer)
    if any(s[3] != "ok" for s in steps) or steps[-1][1] != gold:
        return steps, None
    numbers = lambda t: [Fraction(x) for x in re.findall(r"\d+(?:\.\d*)?|\.\d+", t)]
    given_, nodes = set(numbers(question)), {}
    for j, (e, v, _, _) in enumerate(steps, 1):
        parents, reads = set(), set()
        for x in set(numbers(e)):
            same = [k for k in range(1, j) if steps[k - 1][1] == x]
            reads |= set(same)
            if len(same) == 1 and x not in given_:
                parents |= set(same)
        stops = {k for k, n in nodes.items() if n[2] in ("gold", "blocked_value", "blocked_below", "blocked_reads")}
        state = "gold" if j == len(steps) else "blocked_value" if v == gold else "blocked_below" if parents & stops else "blocked_reads" if reads & stops else "not_positive" if v <= 0 else "not_two_places" if 100 % v.denominator else "node"
        nodes[j] = (1 + max((nodes[k][0] for k in parents), default=0), sorted(parents), state)
    return steps, nodes


PLANTED = [
    ("p1", "Two of 3 and 5.", "a <<3*5=15>> b <<15+1=16>> c <<16*2=32>> d <<32/3=32/3>>\n#### 32/3"),
    ("p2", "Nothing given.", "<<2*3=6>> <<6+0=6>> <<6*4=24>> <<24-18=6>>\n#### 6"),
    ("p3", "There are 15 and 7.", "<<3*5=15>> <<7+8=15>> <<15*2=30>> <<9-10=-1>> <<30+1=31>>\n#### 31"),
    ("p4", "Wrong.", "<<1+1=3>> <<3+1=4>>\n#### 4"),
    ("p5", "Rounded.", "<<10/3=3.33>> <<3.33*3=9.99>>\n#### 9.99"),
    ("p6", "Malformed.", "<<(1+2=3>> <<3+1=4>>\n#### 4"),
    ("p7", "Not the answer.", "<<1+1=2>>\n#### 3"),
    ("p8", "Built on gold.", "<<2*4=8>> <<8+1=9>> <<9+2=11>> <<11-3=8>>\n#### 8"),
    ("p9", "A number 9 that is read.", "<<4+5=9>> <<3*3=9>> <<9*9=81>> <<81-72=9>>\n#### 9"),
]


def compare(spark, rows):
    df = spark.createDataFrame(rows, "id string, question string, solution string")
    steps = solutions.steps_of(df)
    got = {(r["id"], r["step"]): (r["expr"], r["value"], r["stated"], r["verdict"]) for r in steps.collect()}
    states = {(r["id"], r["step"]): (r["level"], r["parents"], r["state"]) for r in solutions.node_states(steps).collect()}
    want, want_states = {}, {}
    for i, q, s in rows:
        plain, nodes = plain_solution(q, s)
        want |= {(i, k): (e, shown(v), shown(w), ok) for k, (e, v, w, ok) in enumerate(plain, 1)}
        want_states |= {(i, k): n for k, n in (nodes or {}).items()}
    assert got == want and states == want_states
    return want, want_states


def test_planted_solutions(spark):
    want, states = compare(spark, PLANTED)
    assert {s for *_, s in states.values()} >= {"gold", "blocked_value", "blocked_below", "node", "not_positive"}
    assert {v for *_, v in want.values()} == {"ok", "wrong", "rounded", "expr_parenthesis"}
    assert states["p3", 3][1] == [] and states["p8", 2][2] == "blocked_below"


def test_orders_equal_plain_loop(spark, small):
    rows = [tuple(str(v) for v in r) for r in solutions.order_solutions(spark, small).collect()]
    want, states = compare(spark, rows)
    counts = Counter(f"node_{s}" for *_, s in states.values()) + Counter(f"step_{v}" for *_, v in want.values())
    got = {r["what"]: r["n"] for r in solutions.solution_drops(spark, small).collect()}
    assert {k: n for k, n in got.items() if not k.startswith("solution")} == dict(counts)
    assert sum(n for k, n in got.items() if k.startswith("solution")) == len(rows)


def test_solutions_without_notes(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "q", "no notes #### 4"), ("c", "q", "<<=>> #### ")], "id string, question string, solution string")
    steps = solutions.steps_of(df)
    assert [(r["id"], r["verdict"]) for r in steps.collect()] == [("c", "unparsable")] and solutions.node_states(steps).count() == 0


@pytest.mark.parametrize("text", ["1,234.50 and .5, 7", "none"])
def test_numbers(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(exact.numbers(F.col("t")).alias("n")).first()["n"]
    assert got == [str(Fraction(x)) for x in re.findall(r"\d+(?:\.\d*)?|\.\d+", text.replace(",2", "2"))]


MIXED = [*PROBLEMS, None, "50%*80", "1,000*$2", "1.25x4", "6÷4", "--5", "-+-2", "2--3", "-2*-3", "3*-2+1", ".5+1.", "0/5", "-(-4)/-6", "17*84197.04", "1" * 30 + "/7", "9" * 37 + "+1", "0" * 50 + "1", "1." + "0" * 40, "(1+2)3/0", "1/0+"]


def test_batches_equal_columns(spark):
    n, d, bad = exact.evaluate(MIXED)
    got = [(None, None, exact.PROBLEMS[b]) if b else (x, y, None) for x, y, b in zip(n, d, bad, strict=True)]
    assert got == [tuple(None if v is None else int(v) if not isinstance(v, str) else v for v in r) for r in run(spark, MIXED)]
    texts = [t for t in MIXED if t]
    want = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", exact.numbers(F.col("t")).alias("n")).orderBy("i").collect()
    assert [exact.numbers_in(t) for t in texts] == [r["n"] for r in want]


@settings(max_examples=40, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=40))
def test_batches_equal_fractions(trees):
    both = [value(t) for t in trees]
    for (text, v), n, d, b in zip(both, *exact.evaluate([t for t, _ in both]), strict=True):
        assert (exact.PROBLEMS[b] == "zero") if v is None else b == 0 and (n, d) == (v.numerator, v.denominator), text


def test_batches_keep_large_values_exact():
    # The fraction in lowest terms is -495351309480261594566382483112837 / 401234564290123200, 33 digits: large, not a wrong fraction.
    text = "0*-12%-1/1234567890123456-1234567890123456-12%+12%/3.25"
    assert exact.PROBLEMS[exact.evaluate([text])[2][0]] == "large"
