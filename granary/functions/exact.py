"""Calculator expressions in text, parsed and run exactly as column expressions.

An expression is a string of decimal numbers, ``+ - * /`` (also ``x × ÷``),
signs, parentheses and percent signs after numbers; commas, dollar signs
and spaces don't count. Its tokens are folded once through an
operator-precedence automaton that keeps a stack of fractions and a stack of
operators; no Python runs. Fractions are pairs of whole decimals; they are
reduced when they grow past ``WIDE``, and at the end.

``evaluate`` does the same in Arrow batches, for queries that run many
expressions a row: lambdas are interpreted, some 50 microseconds an expression.
There the automaton runs once for all texts of a batch that are alike but for
their numbers, on arrays of numerators and denominators.

What is wrong is said, not thrown: ``empty``, ``symbol`` (a character that
belongs to no expression), ``operand`` (a value is missing), ``operator`` (one is
missing between values), ``parenthesis``, ``percent`` (not after a number),
``zero`` (division by it), ``large`` (beyond 38 digits, 32 in lowest terms).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.arrays import let

WHOLE = "decimal(38,0)"
NUMBER = r"\d+(?:\.\d*)?|\.\d+"
#: Past this the pair is reduced after an operation.
WIDE = 10**15
#: Steps of Euclid's algorithm that 38 digits, and longs, need at most.
STEPS, LONG_STEPS = 186, 90
FRACTION = f"struct<n:{WHOLE},d:{WHOLE}>"
STATE = f"struct<vals:array<{FRACTION}>,ops:array<string>,prev:string,bad:string>"
#: The token after the last one.
END = "end"
#: How tightly operators bind; "u" is the sign of a value.
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "u": 3}


def _whole(value) -> Column:
    return F.lit(value).cast(WHOLE)


def _named(**parts: Column) -> Column:
    return F.named_struct(*[x for name, part in parts.items() for x in (F.lit(name), part)])


def _fraction(n: Column, d: Column) -> Column:
    return _named(n=n.cast(WHOLE), d=d.cast(WHOLE))


def _gcd(a: Column, b: Column) -> Column:
    """Of whole decimals, by Euclid's steps in longs where they hold both."""

    def euclid(kind: str, steps: int) -> Column:
        pair = _named(a=F.abs(a).cast(kind), b=F.abs(b).cast(kind))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(_named(a=s["b"], b=F.try_mod(s["a"], s["b"]).cast(kind)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, step, lambda s: s["a"].cast(WHOLE))

    return F.when(F.greatest(F.abs(a), F.abs(b)) < _whole(2**62), euclid("long", LONG_STEPS)).otherwise(euclid(WHOLE, STEPS))


def reduced(f: Column) -> Column:
    """A fraction in lowest terms with a positive denominator; null parts if they don't fit."""

    def by(g: Column) -> Column:
        signed = F.when(f["d"] < 0, -g).otherwise(g).cast(WHOLE)
        return _fraction(F.try_divide(f["n"], signed), F.try_divide(f["d"], signed))

    return F.when(f["d"] == 0, f).otherwise(let(_gcd(f["n"], f["d"]), lambda g: F.when((g == 1) & (f["d"] > 0), f).otherwise(by(g))))


def _narrow(f: Column) -> Column:
    return F.when(F.greatest(F.abs(f["n"]), F.abs(f["d"])) > _whole(WIDE), reduced(f)).otherwise(f)


def _operation(op: Column, a: Column, b: Column) -> Column:
    """``a op b`` of fractions; null parts where 38 digits don't hold it."""
    times = lambda x, y: F.try_multiply(x, y).cast(WHOLE)
    across = lambda join: _fraction(join(times(a["n"], b["d"]), times(b["n"], a["d"])), times(a["d"], b["d"]))
    out = F.when(op == "+", across(F.try_add)).when(op == "-", across(F.try_subtract))
    return let(out.when(op == "*", _fraction(times(a["n"], b["n"]), times(a["d"], b["d"]))).otherwise(_fraction(times(a["n"], b["d"]), times(a["d"], b["n"]))), _narrow)


def _state(vals: Column, ops: Column, prev: Column, bad: Column) -> Column:
    return _named(vals=vals.cast(f"array<{FRACTION}>"), ops=ops.cast("array<string>"), prev=prev.cast("string"), bad=bad.cast("string")).cast(STATE)


def _without_last(a: Column, k: int = 1) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))


def _last(a: Column, k: int = 1) -> Column:
    return F.get(a, F.size(a) - k)


def _bad(s: Column, why: str) -> Column:
    return _state(s["vals"], s["ops"], s["prev"], F.lit(why))


def _apply_top(s: Column, least: Column) -> Column:
    """The state with its last operator applied, if that binds as tightly as ``least`` at least."""
    op = _last(s["ops"])
    binds = F.coalesce(reduce(lambda w, kv: w.when(op == kv[0], kv[1]), list(BINDS.items())[1:], F.when(op == "+", 1)), F.lit(0)) >= least
    b, a = _last(s["vals"]), _last(s["vals"], 2)
    pushed = lambda keep, f: _state(F.concat(keep, F.array(f)), _without_last(s["ops"]), s["prev"], F.when(f["d"] == 0, F.lit("zero")).when(f["n"].isNull() | f["d"].isNull(), F.lit("large")))
    sign = pushed(_without_last(s["vals"]), _fraction(-b["n"], b["d"]))
    both = let(_operation(op, a, b), lambda f: pushed(_without_last(s["vals"], 2), f))
    return F.when(~binds | s["bad"].isNotNull(), s).when(op == "u", sign).otherwise(both)


def _settled(s: Column, least: Column) -> Column:
    """All operators that bind as tightly as ``least`` applied: a sign, one of ``* /`` and one of ``+ -`` at most are waiting."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), s, lambda x, _: _apply_top(x, least))


def _number(token: Column) -> Column:
    """A decimal number's digits over a power of ten."""
    places = F.length(F.element_at(F.split(F.concat(token, F.lit(".")), r"\."), 2))
    digits = F.concat(F.lit("0"), F.replace(token, F.lit(".")))
    return _fraction(digits.try_cast(WHOLE), F.concat(F.lit("1"), F.repeat(F.lit("0"), places)).try_cast(WHOLE))


def _step(s: Column, t: Column) -> Column:
    """One token; what waits and binds as tightly as the token is settled before it."""
    value = s["prev"].isin("number", "value")
    least = F.when(value & t.isin("+", "-", ")", END), 1).when(value & t.isin("*", "/"), 2).otherwise(9)
    return let(F.when(least < 9, _settled(s, least)).otherwise(s), lambda x: _placed(x, t, x["prev"].isin("number", "value")))


def _placed(s: Column, t: Column, value: Column) -> Column:
    after = lambda op: _state(s["vals"], F.concat(s["ops"], F.array(op)), F.lit("start"), s["bad"])
    number = let(_number(t), lambda f: _state(F.concat(s["vals"], F.array(f)), s["ops"], F.lit("number"), F.when(f["n"].isNull() | f["d"].isNull(), F.lit("large"))))
    by_hundred = lambda f: _state(F.concat(_without_last(s["vals"]), F.array(f)), s["ops"], F.lit("value"), F.when(f["d"].isNull(), F.lit("large")))
    hundredth = let(let(_last(s["vals"]), lambda f: _fraction(f["n"], F.try_multiply(f["d"], _whole(100)))), by_hundred)
    popped = lambda prev: _state(s["vals"], _without_last(s["ops"]), prev, s["bad"])
    signed = F.when(t == "+", s).when(_last(s["ops"]) == "u", popped(s["prev"])).otherwise(after(F.lit("u")))
    return (
        F.when(s["bad"].isNotNull(), s)
        .when(t.rlike(r"^[\d.]"), F.when(value, _bad(s, "operator")).when(t.rlike(f"^(?:{NUMBER})$"), number).otherwise(_bad(s, "symbol")))
        .when(t == "(", F.when(value, _bad(s, "operator")).otherwise(after(t)))
        .when(t == "%", F.when(s["prev"] == "number", hundredth).otherwise(_bad(s, "percent")))
        .when(t.isin("+", "-") & ~value, signed)
        .when(~t.isin("+", "-", "*", "/", ")", END), _bad(s, "symbol"))
        .when(~value, _bad(s, "operand"))
        .when(t == ")", F.when(_last(s["ops"]) == "(", popped(F.lit("value"))).otherwise(_bad(s, "parenthesis")))
        .when(t == END, F.when(F.size(s["ops"]) > 0, _bad(s, "parenthesis")).otherwise(s))
        .otherwise(after(t))
    )


def tokens(text: Column) -> Column:
    """Numbers and single characters, the signs of multiplication and division made one."""
    plain = F.translate(F.regexp_replace(text, r"[\s,$]", ""), "xX×÷", "***/")
    return F.regexp_extract_all(plain, F.lit(rf"((?:{NUMBER})|.)"), F.lit(1))


def expression(text: Column) -> Column:
    """(num, den, problem) of an expression: whole decimals in lowest terms, or null and what is wrong."""
    start = _state(F.array(), F.array(), F.lit("start"), F.lit(None))
    no = lambda why: _named(num=F.lit(None).cast(WHOLE), den=F.lit(None).cast(WHOLE), problem=why)
    fits = lambda f: F.when(f["n"].isNull() | f["d"].isNull(), no(F.lit("large"))).otherwise(_named(num=f["n"], den=f["d"], problem=F.lit(None).cast("string")))
    out = lambda s: F.when(s["bad"].isNotNull(), no(s["bad"])).otherwise(let(reduced(F.get(s["vals"], F.lit(0))), fits))
    run = lambda t: F.when(F.size(t) == 0, no(F.lit("empty"))).otherwise(let(F.aggregate(F.concat(t, F.array(F.lit(END))), start, _step), out))
    return let(tokens(F.coalesce(text, F.lit(""))), run)


def fraction_text(num: Column, den: Column) -> Column:
    """As "n" or "n/d"."""
    return F.when(den == 1, num.cast("string")).otherwise(F.concat(num.cast("string"), F.lit("/"), den.cast("string")))


def numbers(text: Column) -> Column:
    """All numbers in a text, as fraction texts, in order; beyond 32 digits null."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d)", ""), F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda t: let(reduced(_number(t)), lambda f: fraction_text(f["n"], f["d"])))


#: What of a text belongs to no token, the signs that are made one, and the characters that Java's dot leaves out.
_PLAIN = str.maketrans(dict.fromkeys(map(ord, " \t\n\x0b\f\r,$\x85\u2028\u2029")) | {ord("x"): "*", ord("X"): "*", ord("×"): "*", ord("÷"): "/"})
_USUAL = re.compile(r"[0-9.+*/()%-]*")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+")
_TOKEN = re.compile(r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+|.", re.DOTALL)
PROBLEMS = (None, "empty", "symbol", "operand", "operator", "parenthesis", "percent", "zero", "large")
_CODE = {p: k for k, p in enumerate(PROBLEMS)}
#: Digits of a whole decimal, and of a part of a reduced fraction.
_MOST, _MOST_REDUCED = 10**38, 10**32


def shape_of(text: str | None) -> tuple[str, list[str]]:
    """An expression's tokens, one character each with "0" for any number, and its numbers."""
    text = text or ""
    if not _USUAL.fullmatch(text):
        text = text.translate(_PLAIN)
    return _NUMBER.sub("0", text), _NUMBER.findall(text)


def tokens_of(text: str | None) -> list[str]:
    """``tokens`` of one text."""
    return _TOKEN.findall((text or "").translate(_PLAIN))


def digits_of(token: str) -> tuple[int | None, int]:
    """A decimal number's digits and its decimal places; no digits where 38 don't hold them."""
    if len(token) < 39:
        return (int(token), 0) if token.isdigit() else (int(token.replace(".", "")), len(token) - token.index(".") - 1)
    head, _, tail = token.partition(".")
    return int(head + tail) if len((head + tail).lstrip("0")) < 39 and len(head + tail) < 4000 else None, len(tail)


def by_shape(texts: Sequence[str | None]) -> dict[str, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By shape: the places of its texts among all, and (digits, decimal places) of each of its numbers."""
    found: dict[str, tuple[list[int], list[list[str]]]] = {}
    for i, text in enumerate(texts):
        shape, numbers = shape_of(text)
        at, each = found.setdefault(shape, ([], []))
        at.append(i)
        each.append(numbers)
    return {shape: (np.array(at), [_digits(column) for column in zip(*each, strict=True)]) for shape, (at, each) in found.items()}


def _digits(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [digits_of(t) for t in tokens]
    return _array([-1 if n is None else n for n, _ in pairs]), np.array([p for _, p in pairs], dtype=np.int64)


def _array(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.int64 if max(values) < 2**62 else object)


def _largest(x: np.ndarray) -> int:
    return int(max(x.max(), -x.min()))


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product, in Python's integers where longs don't hold it."""
    if x.dtype != object and y.dtype != object and _largest(x) * _largest(y) < 2**61:
        return x * y
    return x.astype(object) * y.astype(object)


def _ten_to(places: np.ndarray) -> np.ndarray:
    return np.array([10**k for k in range(19)], dtype=np.int64)[places] if places.max() < 18 else np.array([10 ** int(k) for k in places], dtype=object)


def _beyond(x: np.ndarray, most: int = _MOST) -> np.ndarray:
    return np.zeros(len(x), bool) if x.dtype != object else (np.abs(x) >= most).astype(bool)


def _reduced(n: np.ndarray, d: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, d, which don't fit): lowest terms with a positive denominator, of the rows that ``where`` says and that have a denominator."""
    at = np.flatnonzero(where & (d != 0).astype(bool))
    over = np.zeros(len(n), bool)
    if len(at):
        g = np.gcd(n[at], d[at])
        change = ((g != 1) | (d[at] < 0)).astype(bool)
        g = np.where(d[at] < 0, -g, g)
        n, d = n.copy(), d.copy()
        n[at], d[at] = n[at] // g, d[at] // g
        over[at] = change & (_beyond(n[at], _MOST_REDUCED) | _beyond(d[at], _MOST_REDUCED))
    return n, d, over


class _Run:
    """``expression``'s automaton over all texts of one shape: what it does depends on the shape alone, so each stack entry holds the fractions of all of them."""

    def __init__(self, rows: int, bad: np.ndarray):
        self.rows, self.bad = rows, bad
        self.values: list[tuple[np.ndarray, np.ndarray]] = []
        self.ops: list[str] = []
        self.prev = "start"

    def say(self, what: str, where: np.ndarray | bool = True) -> None:
        self.bad[where & (self.bad == 0)] = _CODE[what]

    def push(self, n: np.ndarray, d: np.ndarray) -> None:
        """What has a problem goes on as 1, as its value is asked for no more."""
        off = (self.bad != 0) | (d == 0).astype(bool)
        if off.any():
            n, d = n.copy(), d.copy()
            n[off], d[off] = 1, 1
        self.values.append((n, d))

    def apply_top(self) -> None:
        op, (bn, bd) = self.ops.pop(), self.values.pop()
        if op == "u":
            self.push(-bn, bd)
            return
        an, ad = self.values.pop()
        if op in "+-":
            x, y, d = _times(an, bd), _times(bn, ad), _times(ad, bd)
            over = _beyond(x) | _beyond(y)
            n = x + y if op == "+" else x - y
        else:
            n, d = (_times(an, bn), _times(ad, bd)) if op == "*" else (_times(an, bd), _times(ad, bn))
            over = np.zeros(self.rows, bool)
        self.say("zero", (d == 0).astype(bool))
        over |= _beyond(n) | _beyond(d)
        wide = ((np.abs(n) > WIDE) | (np.abs(d) > WIDE)).astype(bool) & ~over
        if wide.any():
            n, d, late = _reduced(n, d, wide)
            over |= late
        self.say("large", over)
        self.push(n, d)

    def settle(self, least: int) -> None:
        while self.ops and BINDS.get(self.ops[-1], 0) >= least:
            self.apply_top()

    def token(self, t: str, number: tuple[np.ndarray, np.ndarray] | None) -> str | None:
        """One token; what is wrong with it."""
        value = self.prev in ("number", "value")
        if value and t in ("+", "-", ")", END):
            self.settle(1)
        elif value and t in ("*", "/"):
            self.settle(2)
        if t == "0":
            if value:
                return "operator"
            digits, places = number
            self.say("large", (digits < 0).astype(bool) | (places > 37))
            self.push(digits, _ten_to(np.minimum(places, 37)))
            self.prev = "number"
        elif t == ".":
            return "operator" if value else "symbol"
        elif t == "(":
            if value:
                return "operator"
            self.ops.append(t)
            self.prev = "start"
        elif t == "%":
            if self.prev != "number":
                return "percent"
            n, d = self.values.pop()
            d = _times(d, np.full(self.rows, 100))
            self.say("large", _beyond(d))
            self.push(n, d)
            self.prev = "value"
        elif t in ("+", "-") and not value:
            if t == "-" and self.ops and self.ops[-1] == "u":
                self.ops.pop()
            elif t == "-":
                self.ops.append("u")
                self.prev = "start"
        elif t not in ("+", "-", "*", "/", ")", END):
            return "symbol"
        elif not value:
            return "operand"
        elif t == ")":
            if not self.ops or self.ops[-1] != "(":
                return "parenthesis"
            self.ops.pop()
            self.prev = "value"
        elif t == END:
            return "parenthesis" if self.ops else None
        else:
            self.ops.append(t)
            self.prev = "start"
        return None


def evaluated(shape: str, numbers: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(num, den, problem as a place in ``PROBLEMS``) of the texts of one shape: the same as ``expression``, in whole columns."""
    bad = np.zeros(rows, np.int8)
    if not shape:
        bad[:] = _CODE["empty"]
        return np.zeros(rows, np.int64), np.ones(rows, np.int64), bad
    run, left = _Run(rows, bad), iter(numbers)
    for t in (*shape, END):
        wrong = run.token(t, next(left) if t == "0" else None)
        if wrong:
            run.say(wrong)
        if bad.all():
            return np.zeros(rows, np.int64), np.ones(rows, np.int64), bad
    n, d, over = _reduced(*run.values[0], np.ones(rows, bool))
    run.say("large", over)
    return n, d, bad


def evaluate(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(num, den, problem as a place in ``PROBLEMS``) of many texts, to be used in Arrow batches."""
    n, d, bad = np.zeros(len(texts), object), np.ones(len(texts), object), np.zeros(len(texts), np.int8)
    for shape, (at, numbers) in by_shape(texts).items():
        n[at], d[at], bad[at] = evaluated(shape, numbers, len(at))
    return n, d, bad


def fraction_texts(n: np.ndarray, d: np.ndarray, bad: np.ndarray) -> list[str | None]:
    return [None if b else f"{x}" if y == 1 else f"{x}/{y}" for x, y, b in zip(n.tolist(), d.tolist(), bad.tolist(), strict=True)]


_COMMA = re.compile(r"(?<=[0-9]),(?=[0-9])")


def number_text(token: str) -> str | None:
    """A decimal number as a fraction text, as in ``numbers``."""
    n, places = digits_of(token)
    if n is None or places > 37:
        return None
    if not places:
        return str(n)
    g = math.gcd(n, d := 10**places)
    if g > 1:
        n, d = n // g, d // g
        if n >= _MOST_REDUCED or d >= _MOST_REDUCED:
            return None
    return str(n) if d == 1 else f"{n}/{d}"


def numbers_in(text: str) -> list[str | None]:
    """``numbers`` of one text."""
    return [number_text(t) for t in _NUMBER.findall(_COMMA.sub("", text) if "," in text else text)]
