"""Probabilities over options: arrays of doubles, and 0-based gold indexes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.arrays import let, total

FLOOR = 1e-12


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax with the largest logit subtracted."""

    def scaled(x: Column) -> Column:
        top = F.array_max(x)
        return let(F.transform(x, lambda v: F.exp((v - top) / temperature)), lambda e: F.transform(e, lambda v: v / total(e)))

    return let(logits, scaled)


def tempered(probs: Column, temperature: float) -> Column:
    """p^(1/T), renormalised."""
    return let(F.transform(probs, lambda p: F.pow(p, 1 / temperature)), lambda e: F.transform(e, lambda v: v / total(e)))


def gold_probability(probs: Column, gold: Column) -> Column:
    return F.get(probs, gold.cast("int"))


def nll(probs: Column, gold: Column) -> Column:
    return -F.log(F.greatest(gold_probability(probs, gold), F.lit(FLOOR)))


def brier(probs: Column, gold: Column) -> Column:
    return total(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), 2)))


def kl(soft_gold: Column, probs: Column) -> Column:
    """KL(gold || probs); options without gold mass are left out, probabilities are clamped."""
    terms = F.zip_with(soft_gold, probs, lambda g, p: F.when(g > 0, g * F.log(g / F.greatest(p, F.lit(FLOOR)))).otherwise(0.0))
    return total(terms)


def entropy(probs: Column) -> Column:
    return total(F.transform(probs, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)))


def bin_right_closed(conf: Column, bins: int = 15) -> Column:
    """Bin k holds (k/bins, (k+1)/bins]; 0 is in bin 0. Edges are compared as they are, not through a product."""
    edges = F.array(*[F.lit((k + 1) / bins) for k in range(bins)])
    return F.least(F.size(F.filter(edges, lambda e: e < conf)), F.lit(bins - 1))


def bin_left_closed(conf: Column, bins: int = 10) -> Column:
    """Bin k holds [k/bins, (k+1)/bins); 1 is in the last one."""
    return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")


def log_factorial(n: Column) -> Column:
    """ln n! by summation."""
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(0.0), lambda a, i: a + F.when(i > 0, F.log(i.cast("double"))).otherwise(0.0))


def _beside_stirling(k: Column) -> Column:
    """ln k! less Stirling's (k + 1/2) ln k - k + ln(2 pi) / 2, of whole numbers from 1 on."""
    x = k.cast("double")
    few = F.least(k, F.lit(16))
    exact = log_factorial(few) - (few + 0.5) * F.log(few.cast("double")) + few - 0.5 * math.log(2 * math.pi)
    y = 1 / (x * x)
    return F.when(k < 16, exact).otherwise((1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x)


def log_even_binomial(m: Column, n: Column) -> Column:
    """ln of C(n, m) / 2^n, without sums over n and without the difference of large logs."""
    a, b = m.cast("double"), (n - m).cast("double")
    apart = a * F.log(2 * a / n) + b * F.log(2 * b / n)
    inner = _beside_stirling(n) - _beside_stirling(m) - _beside_stirling(n - m) - apart + 0.5 * F.log(n / (2 * math.pi * a * b))
    return F.when((m == 0) | (m == n), -n * math.log(2)).otherwise(inner)
