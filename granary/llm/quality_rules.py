"""Quality rules: fixed base rules, then robust multivariate outliers, in DataFrame functions only.

Every text gives five counts. A text fails the base rules if it is short or
mostly repetition. The others are judged by a vector of transformed statistics
(mean word length, symbol share, share of repeated lines, share of repeated
windows), against a minimum-covariance-determinant estimate of the texts of its
language and source: from medians and median deviations, concentration steps
refit mean and covariance on the ``H`` share of vectors with the smallest
Mahalanobis distances, until no group's determinant falls any more (distances
are compared by bins of 1/64 of their log; the bin that crosses the share counts
whole). A text is rejected if
its squared distance to the estimate exceeds ``CUT``, the far tail of a
chi-square distribution, where distances are scaled down if even the median one
is larger than that distribution's.

Vectors are whole numbers (``UNIT`` to the unit), so sums are exact and the
verdicts don't depend on partitions. Most texts have no symbols or repeats at
all, so covariances get a least variance per statistic (``FLOOR``); else they
would be singular. Each step is one pass over the written vectors that adds up
moments per group and distance bin; the number of bins is a constant, so hot
groups are summed where they lie and nothing is gathered by group.

Every language and source has an estimate of its own rows, every language one of
all its rows, and the whole table one. A group's estimate leans on the one
above it as if ``PRIOR_ROWS`` rows of that were its own: mean and covariance are
weighted by rows against ``PRIOR_ROWS``. So a group of few texts is judged by its
language, a language of few texts by all texts, without a size at which the
rule changes.

Edge cases: null texts have no words and fail; null lang or source is a value
of its own; equal rows are judged alike; an empty table gives an empty result;
a table of a few texts is judged by the estimate of those few; the input's
columns are only read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import SPACE_CLASS, let, materialize, measured, table

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

UNIT = 256
#: Words with this mean length are added to each text's, so that short texts vary less.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5
STATS = ("x_length", "x_symbols", "x_lines", "x_repeats")
#: Least standard deviation of each statistic, in units; each is small enough for its statistic to reject a text alone.
FLOOR = (12.0, 128.0, 64.0, 29.0)
H = 0.75
#: Concentration steps go on while some group's log determinant falls by this much.
FALL = 1e-4
#: So many rows of the group above count for an estimate.
PRIOR_ROWS = 60
#: The group of all texts; languages are "null" or start with "=", and sources follow them after a separator.
EVERY = "all"
#: The upper 1e-6 and the median of the chi-square distribution with four degrees of freedom.
CUT, MEDIAN = 33.377, 3.3567
#: Bins per natural log of (1 + squared distance), and the last bin.
BINS, LAST_BIN = 64, 2560

#: What ``judge`` adds; input columns of these names are not kept.
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")

#: Low bits of a window's sort key that hold its position, any that an array has; the rest are hash.
POSITION_BITS = 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def repeated_words(w: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more. ``w`` must be bound by ``let``.

    Windows are sorted by the high bits of a hash with their position in the low
    bits; those that agree with a neighbour in the high bits may repeat. Only
    these are sorted again, by their three words, where equal ones are neighbours
    for certain.
    """
    low, high = F.lit((1 << POSITION_BITS) - 1).cast("long"), F.lit(~((1 << POSITION_BITS) - 1)).cast("long")
    n = F.size(w)

    def either(s: Column, value, i: Column) -> Column:
        """Whether the neighbour before or after has the same value."""
        here = value(F.get(s, i))
        return F.coalesce(here == value(F.get(s, i - 1)), F.lit(False)) | F.coalesce(here == value(F.get(s, i + 1)), F.lit(False))

    def maybe(s: Column) -> Column:
        at = F.transform(s, lambda x, i: F.when(either(s, lambda y: y.bitwiseAND(high), i), x.bitwiseAND(low).cast("int")))
        return F.transform(F.filter(at, lambda p: p.isNotNull()), lambda p: F.struct(F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c")).alias("words"), p.alias("at")))

    def repeats(t: Column) -> Column:
        return F.sort_array(F.filter(F.transform(t, lambda x, i: F.when(either(t, lambda y: y["words"], i), x["at"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)

    keys = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))
    return let(F.sort_array(keys), lambda s: let(F.sort_array(maybe(s)), lambda t: let(repeats(t), covered)))


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text))


def text_counts(text: Column) -> Column:
    """A struct of the counts of one text."""
    body = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(of_words.alias("w"), of_lines.alias("l"), count_chars(body, SYMBOLS).cast("long").alias("n_symbols"))


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts, with ``base_failed``."""
    counted = docs.select(*keep, text_counts(F.col("text")).alias("_c"))
    out = counted.select(*keep, "_c.w.n_words", "_c.w.word_chars", "_c.n_symbols", "_c.l.n_dup_lines", "_c.w.n_repeat_words", "_c.l.n_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _units(value: Column) -> Column:
    return F.round(value * UNIT).cast("long")


def with_vectors(counts: DataFrame) -> DataFrame:
    """Adds the transformed statistics as whole numbers."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.withColumns(
        {
            "x_length": _units(F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS))),
            "x_symbols": _units(F.log(1 + 1000 * share("n_symbols", "word_chars"))),
            "x_lines": _units(-F.log(1 - share("n_dup_lines", "n_lines"))),
            "x_repeats": _units(-F.log(1 - F.least(share("n_repeat_words", "n_words"), F.lit(MOST_REPEATED_PERCENT / 100)))),
        }
    )


def _quantile(counted: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """(keys, name): the smallest value ``v`` that at least a share ``q`` of a group's rows doesn't exceed, from ``counted(keys, v, n)``."""
    w = Window.partitionBy(*keys)
    ranked = counted.select(*keys, "v", F.sum("n").over(w.orderBy("v")).alias("_to"), F.sum("n").over(w).alias("_all"))
    return ranked.where(F.col("_to") >= F.ceil(q * F.col("_all"))).groupBy(*keys).agg(F.min("v").alias(name))


def _cholesky(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Named entries of the lower triangular root of a covariance matrix; the caller selects them in order, as later ones use earlier ones by name."""
    d = len(STATS)
    out: dict[str, Column] = {}
    for j in range(d):
        for i in range(j, d):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out[f"l{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _names() -> list[str]:
    """What an estimate has beside its group: rows, means, covariances."""
    d = range(len(STATS))
    return ["n", *[f"m{i}" for i in d], *[f"c{i}{j}" for i in d for j in range(i + 1)]]


def _root_columns(estimate: DataFrame) -> DataFrame:
    """Adds the root of the covariance and ``logdet``."""
    d = range(len(STATS))
    out = estimate
    for name, value in _cholesky({(i, j): F.col(f"c{i}{j}") for i in d for j in range(i + 1)}).items():
        out = out.withColumn(name, value)
    return out.withColumn("logdet", 2 * reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in d]))


def _estimate(moments: DataFrame) -> DataFrame:
    """Mean and covariance, with floors, from sums: columns n, s0.., s00.. by grp."""
    d = range(len(STATS))
    mean = [(F.col(f"s{i}") / F.col("n")) for i in d]
    cov = [(F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j] + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in d for j in range(i + 1)]
    return moments.select("grp", "n", *[mean[i].alias(f"m{i}") for i in d], *cov)


def _rooted(estimate: DataFrame) -> DataFrame:
    """Means and the root of the covariance."""
    d = range(len(STATS))
    return _root_columns(estimate).select("grp", *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    out = rows
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(STATS))])).drop(*[f"y{i}" for i in range(len(STATS))])


def _bin(d2: Column) -> Column:
    return F.least(F.round(F.log1p(d2) * BINS), F.lit(LAST_BIN)).cast("int")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations as a first estimate, statistics taken as independent: one pass over the rows counts all values."""
    d = range(len(STATS))
    each = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(name).alias("v")) for i, name in enumerate(STATS)])).alias("s"))
    counted = materialize(each.groupBy("grp", "s.k", "s.v").agg(F.count("*").alias("n")), "values")
    mid = _quantile(counted, ["grp", "k"], 0.5, "mid")
    apart = counted.join(mid, ["grp", "k"]).groupBy("grp", "k", F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n"), F.first("mid").alias("mid"))
    spread = _quantile(apart, ["grp", "k"], 0.5, "dev").join(mid, ["grp", "k"])
    at = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    cov = [(F.pow(1.4826 * at("dev", i), F.lit(2)) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in d for j in range(i + 1)]
    return spread.groupBy("grp").agg(*[at("mid", i).cast("double").alias(f"m{i}") for i in d], *cov)


def _step(rows: DataFrame, estimate: DataFrame, h: float) -> DataFrame:
    """One concentration step: the estimate from the share ``h`` of rows nearest to the last one."""
    d = range(len(STATS))
    binned = _distance(rows.join(_rooted(estimate), "grp")).withColumn("bin", _bin(F.col("d2")))
    sums = [F.count("*").alias("n")] + [F.sum(STATS[i]).alias(f"s{i}") for i in d] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}{j}") for i in d for j in range(i + 1)]
    by_bin = binned.groupBy("grp", "bin").agg(*sums)
    w = Window.partitionBy("grp")
    near = by_bin.withColumns({"_before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "_all": F.sum("n").over(w)}).where(F.col("_before") < F.ceil(h * F.col("_all")))
    names = ["n"] + [f"s{i}" for i in d] + [f"s{i}{j}" for i in d for j in range(i + 1)]
    return _estimate(near.groupBy("grp").agg(*[F.sum(x).alias(x) for x in names]))


def _leaning(own: DataFrame, groups: DataFrame, values: list[str], prior: float) -> DataFrame:
    """The values of each group with ``prior`` rows of its parent's, those of its parent's parent first. ``own`` has grp, n and values; ``groups`` grp and parent."""
    share = F.col("n") / (F.col("n") + F.lit(float(prior)))
    placed = own.join(groups, "grp")
    above = placed.where("parent is null").select(F.col("grp").alias("parent"), *[F.col(v).alias(f"_{v}") for v in values])
    mixed = lambda rows, top: rows.join(top, "parent").select("grp", "parent", *[(share * F.col(v) + (1 - share) * F.col(f"_{v}")).alias(v) for v in values])
    middle = mixed(placed.where(F.col("parent") == EVERY), above)
    low = mixed(placed.where(F.col("parent").isNotNull() & (F.col("parent") != EVERY)), middle.select(F.col("grp").alias("parent"), *[F.col(v).alias(f"_{v}") for v in values]))
    return placed.where("parent is null").select("grp", *values).unionByName(middle.select("grp", *values)).unionByName(low.select("grp", *values))


def _concentrated(rows: DataFrame, h: float, fall: float) -> DataFrame:
    """The estimates after concentration steps, group by group as far as the determinant falls; it can't rise but by the width of a bin, and such a step isn't taken."""
    last = materialize(_start(rows).withColumns({"n": F.lit(0).cast("long"), "logdet": F.lit(None).cast("double")}).select("grp", *_names(), "logdet"), "estimate")
    while True:
        new = _root_columns(_step(rows, last, h)).select("grp", F.struct(*_names(), "logdet").alias("new"))
        both = last.select("grp", F.struct(*_names(), "logdet").alias("old")).join(new, "grp")
        falls = F.col("old.logdet").isNull() | (F.col("new.logdet") < F.col("old.logdet") - fall)
        taken = both.select("grp", falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"))
        last, seen = measured(taken.select("grp", "e.*", "falls"), "estimate", falls=F.count_if("falls"))
        if not seen["falls"]:
            return last.select("grp", *_names())
        last = last.drop("falls")


def mcd_estimates(rows: DataFrame, h: float = H, fall: float = FALL, prior: float = PRIOR_ROWS) -> DataFrame:
    """Robust mean, root of the covariance and distance scale of each ``grp`` of rows(grp, parent, STATS); ``parent`` names the group above, null for the topmost."""
    estimate = _concentrated(rows, h, fall)
    groups = rows.groupBy("grp").agg(F.first("parent").alias("parent"))
    leaned = materialize(_rooted(_leaning(estimate, groups, _names()[1:], prior)), "leaned")
    counted = _distance(rows.join(leaned, "grp")).groupBy("grp", "parent", _bin(F.col("d2")).alias("v")).agg(F.count("*").alias("n"))
    counted = materialize(counted, "bins")
    middle = _quantile(counted, ["grp"], 0.5, "mid").join(counted.groupBy("grp").agg(F.sum("n").alias("n")), "grp").withColumn("mid", F.col("mid").cast("double"))
    scale = F.greatest(F.lit(1.0), (F.exp(F.col("mid") / BINS) - 1) / MEDIAN)
    return leaned.join(_leaning(middle, groups, ["mid"], prior), "grp").withColumn("scale", scale).drop("mid")


def judge(docs: DataFrame, keep: list[str] | None = None, cut: float = CUT, prior: float = PRIOR_ROWS) -> DataFrame:
    """The columns ``keep`` (all but the text if none are named), the counts, ``base_failed``, ``distance`` and ``kept``."""
    keep = keep if keep is not None else [c for c in docs.columns if c != "text"]
    keep = [c for c in keep if c not in OUTPUTS]
    scored = _judged(docs, keep, cut, prior)
    return scored.select(*[F.col("row")[c].alias(c) for c in keep], *OUTPUTS)


def _judged(docs: DataFrame, keep: list[str], cut: float = CUT, prior: float = PRIOR_ROWS) -> DataFrame:
    """(row, OUTPUTS): the columns ``keep`` as one struct, so that no name of theirs meets ours."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    source = docs.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in keep]).alias("row"), "text", value("lang").alias("lng"), F.concat_ws("\x1f", value("lang"), value("source")).alias("pair"))
    vectors = materialize(with_vectors(with_counts(source, ["row", "lng", "pair"])), "vectors")
    named = lambda grp, parent: F.struct(F.col(grp).alias("grp") if grp != EVERY else F.lit(EVERY).alias("grp"), parent.alias("parent"))
    levels = F.array(named("pair", F.col("lng")), named("lng", F.lit(EVERY)), named(EVERY, F.lit(None).cast("string")))
    rows = vectors.where(~F.col("base_failed")).select(F.explode(levels).alias("g"), *STATS).select("g.grp", "g.parent", *STATS)
    estimates = materialize(mcd_estimates(rows, prior=prior), "mcd").withColumnRenamed("grp", "pair")
    scored = _distance(vectors.join(estimates, "pair", "left")).withColumn("distance", F.when(~F.col("base_failed"), F.col("d2") / F.col("scale")))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).select("row", *OUTPUTS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns and nothing else, carried beside their counts: no join back, no shuffle of texts."""
    return _judged(docs, docs.columns).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
