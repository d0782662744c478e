"""Spelling variants: words that differ by one edit, found by Aho-Corasick automata over word halves.

A word is cut in two halves. One inserted, deleted or replaced code point
touches one half at most, so a near word still starts with the first half or
ends in the second. Automata hold the halves of all words, each with a mark for
the word's start or end, which fixes the offset at which it may match. Every word
is scanned by the automata that hold a half it could match (two lengths of
start, two of end), so the halves' hash deals both sides into shards and nothing
is scanned by all of them. A match gives the words with that half; of these only
those of a compatible length whose other half is one edit away are looked up,
through the other half's single deletions, and checked. So no list of all words
with a common half is ever made, and a pair is reported once: by its start
half if that matches, else by its end half.

Halves that ``SPLIT`` words or more could match are dealt into a grid: parts of
the words that hold it times parts of the words that look for it. Each
shard is of bounded size and returns, a word, the number of near words and the
best of them.

The form of a word is its near word of the largest count, if that is
``FACTOR`` times its own or more; counts at least double along forms, so they
end in roots, found by doubling the steps of a join.

Edge cases: null texts have no words; a null id counts as the empty text in the
check sum; repeated rows count as often as they occur; ties go to the smaller word in code-point order; a word without
near words has no form and is its own root; words are compared by code point,
without folding accents; texts and words of any length are taken whole; an empty table gives an empty result.
Other columns are only read.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, measured, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One in so many runs loses a code point.
DAMAGE = 97
#: Words whose halves one shard holds, about; and how many words may look for one half before it is split.
SHARD_WORDS, SPLIT = 20_000, 40_000
#: The cell of a half that isn't split.
WHOLE = -1
#: Marks of a word's start and end, which no word has.
START, END = "\x02", "\x03"


def corpus_words(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n): lower-cased letter runs of whole texts, of which some lose a code point, with their counts."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hit = each.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    less = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    return hit.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _start(word: Column, length: Column) -> Column:
    return F.concat(F.lit(START), F.substring(word, F.lit(1), length.cast("int")))


def _end(word: Column, length: Column) -> Column:
    return F.concat(F.substring(word, F.length(word) - length.cast("int") + 1, length.cast("int")), F.lit(END))


def halves(word: Column) -> Column:
    """The two marked halves of a word."""
    n = F.length(word)
    return F.array(_start(word, F.floor(n / 2)), _end(word, n - F.floor(n / 2)))


def sought(word: Column) -> Column:
    """The marked halves that near words of this one could have: of one code point less, as many, and one more."""
    n = F.length(word)
    first, second = [F.floor((n + d) / 2) for d in (-1, 0, 1)], [n + d - F.floor((n + d) / 2) for d in (-1, 0, 1)]
    return F.array_distinct(F.array(*[_start(word, k) for k in first], *[_end(word, F.least(k, n)) for k in second]))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _keys(rest: str):
    """What near rests have in common: the rest itself, and each single deletion, with its place."""
    yield -1, rest
    for i in range(len(rest)):
        yield i, rest[:i] + rest[i + 1 :]


class HalfAutomaton:
    """An automaton over marked halves, and the words behind each by their other half."""

    def __init__(self, words: list[str], counts: list[int], marked: list[str], cells: list[int]):
        self.words, self.counts = words, counts
        self.behind: dict[tuple[str, int], dict] = defaultdict(lambda: defaultdict(list))
        self.automaton = ahocorasick.Automaton()
        for k, (word, half, cell) in enumerate(zip(words, marked, cells, strict=True)):
            self.automaton.add_word(half, half)
            for key in _keys(self.rest(word, half)):
                self.behind[half, cell][key].append(k)
        if words:
            self.automaton.make_automaton()

    @staticmethod
    def rest(word: str, half: str) -> str:
        return word[len(half) - 1 :] if half[0] == START else word[: len(word) - len(half) + 1]

    def near(self, word: str, cells: dict[str, list[int]]):
        """Indexes of the words near this one, by a half that is held here; none twice over all shards. ``cells``: those of split halves that this word looks into here."""
        whole = START + word + END
        for end, half in self.automaton.iter(whole):
            at_start = half[0] == START
            if (end != len(half) - 1) if at_start else (end != len(whole) - 1):
                continue
            rest, seen = self.rest(word, half), set()
            for found in (self.behind[half, c] for c in [WHOLE, *cells.get(half, ())] if (half, c) in self.behind):
                for i, key in _keys(rest):
                    # Replaced: the same place left out of both. Deleted or inserted: a rest that is the other less one.
                    seen.update(found.get((i, key), ()))
                    if i >= 0:
                        seen.update(found.get((-1, key), ()))
                for j in range(len(rest) + 1):
                    seen.update(found.get((j, rest), ()))
            for k in seen:
                other = self.words[k]
                if abs(len(other) - len(word)) <= 1 and one_edit(other, word) and (at_start or not word.startswith(other[: len(other) // 2])):
                    yield k


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, split: int = SPLIT) -> DataFrame:
    """(word, n_near, best): the number of near words of each word that has any, and the best as (-count, word), from words(word, n)."""
    held = words.select("word", "n", F.explode(halves(F.col("word"))).alias("half"))
    looks = words.select("word", "n", F.explode(sought(F.col("word"))).alias("half"))
    hot = materialize(looks.groupBy("half").agg(F.count("*").alias("k")).where(F.col("k") >= split).select("half", F.ceil(F.col("k") / split).cast("int").alias("parts")), "hot-halves")
    shards = max(1, -(-words.count() // shard_words))

    def dealt(rows: DataFrame, mine: str, other: str, seed: int) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        placed = rows.join(hot, "half", "left").withColumn(mine, F.pmod(F.xxhash64("word", F.lit(seed)), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1)))
        cell = F.when(parts > 1, F.col("p") * parts + F.col("q")).otherwise(WHOLE)
        return placed.select(F.pmod(F.xxhash64("half", "p", "q"), F.lit(shards)).cast("int").alias("shard"), "word", "n", "half", cell.alias("cell"))

    def scan(index: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held = HalfAutomaton(index["word"].tolist(), index["n"].tolist(), index["half"].tolist(), index["cell"].tolist())
        looking: dict[str, dict[str, list[int]]] = defaultdict(dict)
        for word, half, cell in zip(rows["word"], rows["split"], rows["cell"], strict=True):
            if cell == WHOLE:
                looking[word]
            else:
                looking[word].setdefault(half, []).append(cell)
        out = []
        for word, cells in looking.items() if len(index) else ():
            found = list(held.near(word, cells))
            if found:
                out.append((word, len(found), *min((-held.counts[k], held.words[k]) for k in found)))
        return pd.DataFrame(out, columns=["word", "n_near", "less", "best"])

    a = dealt(held, "p", "q", 1)
    # A word scans a shard once for all halves that aren't split. Attributes of their own, for cogroup.
    b = dealt(looks, "q", "p", 2).select("shard", "word", F.when(F.col("cell") != WHOLE, F.col("half")).alias("split"), "cell").distinct()
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    parts = a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(scan, "word string, n_near long, less long, best string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): each word's last form, by steps that double."""
    out = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out, seen = measured(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", moved=F.count_if("moved"))
        if not seen["moved"]:
            return out.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = FACTOR, **sizes: int) -> DataFrame:
    """word, n, n_near, form, form_n, root of words(word, n), whose words are distinct. ``sizes``: those of ``near_words``."""
    near = near_words(words, **sizes)
    found = words.join(near, "word", "left").withColumn("ok", -F.col("best.less") >= factor * F.col("n"))
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best.best")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n")), "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def frequent_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the words that are grouped, written once."""
    return materialize(corpus_words(docs, damage).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")


def op12_aho_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(frequent_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
