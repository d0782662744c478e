"""Text functions: tokens, shingles, masks, cuts, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.arrays import let

#: Words left out when content words are compared.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def masked_tokens(text: Column) -> Column:
    """Tokens, with '#' for each that holds a digit."""
    return F.transform(tokens(text), lambda t: F.when(t.rlike("[0-9]"), F.lit("#")).otherwise(t))


def shingles(toks: Column, n: int, distinct: bool = True) -> Column:
    """Runs of ``n`` tokens joined by blanks; none for shorter arrays."""

    def runs(t: Column) -> Column:
        return F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))

    out = let(toks, runs)
    return F.array_distinct(out) if distinct else out


def shingle_hashes(toks: Column, n: int) -> Column:
    """Distinct 64-bit hashes of runs of ``n`` tokens: of the tokens' hashes, so that no run is written out."""

    def runs(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(h, i + 1, F.lit(n))))

    return F.array_distinct(let(F.transform(toks, lambda t: F.xxhash64(t)), runs))


def masked_shingles(text: Column, n: int) -> Column:
    """Distinct masked shingles of which half the tokens at most are '#'."""
    return F.filter(shingles(masked_tokens(text), n), lambda g: (F.length(g) - F.length(F.replace(g, F.lit("#"), F.lit("")))) * 2 <= n)


def normalised(text: Column) -> Column:
    """Tokens joined by one blank: the key of exact dedup."""
    return F.array_join(tokens(text), " ")


def squeezed(text: Column) -> Column:
    """Lower case, white space folded to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def head_tail(text: Column, cap: int) -> Column:
    """Texts over ``cap`` characters: the first two thirds, a mark, the last third."""
    head = cap * 2 // 3
    tail = cap - head
    cut = F.concat(F.substring(text, 1, head), F.lit(" [...] "), F.substring(text, -tail, tail))
    return F.when(F.length(text) > cap, cut).otherwise(text)


def before_last(text: Column, mark: str) -> Column:
    """What stands before the last ``mark``; all of it without one."""
    pieces = F.split(text, F.lit(_quote(mark)))
    return F.when(F.contains(text, F.lit(mark)), F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), mark)).otherwise(text)


def _quote(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in mark)


def sanitised(text: Column) -> Column:
    """Carriage returns go, option headers are defused, blanks at line ends go."""
    out = F.regexp_replace(text, "\r", "")
    out = F.regexp_replace(out, "Options:", "Options -")
    return F.regexp_replace(out, "[ \t]+(?=\n|$)", "")


def stem(word: Column) -> Column:
    """A light stem: common English endings off words of some length."""
    return F.when(F.length(word) > 5, F.regexp_replace(word, "(ing|edly|ed|es|ly|s)$", "")).when(F.length(word) > 3, F.regexp_replace(word, "s$", "")).otherwise(word)


def content_words(text: Column) -> Column:
    """Distinct stems of the tokens that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda t: ~F.array_contains(stop, t)), stem))


def numbers(text: Column) -> Column:
    """Digit groups with optional sign, thousands commas and decimals, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whole-word, case-sensitive containment of a phrase."""
    return text.rlike(r"(?<![A-Za-z0-9])" + _quote(phrase) + r"(?![A-Za-z0-9])")


def option_block(labels: Column, options: Column) -> Column:
    """'A) text' lines."""
    return F.array_join(F.transform(F.arrays_zip(labels.alias("l"), options.alias("o")), lambda s: F.concat(s["l"], F.lit(") "), s["o"])), "\n")


def answer_letter(text: Column) -> Column:
    """The last explicit 'answer: X' after any closed thinking region, else a last line that is one letter."""
    region = F.substring_index(text, "</think>", -1)
    explicit = F.regexp_extract_all(region, F.lit(r"(?i)answer\s*[:=]\s*\(?([A-Z])\b"), F.lit(1))
    last_line = F.regexp_extract(region, r"\(?([A-Z])\)?\.?\s*$", 1)
    found = F.when(F.size(explicit) > 0, F.element_at(explicit, -1)).otherwise(last_line)
    return F.when(found != "", F.upper(found))
