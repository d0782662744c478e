"""Toxicity by a weighted finite-state grammar over clauses.

Two layers of automata read a text.

*Words to symbols.* A letter automaton (a trie) with weights accepts words and
stems, learnt from labels: a stem accepts every longer word that starts with it,
the longest accepting state counts. Accepted words are insults; the closed
classes (threatening verbs, persons, negations, words of reporting) are fixed
lists of four languages, and quotes, commas and stops are symbols too.

*Symbols to matches.* Five small transducers each follow one thing: insults
(pending until a person comes), threats (a verb pending until a person
comes), targets (how long ago a person was named), negation (its scope in
words) and reported speech (from a word of reporting to the end of the sentence,
and between quotes). They are composed once into one table of states; running
it over a text's symbols yields matched clauses: an insult that is plain, aimed
at a person, negated or reported, and threats likewise.

A text's features are the logs of its matched weights by kind, of the number of
matches, of their weight by length, and of its length; a logistic regression
whose weights lean on what the kinds mean (aimed insults and threats most,
negated and reported ones least) gives the score.

Learning: at most ``SAMPLE`` labelled texts of each label, the ones with the
smallest hash of their id. Word counts by label are added up in Spark, stems are
derived from them, and what differs beyond chance (``LEAST_G`` of the
log-likelihood ratio; a stem needs ``LEAST_FORMS`` forms) is kept, at most
``ENTRIES`` of them. The regression is fitted to the sample's features, a
few numbers a text, with each label weighted back to its share of all labels.
Everything else runs over all rows: texts are scored whole, where they lie, with
the broadcast tables of bounded size.

Edge cases: null and empty texts have no match and the score of such; unlabelled,
null-labelled and held-out rows are not learnt from, nor labels without a
document; a text labelled twice counts with its larger label; of several texts
of one id one is learnt from; without labels all scores are 0.5, with one label
only they are that label's smoothed share; equal texts score alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import held_out, materialize, table

#: Texts of each label that are learnt from, at most.
SAMPLE = 8000
#: Entries of the lexicon, at most; the log-likelihood ratio and the odds that one needs; the odds, the forms and the letters that a stem needs.
ENTRIES, LEAST_G, LEAST_ODDS, STEM_ODDS, LEAST_FORMS, LEAST_STEM = 20_000, 20.0, 3.0, 8.0, 5, 3
#: A shorter stem goes if one letter more keeps this share of its toxic uses.
SAME_STEM = 0.9
#: A word under a stem has a weight of its own, which leans on the stem's as if it were seen so often.
STEM_ROWS = 4.0
THRESHOLD = 0.5

OTHER, INSULT, VERB, PERSON, NEGATION, REPORT, QUOTE, COMMA, STOP = range(9)
#: Fixed word lists: threatening verbs, persons, negations and words of reporting, in English, German, French and Spanish.
CLOSED = {
    VERB: "kill hurt beat destroy shoot stab burn hang töten umbringen schlagen vernichten erschießen tuer frapper détruire brûler matar golpear destruir quemar",
    PERSON: "you your yours u they them their these those she he him her du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú ti tus usted ustedes vosotros ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't nobody nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco",
    REPORT: "said says say claimed claims wrote writes quoted called reported according sagte sagt schrieb schreibt behauptet nannte laut dit disait écrit selon affirme dijo dice escribió según llamó afirma",
}
#: What a threat weighs, as the log of odds.
THREAT_WEIGHT = 2.0
#: For how many words a person, a negation, or a verb or insult without its person counts.
NEAR, SCOPE, PENDING = 4, 3, 4
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n]|[,;:]|[\"“”„«»]")
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: What the regression's weights lean on: the bias, each kind, the number of matches, their weight by length, length.
PRIOR = np.array([-3.0, 1.0, 1.2, 0.3, 0.3, 1.2, 0.5, 0.5, 0.0])
PRIOR_STRENGTH = 0.05


def _fade(length: int, start: int):
    """A transducer that is on for ``length`` words after the symbol ``start``; it says whether it is on. Commas and stops end it."""
    return length + 1, lambda s, x: (0 if x in (COMMA, STOP) else length if x == start else max(0, s - 1), s > 0)


def _pending(start: int):
    """A transducer that waits for a person after ``start``; it says whether one has come just now."""
    return PENDING + 1, lambda s, x: (0 if x in (COMMA, STOP) else PENDING if x == start else 0 if x == PERSON else max(0, s - 1), s > 0 and x == PERSON)


def _reported(s: int, x: int) -> tuple[int, bool]:
    """Bit 1: after a word of reporting, to the stop; bit 2: between quotes, to the end of the sentence."""
    return (0 if x == STOP else s | 1 if x == REPORT else s ^ 2 if x == QUOTE else s), s > 0


#: The five transducers: states, and (state, symbol) -> (state, output).
PARTS = {"insult": _pending(INSULT), "threat": _pending(VERB), "target": _fade(NEAR, PERSON), "negation": _fade(SCOPE, NEGATION), "report": (4, _reported)}
#: What the composed table says at a symbol: nothing, an insult of a kind, a plain one that turns out aimed, or a threat (for which person and verb have met).
NOTHING, TURNS, THREAT = 0, 5, 6


def compose() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by (state, symbol) of the five transducers run side by side, over the states that are reached from the first."""
    names = list(PARTS)
    number, todo = {(0,) * len(names): 0}, [(0,) * len(names)]
    after, says = [], []
    while todo:
        states = todo.pop(0)
        row, out = [], []
        for x in range(STOP + 1):
            moved = {n: PARTS[n][1](s, x) for n, s in zip(names, states, strict=True)}
            to = tuple(moved[n][0] for n in names)
            on = {n: moved[n][1] for n in names}
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            quiet = 4 if on["report"] else 3 if on["negation"] else 0
            if x == INSULT:
                out.append(quiet or (2 if on["target"] else 1))
            elif x == VERB and on["target"] and not quiet:
                out.append(NOTHING)  # "you kill" is told, not threatened: only a person after the verb makes a threat
            elif on["threat"] and not quiet:
                out.append(THREAT)
            elif on["insult"] and not quiet:
                out.append(TURNS)
            else:
                out.append(NOTHING)
        after.append(row)
        says.append(out)
    return np.array(after), np.array(says)


NEXT, SAYS = (t.tolist() for t in compose())


class Lexicon:
    """A weighted letter automaton: words, and stems that accept every longer word."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        """``entries``: (text, whether it is a stem, weight)."""
        self.entries = entries

    @cached_property
    def states(self) -> list[dict]:
        """Arcs by letter; under 0 the weight of a word that ends here, under 1 that of a longer one."""
        out: list[dict] = [{}]
        for text, stem, weight in self.entries:
            at = 0
            for c in text:
                if c not in out[at]:
                    out[at][c] = len(out)
                    out.append({})
                at = out[at][c]
            out[at][int(stem)] = weight
        return out

    def weight(self, word: str) -> float:
        """Of the longest accepting state; 0 if none accepts."""
        at, best = 0, 0.0
        for c in word:
            best = self.states[at].get(1, best)
            at = self.states[at].get(c)
            if at is None:
                return best
        return self.states[at].get(0, best)


class Reader(dict):
    """token -> (symbol, weight), in a bounded cache before the lexicon."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.closed = {w: symbol for symbol, words in CLOSED.items() for w in words.split()}
        self.closed |= dict.fromkeys(".!?\n", STOP) | dict.fromkeys(",;:", COMMA) | dict.fromkeys('"“”„«»', QUOTE)

    def __missing__(self, token: str) -> tuple[int, float]:
        word = token.lower().replace("’", "'")
        weight = self.lexicon.weight(word)
        out = (INSULT, weight) if weight > 0 else (self.closed.get(word, OTHER), 0.0)
        if len(self) < self.LIMIT:
            self[token] = out
        return out

    def matches(self, text: str) -> tuple[list[float], int, int]:
        """(weight matched by kind, number of matches, number of tokens) of a text."""
        tokens = TOKEN.findall(text)
        got, n = [0.0] * len(KINDS), 0
        symbols = [self[t] for t in tokens]
        if not any(s in (INSULT, VERB) for s, _ in symbols):
            return got, 0, len(tokens)
        state, last = 0, 0.0
        for symbol, weight in symbols:
            says = SAYS[state][symbol]
            state = NEXT[state][symbol]
            if says == NOTHING:
                last = 0.0 if symbol in (COMMA, STOP) else last
            elif says == THREAT:
                got[4] += THREAT_WEIGHT
                n += 1
            elif says == TURNS:
                got[0] -= last
                got[1] += last
                last = 0.0
            else:
                got[says - 1] += weight
                n += 1
                last = weight if says == 1 else 0.0
        return [max(0.0, v) for v in got], n, len(tokens)

    def features(self, text: str | None) -> np.ndarray:
        got, n, length = self.matches(text or "")
        return np.array([1.0, *np.log1p(got), np.log1p(n), np.log1p(100 * sum(got) / max(1, length)), np.log1p(length) / 10])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[DataFrame, list[int]]:
    """((id, text, label) of at most ``limit`` texts of each label, and how many of each label there are). Chosen ids, at most two times ``limit``, are broadcast."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    one = materialize(one.select(F.col("doc_id").alias("id"), (F.col("label") > 0).cast("int").alias("label")), "labelled")
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [one.where(F.col("label") == k).orderBy(F.xxhash64("id", F.lit(31)), "id").limit(limit) for k in (0, 1)]
    known = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), F.col("doc_id") == F.col("id"))
    sample = known.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return materialize(sample.select("id", "text", "label"), "labelled-texts"), [counts.get(0, 0), counts.get(1, 0)]


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many toxic and clean texts each word is. Batches are counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[label].update({t.lower().replace("’", "'") for t in TOKEN.findall(text or "") if t[0].isalpha()})
            words = list(n[0] | n[1])
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "neg": pa.array([n[0][w] for w in words], pa.int64()), "pos": pa.array([n[1][w] for w in words], pa.int64())})

    return sample.select("text", "label").mapInArrow(count, "word string, neg long, pos long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _g(pos: Column, neg: Column, p: int, n: int) -> Column:
    """Twice the log-likelihood ratio of ``pos`` and ``neg`` uses against the shares of p toxic and n clean texts."""
    all_, share = pos + neg, p / (p + n)
    part = lambda k, s: F.when(k > 0, k * F.log(k / (all_ * s))).otherwise(0.0)
    return 2 * (part(pos, share) + part(neg, 1 - share))


def learn_lexicon(sample: DataFrame, taken: list[int], entries: int = ENTRIES) -> Lexicon:
    """Words and stems that toxic texts use beyond chance; ``taken``: clean and toxic texts of the sample."""
    n, p = taken
    if not n or not p:
        return Lexicon([])
    words = materialize(word_counts(sample), "word-counts")
    pos, neg = F.col("pos"), F.col("neg")
    odds = lambda a, b: ((a + 0.5) / (p + 1)) / ((b + 0.5) / (n + 1))
    tells = (_g(pos, neg, p, n) >= LEAST_G) & (odds(pos, neg) >= LEAST_ODDS)
    longer = F.transform(F.sequence(F.lit(LEAST_STEM), F.least(F.length("word") - 1, F.lit(24))), lambda k: F.substring("word", F.lit(1), k))
    cut = words.where((F.length("word") > LEAST_STEM) & (pos > 0)).select(F.explode(longer).alias("stem")).groupBy("stem").agg(F.count("*").alias("forms")).where(F.col("forms") >= LEAST_FORMS)
    # A stem tells by its forms, not by one of them: the most used one is left out.
    uses = words.where(F.length("word") > LEAST_STEM).select("pos", "neg", F.explode(longer).alias("stem")).groupBy("stem")
    uses = uses.agg((F.sum("pos") - F.max("pos")).alias("pos"), (F.sum("neg") - F.max_by("neg", "pos")).alias("neg"))
    stems = materialize(cut.join(uses, "stem").where(tells & (odds(pos, neg) >= STEM_ODDS)).select("stem", "pos", "neg"), "stems")
    child = stems.groupBy(F.expr("substring(stem, 1, length(stem) - 1)").alias("stem")).agg(F.max("pos").alias("kept"))
    stems = stems.join(child, "stem", "left").where(F.coalesce("kept", F.lit(0)) < SAME_STEM * pos)
    top = stems.orderBy(_g(pos, neg, p, n).desc(), "stem").limit(entries).select("stem", "pos", "neg").collect()
    rate = {r["stem"]: odds(r["pos"], r["neg"]) for r in top}
    found = [(s, True, float(np.log(v))) for s, v in rate.items()]
    # Words that tell by themselves, and words under a stem that clean texts use too.
    seen = words.where(tells | (neg >= 3) & (pos + neg >= 5)) if rate else words.where(tells)
    known = seen.select("word", "pos", "neg", tells.alias("tells"), _g(pos, neg, p, n).alias("g"))
    shared = sorted(rate, key=len, reverse=True)
    if shared:
        under = F.array(*[F.lit(s) for s in shared]) if len(shared) <= 200 else None
        near = F.exists(under, lambda s: F.startswith("word", s)) if under is not None else F.lit(True)
        known = known.where(F.col("tells") | near)
    for r in known.orderBy(F.col("tells").desc(), F.abs("g").desc(), "word").limit(entries).collect():
        stem = next((s for k in range(len(r["word"]) - 1, LEAST_STEM - 1, -1) if (s := r["word"][:k]) in rate), None)
        own = odds(r["pos"], r["neg"])
        if stem:
            k = STEM_ROWS / (1 + rate[stem])
            own = odds(r["pos"] + k * rate[stem], r["neg"] + k)
        if r["tells"] or stem:
            found.append((r["word"], False, max(0.0, float(np.log(own)))))
    return Lexicon(found)


def fit_scores(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, prior: np.ndarray = PRIOR, strength: float = PRIOR_STRENGTH) -> np.ndarray:
    """Logistic weights by Newton's method, leaning on ``prior``; ``weigh`` is each row's weight."""
    w, pull = prior.copy(), strength * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weigh * (p - y)) + 0.01 * pull * (w - prior)
        bend = (x * (weigh * p * (1 - p))[:, None]).T @ x + 0.01 * pull * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        size = np.abs(step).max()
        w = w - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w


class Model:
    """The lexicon and the regression's weights."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    sample, counts = labelled_sample(docs, labels, limit)
    taken = [min(c, limit) for c in counts]
    lexicon = learn_lexicon(sample, taken)
    if not all(counts):
        share = (counts[1] + 1) / (sum(counts) + 2)
        return Model(lexicon, np.array([np.log(share / (1 - share)), *[0.0] * (len(PRIOR) - 1)]))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "label": batch.column(2), "x": pa.array([reader.features(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))})

    got = sample.mapInArrow(rows, "id string, label int, x array<double>").collect()
    got.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in got], float)
    back = np.array([counts[k] / taken[k] for k in (0, 1)])
    weigh = back[y.astype(int)]
    return Model(lexicon, fit_scores(np.array([r["x"] for r in got]), y, weigh / weigh.mean()))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``score`` and the ``matches`` by kind (in place of columns of these names)."""
    keep = [c for c in keep if c not in ("score", "matches")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    kinds = pa.struct([(k, pa.float64()) for k in KINDS])
    out = f"kept {taken.schema['kept'].dataType.simpleString()}, score double, matches struct<{', '.join(f'{k}: double' for k in KINDS)}>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.lexicon)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                x = reader.features(text.as_py())
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ m.weights, -35, 35)))))
                found.append(dict(zip(KINDS, np.expm1(x[1 : len(KINDS) + 1]).tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kinds)], names=["kept", "score", "matches"])

    return taken.mapInArrow(apply, out).select(*[F.col("kept")[c].alias(c) for c in keep], "score", "matches")


def op11_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
