"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits (for few languages all splits of them
into two sets; for many, the best of several fixed random codes by least
distance). One binary classifier per bit, a logistic regression on hashed byte
bigrams and trigrams of the lower-cased text, predicts on which side of the
split a text lies. Decoding adds up, for each language, the logistic losses of
all bits against its codeword, each weighted by how well that classifier knows
that language in training; the least loss wins. If the runner-up's loss is close,
the text is flagged ambiguous.

Training takes at most ``SAMPLE`` texts, shared evenly among the languages (the
``LANGUAGES`` most frequent ones), the ones with the smallest hash of id and text. Everything else runs over all rows:
the fitted arrays are of fixed size for a set of languages and broadcast; whole
texts are read where they lie, without a shuffle.

Edge cases: texts that are null or without a letter are ``und`` with score 0;
null languages are not learnt; ids may repeat: each row is learnt with its own
language, equal rows once; with one language every text with a letter is it,
with none every text is ``und``; equal rows get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import held_out, table

#: log2 of the features for each length of n-gram.
BITS = 12
SAMPLE = 3000
#: So many languages are learnt at most, those with the most rows (equal ones by name); texts of others get one of these.
LANGUAGES = 300
#: Up to so many languages the code has all splits.
ALL_SPLITS = 6
ROUNDS, RATE, DECAY = 60, 30.0, 1e-4
#: The runner-up is close if its share of the softmax over losses is over this.
CLOSE = 0.35
_LETTER = regex.compile(r"\p{L}")
_MASK = np.uint32((1 << BITS) - 1)


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of -1 and 1; rows are pairwise different."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= ALL_SPLITS:
        rest = [s for s in product((-1, 1), repeat=languages - 1) if -1 in s]
        return np.array([(1, *s) for s in rest], float).T
    bits, best, most = 12 * int(np.ceil(np.log2(languages))), None, -1
    for seed in range(40):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2
        least = (apart + np.eye(languages) * bits).min()
        if least > most and (np.abs(code.sum(0)) < languages).all():
            best, most = code, least
    return best


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of hashed byte bigrams and trigrams: square roots of counts over their length."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    second = (two * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    third = ((three * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)) + (_MASK + np.uint32(1))
    counts = np.bincount(np.concatenate([second, third]).astype(np.int64), minlength=2 << BITS)
    index = np.flatnonzero(counts)
    n = counts[index]
    return index, (np.sqrt(n) / np.sqrt(n.sum())).astype(np.float32)


def fit(texts: list[str], names: list[str]) -> dict[str, np.ndarray]:
    """The model's arrays: languages, code, weights (features, bits), bias, trust (languages, bits)."""
    languages = sorted(set(names))
    code = codewords(len(languages))
    x = np.zeros((len(texts), 2 << BITS), np.float32)
    for row, text in zip(x, texts, strict=True):
        index, value = features(text)
        row[index] = value
    which = np.array([languages.index(n) for n in names])
    y = code[which].astype(np.float32)
    share = np.bincount(which, minlength=len(languages))
    weigh = (1 / share[which]).astype(np.float32)[:, None] / len(languages)
    w, bias = np.zeros((2 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    v, vb = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(ROUNDS):
        pull = -y * weigh / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        v = 0.9 * v + x.T @ pull + DECAY * w
        vb = 0.9 * vb + pull.sum(0)
        w -= RATE * v * 0.1
        bias -= RATE * vb * 0.1
    right = (np.sign(x @ w + bias) == y).astype(float)
    trust = np.stack([right[which == k].mean(0) for k in range(len(languages))])
    return {"languages": np.array(languages, object), "code": code, "w": w, "bias": bias, "trust": trust / trust.sum(1, keepdims=True)}


def predict(text: str | None, model: dict) -> tuple[str, float, bool]:
    """(language, score, ambiguous)."""
    if not text or not len(model["languages"]) or not _LETTER.search(text):
        return "und", 0.0, False
    index, value = features(text)
    f = value @ model["w"][index] + model["bias"]
    loss = (model["trust"] * np.logaddexp(0, -model["code"] * f)).sum(1) * model["code"].shape[1]
    share = np.exp(loss.min() - loss)
    share /= share.sum()
    order = np.argsort(loss, kind="stable")
    return str(model["languages"][order[0]]), float(share[order[0]]), len(order) > 1 and bool(share[order[1]] > CLOSE)


def training_rows(docs: DataFrame, limit: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """At most ``limit`` (id, text, name) rows in all, evenly by language: each language's texts with the smallest hash of id and text.

    Only the ``languages`` most frequent values of lang take part (fewer, if ``limit`` is smaller), so dirty values don't reach the driver.

    A row is known by id, language and text hash, so that ids with several texts
    or languages give no other rows than the chosen ones. Hashes far beyond a
    language's share go before the ranking, by its count, which keeps the ranked
    rows of a language a small multiple of its share. Only the chosen keys, which
    ``limit`` bounds, are broadcast.
    """
    keyed = docs.select("doc_id", "lang", F.xxhash64("text", F.lit(23)).alias("text_hash"), "text")
    usable = keyed.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    often = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(languages, limit))
    counts = [(r["lang"], r["n"]) for r in often.collect()]
    each = max(1, limit // max(1, len(counts)))
    spark = docs.sparkSession
    # A share of all hashes that holds ``each`` rows and more than ten standard deviations besides.
    cuts = spark.createDataFrame([(lang, min(1.0, (each + 10 * each**0.5 + 100) / n)) for lang, n in counts], "lang string, share double")
    drawn = usable.select("doc_id", "lang", "text_hash").join(F.broadcast(cuts), "lang").withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(5)))
    near = drawn.where(F.col("h") <= F.col("share") * F.lit(2.0**64) - F.lit(2.0**63))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash")))
    chosen = ranked.where(F.col("rank") <= each).orderBy("rank", "lang").limit(limit).select("doc_id", "lang", "text_hash").distinct()
    return usable.join(F.broadcast(chosen), ["doc_id", "lang", "text_hash"]).dropDuplicates(["doc_id", "lang", "text_hash"]).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("name"))


def learn(docs: DataFrame, limit: int = SAMPLE) -> dict:
    parts = "languages array<string>, code binary, w binary, bias binary, trust binary"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[crc32(str(i).encode()) for i in rows["id"]]).sort_values(["order", "id", "name"], kind="stable")
        m = fit(rows["text"].tolist(), rows["name"].tolist())
        blob = {k: [m[k].astype("<f4").tobytes()] for k in ("code", "w", "bias", "trust")}
        return pd.DataFrame({"languages": [list(m["languages"])], **blob})

    got = training_rows(docs, limit).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(one, parts).collect()
    if not got:
        return {"languages": np.array([], object)}
    n = len(got[0]["languages"])
    arrays = {k: np.frombuffer(bytes(got[0][k]), "<f4") for k in ("code", "w", "bias", "trust")}
    return {"languages": np.array(got[0]["languages"], object), "code": arrays["code"].reshape(n, -1), "w": arrays["w"].reshape(2 << BITS, -1), "bias": arrays["bias"], "trust": arrays["trust"].reshape(n, -1)}


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``lang_pred``, ``score``, ``ambiguous`` (in place of columns of those names)."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    out = "kept " + taken.schema["kept"].dataType.simpleString() + ", lang_pred string, score double, ambiguous boolean"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [predict(t.as_py(), shared.value) for t in batch.column(1)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["kept", "lang_pred", "score", "ambiguous"])

    return taken.mapInArrow(apply, out).select(*[F.col("kept")[c].alias(c) for c in keep], "lang_pred", "score", "ambiguous")


def op5_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
