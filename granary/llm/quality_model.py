"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words, lower-cased, give unigrams and bigrams, hashed into ``2^BITS`` weights,
and shape marks of the same kind (a word's letter case, what it ends in, whether
it repeats the word before), for texts whose words were never seen. A text's
features are the square roots of its counts over their Euclidean length: a
sparse vector whose dot product with the weights, plus a bias, is the score's
log-odds.

Training takes at most ``SAMPLE`` labelled texts (the ones with the smallest
hash of their id), in one task, in hash order, for ``EPOCHS`` passes of
per-coordinate FTRL-proximal updates with L1 and L2 terms. That task gets no
texts: their vectors are made by many tasks and come in pieces of bounded size,
which it keeps in a file of its own between passes, so its memory doesn't grow
with the length of the texts. Everything else runs
over all rows: the weights, an array of fixed size, are broadcast, and texts are
scored where they lie, without a shuffle.

Edge cases: a null or empty text is scored by the bias and the mark of an empty
text; unlabelled, null-labelled and held-out rows are not learnt from; a text
labelled twice counts with its smaller label; of several texts of one id one is
learnt from; without any labels all scores are
0.5; equal rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import TemporaryFile
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import held_out, table

BITS = 18
SAMPLE = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 1e-4
THRESHOLD = 0.3
#: Entries of a vector in one row at most, and bytes of vectors in one batch, about.
PIECE, BATCH_BYTES = 1024, 4 << 20
_MASK = (1 << BITS) - 1


class Hashes(dict):
    """word -> (its hash, its shape's hash), in a bounded cache."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        low = word.lower()
        case = "u" if word.isupper() and len(word) > 1 else "t" if word[:1].isupper() else "l" if low == word and word.isalpha() else "o"
        last = word[-1]
        shape = f"\x00{case}{'a' if last.isalpha() else 'd' if last.isdigit() else last}{'r' if len(word) > 2 and word[-1] == word[-2] else ''}"
        out = (crc32(low.encode("utf-8", "replace")) << 32) | crc32(shape.encode("utf-8", "replace"))
        if len(self) < self.LIMIT:
            self[word] = out
        return out


_HASHES = Hashes()


def feature_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, counts) of the features of a text."""
    words = (text or "").split()
    if not words:
        return np.array([crc32(b"\x00empty") & _MASK]), np.ones(1, np.int64)
    both = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    one, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) >> np.uint64(20)
    again = np.where(one[1:] == one[:-1], np.uint64(0x51ED270B), np.uint64(0xA24BAED4))
    every = np.concatenate([one ^ (one >> np.uint64(16)), pair, shape, again]) & np.uint64(_MASK)
    counts = np.bincount(every.astype(np.int64), minlength=1) if len(every) > 1 << 16 else None
    if counts is None:
        index, n = np.unique(every.astype(np.int64), return_counts=True)
    else:
        index = np.flatnonzero(counts)
        n = counts[index]
    return index, n


def values(n: np.ndarray) -> np.ndarray:
    """The vector's values for its features' counts."""
    return np.sqrt(n) / np.sqrt(n.sum())


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of the sparse vector of a text."""
    index, n = feature_counts(text)
    return index, values(n)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, without penalties."""

    def __init__(self, size: int = _MASK + 2, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size - 1

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        l1, l2 = np.where(index == self.bias, 0, self.l1), np.where(index == self.bias, 0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, self.bias), np.append(value, 1.0)
        w = self.weights(index)
        g = (sigmoid(float(w @ value)) - label) * value
        step = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - step * w
        self.n[index] += g * g

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` (id, text, label) rows, one per id: of several texts of an id that with the smallest hash.

    Only the chosen ids, which ``limit`` bounds, are broadcast; no text is shuffled but theirs, one per id and task.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("id"), "label")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return known.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "label")


def vector_pieces(sample: DataFrame) -> DataFrame:
    """(place, id, label, piece, pairs): the vectors of the sample's texts, each in rows of at most ``PIECE`` pairs (index, count) of 32-bit integers; ``place`` is the hash that orders the training."""
    taken = sample.select(F.crc32(F.col("id").cast("string").cast("binary")).alias("place"), "id", "label", "text")
    kind = {f.name: f.dataType.simpleString() for f in taken.schema}

    def made(batch: pa.RecordBatch, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        at, piece, pairs = zip(*rows, strict=True)
        own = [batch.column(c).take(pa.array(at, pa.int32())) for c in range(3)]
        return pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), pa.array(pairs, pa.binary())], names=["place", "id", "label", "piece", "pairs"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for at, text in enumerate(batch.column(3)):
                pairs = np.stack(feature_counts(text.as_py()), axis=1).astype("<i4")
                rows += [(at, piece, pairs[start : start + PIECE].tobytes()) for piece, start in enumerate(range(0, len(pairs), PIECE))]
                size += pairs.nbytes
                if size > BATCH_BYTES:
                    yield made(batch, rows)
                    rows, size = [], 0
            if rows:
                yield made(batch, rows)

    return taken.mapInArrow(apply, f"place long, id {kind['id']}, label {kind['label']}, piece int, pairs binary")


def train(sample: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, bias last."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[int]] = []  # label and bytes of each, in order
        with TemporaryFile() as vectors:
            for batch in batches:
                for label, piece, pairs in zip(*[batch.column(c) for c in range(3)], strict=True):
                    if piece.as_py() == 0:
                        texts.append([int(label.as_py()), 0])
                    texts[-1][1] += vectors.write(pairs.as_buffer())
            model = Ftrl()
            for _ in range(epochs):
                vectors.seek(0)
                for label, size in texts:
                    index, n = np.frombuffer(vectors.read(size), "<i4").astype(np.int64).reshape(-1, 2).T
                    model.learn(index, values(n), label)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([model.all_weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    ordered = vector_pieces(sample).repartition(1).sortWithinPartitions("place", "id", "label", "piece").select("label", "piece", "pairs")
    got = ordered.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(bytes(got[0]["weights"]), "<f4").astype(np.float64) if got else np.zeros(_MASK + 2)


def score_of(spark: SparkSession, text: Column, weights: np.ndarray) -> Column:
    """The scores of a column of texts. Python gets the texts once and gives numbers back; no other column goes there."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value.astype(np.float64)
        for texts in batches:
            got = []
            for t in texts:
                index, value = features(t.as_py())
                got.append(sigmoid(float(w[index] @ value + w[-1])))
            yield pa.array(got, pa.float64())

    return apply(text)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``score`` (in place of a column of that name)."""
    keep = [c for c in keep if c != "score"]
    return docs.select(*[F.col(f"`{c}`") for c in keep], score_of(docs.sparkSession, F.col("text"), weights).alias("score"))


def quality_weights(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> np.ndarray:
    return train(labelled_sample(docs, labels, limit))


def good_documents(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns; the model learns from ``learn_from``."""
    return docs.where(score_of(docs.sparkSession, F.col("text"), quality_weights(learn_from, labels)) >= threshold)


def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_weights(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
