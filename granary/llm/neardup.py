"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation, components.

A text's words (ASCII letters lower-cased) give a set of word shingles, held as
64-bit hashes. Two texts are linked if the Jaccard similarity of their sets
reaches a threshold; groups are the connected components of the links.

1. *Classes.* Texts with equal sets are one class (by strong digest of the set),
   stood for by its smallest id, however many copies there are.
2. *Signatures.* A class gets MinHash samples, cut into bands, and an odd sketch:
   each (sample number, sample) flips one bit of a bitmap. The bits in which two
   sketches differ estimate how many samples differ, most precisely so for high
   similarities.
3. *Candidates in rounds.* In a bucket (classes with an equal band) nobody is
   paired with everybody. First every class meets the bucket's smallest id.
   Links that hold are joined into components; buckets within one component are
   done, as no further link could change it. In the others, components with a
   pair that sizes and sketches admit are likely to be linked; per bucket a
   spanning forest of such components is kept, and their connected components
   over all buckets are clusters. Any link that is still missing lies within a
   cluster. There the classes meet, in tiles of bounded size: admitted pairs of
   a common band are confirmed on full sets, the nearest first, and only while
   their components are apart. So a task yields fewer pairs than it has
   components, however large the group of near copies.
4. *Confirmation.* A pair whose sketches admit the threshold is confirmed on the
   full sets, by sizes first, then by their exact intersection.
5. *Components* by large-star and small-star steps on the links, as joins and
   minima, with each round's links written to the shared folder.

A pair at the threshold shares no band with probability ``MISS`` at most (the
bands are chosen so), and fails the sketch test, set ``SLACK`` standard
deviations below the threshold, less often than that. Pairs above the threshold
do so still less often.

Edge cases: null or wordless texts have an empty set, are linked with nothing
and stay; texts of fewer words than a shingle are one shingle; rows with equal
ids are one node, whose texts' links all count; a row without an id is in no
group and stays, but ``unique_documents`` groups it by its text; an empty table
gives an empty result; other columns are only carried by ``unique_documents``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, measured, table

SHINGLE, THRESHOLD = 5, Fraction(4, 5)
ROWS = 5
MISS = 1e-9
SKETCH_BITS, SKETCH_SAMPLES = 2048, 320
SLACK = 6.0
#: What is compared at once in memory: so many classes, and so many bytes of their sets.
TILE, TILE_BYTES = 1024, 1 << 24

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bands_for(threshold: Fraction, rows: int = ROWS, miss: float = MISS) -> int:
    """How many bands of ``rows`` samples miss a pair at the threshold with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(float(threshold) ** rows)))


class WordHashes(dict):
    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        out = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < self.LIMIT:
            self[word] = out
        return out


_WORDS = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = _WORD.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, len(h) if len(h) < size else size, np.uint64)
    for k in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


class Signer:
    """MinHash bands and odd sketches of shingle sets. Sketches take ``SKETCH_SAMPLES`` samples, of which the first make the bands."""

    def __init__(self, threshold: Fraction):
        self.bands = bands_for(threshold)
        self.samples = max(SKETCH_SAMPLES, self.bands * ROWS)
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(0, 1 << 31, self.samples, np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 1 << 32, self.samples, np.uint32)
        self.salt = _mix(np.arange(1, self.samples + 1, dtype=np.uint64))

    def samples_of(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.samples, np.iinfo(np.uint32).max, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 512):
            np.minimum(low, ((short[None, at : at + 512] ^ self.xor[:, None]) * self.mul[:, None]).min(1), out=low)
        return low.astype(np.uint64)

    def sign(self, shingles: np.ndarray) -> tuple[list[int], bytes]:
        """(a hash for each band, the sketch)."""
        each = _mix(self.samples_of(shingles) ^ self.salt)
        bands = each[: self.bands * ROWS].reshape(self.bands, ROWS)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
        bits = np.bincount((each % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return h.astype(np.int64).tolist(), np.packbits(bits.astype(np.uint8)).tobytes()


def most_different_bits(threshold: Fraction, samples: int, bits: int = SKETCH_BITS) -> int:
    """The largest number of differing sketch bits that still admits a pair at the threshold.

    At similarity J each sample differs with probability 1 - J and then flips
    two bits; m random flips among n bits leave n (1 - (1 - 2/n)^m) / 2 odd ones.
    The number's spread comes from the samples (two bits each) and the bits.
    """
    p = 1 - float(threshold)
    odd = bits * (1 - (1 - 2 / bits) ** (2 * samples * p)) / 2
    spread = math.sqrt(4 * samples * p * (1 - p) + odd)
    return min(bits, math.ceil(odd + SLACK * spread))


def _signatures(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set digest, bands, sketch) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, last = Signer(threshold), {}
        for batch in batches:
            rows = []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in last:
                    last = last if len(last) < 2000 else {}
                    last[digest] = signer.sign(s)
                rows.append((len(s), digest, *last[digest]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(4)]
            made = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=schema)

    return docs.select("doc_id", _text_hash(), "text").mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _text_hash() -> Column:
    return F.xxhash64("text", F.lit(29)).alias("text_hash")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of every node in ``links(a, b)``: the smallest node reachable.

    A round is a large-star and a small-star step, written once; the number of
    edges and the sum of their hashes, taken while they are written, say whether
    it changed anything.
    """
    spark = links.sparkSession
    figures = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}

    def star(edges: DataFrame) -> DataFrame:
        """Each larger neighbour of a node is tied to the node's smallest one, then each node's smaller neighbours to the smallest of them."""
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(low, edges["b"] == low["u"]).select("a", F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        return ties.select("e.a", "e.b").where("a <> b").distinct()

    edges, seen = measured(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label, **figures)
    while seen["n"]:
        edges, now = measured(star(edges), label, **figures)
        if now == seen:
            break
        seen = now
    # A fixed point is a forest of stars: each node has one edge, to a centre that has none.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``left`` with every row of ``right``, for sketches as rows of uint64."""
    out = np.zeros((len(left), len(right)), np.int32)
    for k in range(left.shape[1]):
        out += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return out


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


class Sets:
    """Union-find over component ids."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def admitted(x: pd.DataFrame, y: pd.DataFrame, most: int, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) of different components that sizes and sketches admit, the nearest sketches first."""
    p, q = ratio
    nx, ny = x["n_shingles"].to_numpy()[:, None], y["n_shingles"].to_numpy()[None]
    apart = _apart(_sketches(x["sketch"]), _sketches(y["sketch"]))
    ok = (apart <= most) & (q * np.minimum(nx, ny) >= p * np.maximum(nx, ny)) & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None])
    i, j = np.nonzero(ok)
    order = np.argsort(apart[i, j], kind="stable")
    return i[order], j[order]


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def likely_forest(x: pd.DataFrame, y: pd.DataFrame, most: int, ratio: tuple[int, int]) -> pd.DataFrame:
    """A spanning forest, over components, of the admitted pairs: fewer pairs than there are components."""
    if not len(x) or not len(y):
        return _pairs([])
    i, j = admitted(x, y, most, ratio)
    sets, cx, cy = Sets(), x["component"].to_numpy(), y["component"].to_numpy()
    ends = np.unique(np.stack([cx[i], cy[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return _pairs([(int(a), int(b)) for a, b in ends if sets.join(int(a), int(b))])


def common_count(u: np.ndarray, v: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    at = np.searchsorted(v, u)
    return int(np.count_nonzero(v[np.minimum(at, len(v) - 1)] == u))


def linked_forest(x: pd.DataFrame, y: pd.DataFrame, most: int, ratio: tuple[int, int]) -> pd.DataFrame:
    """A spanning forest, over components, of the links: admitted pairs that share a band are confirmed on full sets, nearest first, while their components are apart."""
    if not len(x) or not len(y):
        return _pairs([])
    p, q = ratio
    i, j = admitted(x, y, most, ratio)
    sets, cx, cy = Sets(), x["component"].tolist(), y["component"].tolist()
    bx, by, sx, sy = x["bands"].tolist(), y["bands"].tolist(), x["shingles"].tolist(), y["shingles"].tolist()
    found = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if sets.find(cx[a]) == sets.find(cy[b]) or not (np.asarray(bx[a]) == np.asarray(by[b])).any():
            continue
        u, v = (np.asarray(s, np.int64).view(np.uint64) for s in (sx[a], sy[b]))
        common = common_count(u, v)
        if q * common >= p * (len(u) + len(v) - common):
            sets.join(cx[a], cy[b])
            found.append((cx[a], cy[b]))
    return _pairs(found)


class Grouping:
    """The search over one corpus: written signatures of classes, growing components."""

    def __init__(self, classes: DataFrame, docs: DataFrame, size: int, threshold: Fraction):
        self.classes, self.docs, self.size, self.threshold = classes, docs, size, threshold
        self.most = most_different_bits(threshold, Signer(threshold).samples)
        banded = classes.select("rep", F.explode("bands").alias("h"))
        shared = banded.groupBy("h").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        self.members = materialize(banded.join(shared, "h").select("h", "rep", "first"), "members")
        self.needed = materialize(self._sets(), "sets")

    def _sets(self) -> DataFrame:
        """(rep, shingles) of the classes that share a bucket, each from one text of its owner."""
        size = self.size

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(t.as_py(), size) for t in batch.column(2)]
                fit = [k for k, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == batch.column(1)[k].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit, pa.int64())), pa.array([sets[k].astype(np.int64) for k in fit], pa.list_(pa.int64()))], names=["rep", "shingles"])

        texts = self.docs.where("doc_id is not null").select("doc_id", _text_hash(), "text").dropDuplicates(["doc_id", "text_hash"])
        wanted = self.members.select("rep").distinct()
        chosen = self.classes.join(wanted, "rep", "left_semi").select("rep", "digest", F.col("owner").alias("doc_id"), "text_hash")
        return texts.join(chosen, ["doc_id", "text_hash"]).select("rep", "digest", "text").mapInArrow(collect, "rep long, shingles array<long>")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold: by sizes and sketches, then on full sets."""
        p, q, most = self.threshold.numerator, self.threshold.denominator, self.most
        side = lambda c: self.classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        sized = pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(q * F.least("na", "nb") >= p * F.greatest("na", "nb"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
                    ok = pa.array(np.bitwise_count(x ^ y).sum(1) <= most)
                    yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in range(4)], names=["a", "b", "na", "nb"])

        likely = sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long, na long, nb long")
        sets = lambda c: self.needed.select(F.col("rep").alias(c), F.col("shingles").alias(f"x{c}"))
        both = likely.join(sets("b"), "b").join(sets("a"), "a").withColumn("common", F.size(F.array_intersect("xa", "xb")))
        return both.where(q * F.col("common") >= p * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    def _with_main(self, rows: DataFrame, key: str, label: str) -> tuple[DataFrame, float]:
        """Rows (with their weight ``w``, in tiles) of keys with several components, with the key's ``load`` and whether their component is its largest; and how many tiles the keys make that fit one."""
        counted = rows.groupBy(key, "component").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
        several = counted.groupBy(key).agg(F.max(F.struct("k", "component")).alias("top"), F.sum("w").alias("load"), F.count("*").alias("c")).where("c > 1")
        placed = rows.join(several.select(key, "load", F.col("top.component").alias("most")), key).withColumn("main", F.col("component") == F.col("most")).drop("most")
        out, seen = measured(placed, label, few=F.sum(F.when(F.col("load") <= 1, F.col("w"))))
        return out, seen["few"] or 0.0

    def _meet(self, rows: DataFrame, few_tiles: float, key: str, columns: list[str], forest) -> DataFrame:
        """Pairs of components from ``forest(x, y, ...)`` over the rows of each key.

        Keys that fit a tile share tasks of about a tile. The others are cut
        into tiles: tiles of all rows meet tiles of the rows outside the key's
        main component, as rows within it need not meet.
        """
        most, ratio = self.most, (self.threshold.numerator, self.threshold.denominator)
        cols = [key, "component", "main", *columns]
        tasks = max(1, math.ceil(few_tiles))

        def small(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([forest(g, g[~g["main"]], most, ratio) for _, g in pdf.groupby(key, sort=False)], ignore_index=True)

        few = rows.where(F.col("load") <= 1).withColumn("task", F.pmod(F.xxhash64(key, F.lit(4)), F.lit(tasks)))
        out = few.select("task", *cols).groupBy("task").applyInPandas(small, "a long, b long")
        large = rows.where(F.col("load") > 1)
        size = large.groupBy(key).agg(F.ceil(F.sum("w")).cast("int").alias("ti"), F.ceil(F.sum(F.when(F.col("main"), 0.0).otherwise(F.col("w")))).cast("int").alias("tj"))
        large = large.join(size, key)
        tile = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = large.withColumn("i", tile("ti", 6)).withColumn("j", every("tj")).select("i", "j", *cols)
        y = large.where(~F.col("main")).withColumn("j", tile("tj", 8)).withColumn("i", every("ti")).select(*[F.col(c).alias(c) for c in ("i", "j", *cols)])  # attributes of their own, for cogroup
        tiled = x.groupBy(key, "i", "j").cogroup(y.groupBy(key, "i", "j"))
        return out.unionByName(tiled.applyInPandas(lambda a, b: forest(a, b, most, ratio), "a long, b long"))

    def links(self) -> DataFrame:
        """(node, component) of the linked classes."""
        count = {"n": F.count(F.lit(1))}
        stars = self.members.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
        labels = materialize(components(self.confirmed(stars)), "labels")
        at = self.members.select("h", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        open_, few = self._with_main(at.select("h", "rep", F.coalesce("component", "rep").alias("component"), F.lit(1 / TILE).alias("w")), "h", "open")
        signed = self.classes.select("rep", "n_shingles", "sketch")
        likely = materialize(self._meet(open_.join(signed, "rep"), few, "h", ["n_shingles", "sketch"], likely_forest), "likely")
        clusters = components(likely).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        weight = (1 / TILE + 8 * F.col("n_shingles") / TILE_BYTES).alias("w")
        rows = open_.select("rep", "component").distinct().join(clusters, "component").join(self.classes.select("rep", weight), "rep")
        placed, few = self._with_main(rows, "cluster", "placed")
        full = placed.join(self.classes.select("rep", "n_shingles", "sketch", "bands"), "rep").join(self.needed, "rep")
        fresh, seen = measured(self._meet(full, few, "cluster", ["n_shingles", "sketch", "bands", "shingles"], linked_forest), "links", **count)
        if not seen["n"]:
            return labels
        # The new links join components: label those, and pass the labels on to their members.
        merged = materialize(components(fresh), "merged")
        moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        return materialize(moved.unionByName(merged.join(labels, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed = materialize(_signatures(docs, size, threshold), "signed")
    known = signed.where("digest is not null and doc_id is not null")
    # A class is stood for by its smallest id; if an id with several texts stands for several classes, they are numbered as they are written.
    own = F.min(F.struct("doc_id", "text_hash")).alias("own")
    classes = known.groupBy("digest").agg(own, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select("digest", F.col("own.doc_id").alias("owner"), F.col("own.text_hash").alias("text_hash"), "n_shingles", "bands", "sketch", F.monotonically_increasing_id().alias("number")), "classes")
    ids, seen = measured(known.groupBy("doc_id", "digest").agg(F.lit(1).alias("one")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("digest")), "ids", doubled=F.max("n"))
    doubled = (seen["doubled"] or 0) > 1
    classes = classes.withColumn("rep", F.col("number" if doubled else "owner"))
    labels = Grouping(classes, docs, size, threshold).links()
    of_class = classes.select("digest", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    pairs = known.select("doc_id", "digest").distinct() if doubled else ids.select("doc_id", "digest")
    ids = pairs.join(of_class, "digest")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = ids.join(least, "component").select("doc_id", "component_id")
    if doubled:
        # The texts of one id link their groups.
        placed = materialize(placed.distinct(), "placed")
        merged = components(placed.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "ids")
        placed = placed.select("doc_id").distinct().join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key, no_id, text) of every row: the key is the id, or a hash of the text where there is none, one that no id and no other text has."""
    text_hash = lambda seed: F.xxhash64("text", F.col("text").isNull(), F.lit(seed))
    nameless = docs.where("doc_id is null")
    seed = 17
    if nameless.limit(1).count():
        for seed in itertools.count(seed):
            keys = nameless.select(text_hash(seed).alias("key"), F.sha2("text", 256).alias("digest")).distinct()
            taken = keys.groupBy("key").count().where("count > 1").limit(1).count() or keys.join(docs.select(F.col("doc_id").alias("key")), "key", "left_semi").limit(1).count()
            if not taken:
                break
    return docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", text_hash(seed)).alias("key"), F.col("doc_id").isNull().alias("no_id"), "text")


def unique_documents(docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    Rows with equal ids are one document, the first by text hash. Rows without
    an id are one document if their texts are equal, and come after all ids.
    """
    rows = _keyed(docs)
    grouped = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), size, threshold).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"))
    placed = rows.groupBy("key").agg(F.max("no_id").alias("no_id")).join(grouped, "key")
    chosen = placed.groupBy("component").agg(F.min(F.struct("no_id", "key")).alias("c")).select("c.key")
    # Repeated rows meet before the rows move, which they do once.
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = rows.withColumn("order", F.struct(F.xxhash64("text"), F.xxhash64(*plain))).select("key", "row", "order").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return one.join(chosen, "key", "left_semi").select("row.*")


def op4_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, Fraction(85, 100))
