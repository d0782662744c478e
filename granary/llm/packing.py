"""Packing documents into fixed-length sequences: best fit, then swap-based local search.

Documents become token ids plus an end id. Documents longer than a sequence
are cut into full pieces and a remainder; shorter ones are never cut. Pieces
are dealt at random into groups of about ``GROUP_PIECES``; each group is packed
by one task, from lengths alone: best-fit decreasing, then local search that
exchanges one-for-one, two-for-one or moves pieces between underfull bins as
long as the sum of squared fills rises, so that the emptiest bins run empty. It
ends only when no two underfull bins have such a step, or no packing has fewer bins.
A group costs at most one partly filled bin more than packing all together,
a share of the result that does not depend on the input's size.

Edge cases: a null text is an empty one, a single end id; equal rows are packed
each on their own; ties go to the piece that comes first by (length, id, piece);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import vocab
from granary.llm.common import materialize, table

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def tokenized_pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document; ``salt`` is a random number from a generator seeded by the partition, so that a task run again gives the same."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = vocab.word_encoder(file), np.array([end_id], "<u4").tobytes()
        rng = np.random.default_rng([capacity, TaskContext.get().partitionId()])
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, crc32(part), 0, *([part] * with_ids)))
            if rows:
                cols = list(zip(*rows, strict=True))
                cols[5] = rng.integers(0, 1 << 62, len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Bins by free room, found through the bits of one integer."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins


class _Sums:
    """Growing columns: a kind of bin and the summed length of some of its pieces."""

    def __init__(self):
        self.n, self.rows = 0, np.zeros((2, 1024), np.int64)

    def add(self, kind: int, sums: list[int]) -> None:
        end = self.n + len(sums)
        if end > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros((2, max(end, self.n)), np.int64)], 1)
        self.rows[0, self.n : end], self.rows[1, self.n : end] = kind, sums
        self.n = end

    def keep(self, alive: np.ndarray) -> None:
        rows = self.rows[:, : self.n]
        self.rows = rows[:, alive[rows[0]]]
        self.n = self.rows.shape[1]

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[0, : self.n], self.rows[1, : self.n]


class LocalSearch:
    """Moves and swaps between underfull bins, each of which raises the sum of squared fills, until none is left or the least number of bins is reached.

    Bins with the same lengths are one kind and exchanged together. Shifting
    ``t`` from a bin to another raises the sum if it fits there and ``t`` is
    above 0 and above what the giver holds more. A kind that was tried against
    all others, as giver and as taker, is tried again only against kinds that
    are new since; the sum of squares rises strictly, so the search ends.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths.astype(np.int64), [list(b) for b in bins], capacity
        self.fill = np.array([self.lengths[b].sum() for b in bins], np.int64)
        self.used, self.total = int((self.fill > 0).sum()), int(self.fill.sum())
        self.kinds: dict[tuple[int, ...], int] = {}
        self.shapes: list[tuple[int, ...]] = []
        self.held: list[list[int]] = []
        self.kind_fill, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ones, self.twos = _Sums(), _Sums()
        self.listed: set[int] = set()
        self.open: list[tuple[int, int]] = []
        self.waiting: set[int] = set()

    def _sums(self, kind: int) -> tuple[list[int], list[int]]:
        """Distinct lengths of a kind, and distinct sums of two of its pieces."""
        shape = self.shapes[kind]
        ones = sorted(set(shape))
        twos = {x + y for k, x in enumerate(ones) for y in ones[k + 1 :]} | {2 * x for x in ones if shape.count(x) > 1}
        return ones, sorted(twos)

    def _wait(self, kind: int) -> None:
        if kind not in self.waiting:
            self.waiting.add(kind)
            heapq.heappush(self.open, (int(self.kind_fill[kind]), kind))

    def _place(self, b: int) -> None:
        """Count a bin to its kind; full and empty bins have none, as no shift with them raises the sum."""
        if not 0 < self.fill[b] < self.capacity:
            return
        shape = tuple(sorted(self.lengths[self.bins[b]].tolist()))
        kind = self.kinds.setdefault(shape, len(self.shapes))
        if kind == len(self.shapes):
            self.shapes.append(shape)
            self.held.append([])
            if kind == len(self.count):
                self.kind_fill, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.kind_fill, self.count))
            self.kind_fill[kind] = self.fill[b]
        if kind not in self.listed:
            self.listed.add(kind)
            ones, twos = self._sums(kind)
            self.ones.add(kind, [0, *ones])
            self.twos.add(kind, twos)
        self.held[kind].append(b)
        self.count[kind] += 1
        if self.count[kind] <= 2:
            self._wait(kind)

    def _best(self, kind: int) -> tuple[int, int, int, int] | None:
        """(giver, taker, sum given, sum taken back) of the shift with this kind that raises the sum of squares most."""
        n = len(self.shapes)
        fills, there = self.kind_fill[:n], self.count[:n] > 0
        there[kind] = self.count[kind] > 1
        own = int(self.kind_fill[kind])
        room = np.where(there, self.capacity - fills, -1)
        above = np.maximum(own - fills, 0)
        below = np.where(there, np.maximum(fills - own, 0), self.capacity)
        (k1, s1), (k2, s2) = self.ones.columns(), self.twos.columns()
        mine, pairs = self._sums(kind)
        top, found = 0, None

        def look(t: np.ndarray, least: np.ndarray, most, rows: np.ndarray, back: bool, fixed: int, sums: np.ndarray) -> None:
            nonlocal top, found
            where = np.flatnonzero((t > least) & (t <= most))
            if len(where):
                apart = own - fills[rows[where]]
                gain = t[where] * (t[where] + (apart if back else -apart))
                at = int(np.argmax(gain))
                if gain[at] > top:
                    top, other, s = int(gain[at]), int(rows[where[at]]), int(sums[where[at]])
                    found = (other, kind, s, fixed) if back else (kind, other, fixed, s)

        room1, above1, below1 = room[k1], above[k1], below[k1]
        room2, above2, below2 = room[k2], above[k2], below[k2]
        for x in mine:
            look(x - s1, above1, room1, k1, False, x, s1)
            look(x - s2, above2, room2, k2, False, x, s2)
            look(s2 - x, below2, self.capacity - own, k2, True, x, s2)
        # Two for none is no step of the method: rows of no piece give and take nothing here.
        lone = s1 > 0
        for x in pairs:
            look(x - s1, above1, np.where(lone, room1, -1), k1, False, x, s1)
        for x in [0, *mine, *pairs]:
            look(s1 - x, below1, self.capacity - own, k1, True, x, s1)
        return found

    def _pieces(self, b: int, size: int) -> list[int]:
        """One piece of a bin, or else two, of this summed length."""
        if not size:
            return []
        first = {int(self.lengths[i]): i for i in self.bins[b]}
        if size in first:
            return [first[size]]
        for i in self.bins[b]:
            mate = first.get(size - int(self.lengths[i]), i)
            if mate != i:
                return [i, mate]
        raise ValueError("no pieces of this length")

    def _shift(self, giver: int, taker: int, out: int, back: int) -> None:
        """Apply to as many pairs of bins of the two kinds as there are."""
        times = len(self.held[giver]) // 2 if giver == taker else min(len(self.held[giver]), len(self.held[taker]))
        changed = []
        for _ in range(times):
            a, b = self.held[giver].pop(), self.held[taker].pop()
            gone, come = self._pieces(a, out), self._pieces(b, back)
            self.bins[a] = [i for i in self.bins[a] if i not in gone] + come
            self.bins[b] = [i for i in self.bins[b] if i not in come] + gone
            self.fill[a] += back - out
            self.fill[b] += out - back
            self.used -= not self.fill[a]
            changed += [a, b]
        self.count[giver] -= times
        self.count[taker] -= times
        for b in changed:
            self._place(b)
        if len(self.listed) > 64 and 2 * np.count_nonzero(self.count) < len(self.listed):
            alive = self.count > 0
            self.ones.keep(alive)
            self.twos.keep(alive)
            self.listed = set(np.flatnonzero(alive).tolist())

    def _least(self) -> bool:
        return self.total > (self.used - 1) * self.capacity

    def run(self) -> list[list[int]]:
        if not self._least():
            for b in range(len(self.bins)):
                self._place(b)
        while self.open and not self._least():
            kind = heapq.heappop(self.open)[1]
            self.waiting.discard(kind)
            if self.count[kind] and (found := self._best(kind)):
                self._wait(kind)
                self._shift(*found)
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (they need ``salt`` and ``length``)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k, items in enumerate(pack(lengths, capacity)):
            sizes = lengths[items]
            sequence[items] = (int(rows["grp"].iloc[0]) << 32) + k
            offset[items] = np.cumsum(sizes) - sizes
        return rows.drop(columns=["grp", "salt"]).assign(sequence_id=sequence, offset=offset)

    kept = [f for f in pieces.schema if f.name != "salt"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("grp", F.pmod(F.col("salt"), F.lit(groups)))
    return dealt.repartition(groups, "grp").groupBy("grp").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(tokenized_pieces(docs, file, capacity, end_id), "pieces"), capacity, group_pieces)


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocab.path(vocab.WORD_BPE))
