"""Operator 1, packing as a cutting-stock problem solved by column generation.

Documents are cut at multiples of the sequence length; the full pieces are
sequences by themselves and only the rests have to be combined. Their lengths
are counted in classes of ``UNIT`` tokens: a histogram of at most
``length / UNIT`` numbers, whatever the size of the corpus. Over it the driver
solves the linear program "fewest sequences that hold all pieces", whose
columns are patterns (how many pieces of each class share a sequence). It
starts with greedy patterns; a knapsack dynamic program over the dual prices
finds the pattern that helps most, until none helps. The solution is
rounded down, and what is left (fewer items than classes times pieces per
pattern) is filled greedily.

Pieces are ranked within their class, by task and place in the task: only one
count per task and class is added up, no class is sorted in one place. A
pattern with its number of copies covers a range of ranks of each of its
classes, so each piece looks up its own sequence in a plan of constant size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinedge.llm.tokens import tokenizer
from twinedge.llm.words import map_slices, text_slices
from twinedge.scratch import materialise

LENGTH = 2048
UNIT = 8
GAP = 0.0005
"""Patterns are good enough when no others could save a larger share of the sequences."""

MAX_COLUMNS = 4000
"""Columns priced at most; stopping early costs padding, never a piece."""


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of classes with the highest total price."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, room, "right"))
        value[room] = value[room - 1]
        if fits:
            worth = value[room - sizes[:fits]] + prices[:fits]
            k = int(np.argmax(worth))
            if worth[k] > value[room] + 1e-12:
                value[room], choice[room] = worth[k], k
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Fill from the largest class down, until that class or another runs out,
    and so on. Each pattern ends one class, so the patterns form a basis."""
    left, columns = demand.astype(float), []
    alive = np.ones(len(sizes), bool)
    while alive.any():
        room, pattern = capacity, np.zeros(len(sizes))
        for k in np.flatnonzero(alive)[::-1]:
            pattern[k] = room // sizes[k]
            room -= int(pattern[k] * sizes[k])
        taken = pattern > 0
        ratio = np.where(taken, left / np.where(taken, pattern, 1), np.inf)
        ended = int(np.argmin(ratio))
        left = np.maximum(left - ratio[ended] * pattern, 0)
        alive[ended] = False
        columns.append(pattern)
    return np.array(columns).T


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear program's basic patterns (rows) and how often each is used.

    Prices are smoothed towards those of the best bound so far, which keeps
    them from swinging; the bound ``sequences / value of the best pattern``
    tells how far from the optimum the current patterns can be at most.
    """
    basis = _first_patterns(sizes, demand, capacity)
    needed = demand.astype(float)
    bound, centre = 0.0, np.zeros(len(sizes))
    for _ in range(MAX_COLUMNS):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        total = float(prices @ needed)
        if total - bound <= GAP * total:
            break
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:
            # a class that costs: one of its patterns is better without it
            pattern = basis[:, int(np.argmax(basis[worst]))].copy()
            pattern[worst] -= 1
        else:
            for smooth in (0.7, 0.0):
                trial = smooth * centre + (1 - smooth) * np.maximum(prices, 0)
                value, pattern = _best_pattern(trial, sizes, capacity)
                if value > 0 and (reached := float(trial @ needed) / value) > bound:
                    bound, centre = reached, trial / value
                if float(prices @ pattern) > 1 + 1e-9:
                    break
            else:
                break
        level = np.linalg.solve(basis, np.stack([needed, pattern.astype(float)], axis=1))
        rising = level[:, 1] > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(level[:, 0], 0) / np.where(rising, level[:, 1], 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    return basis.T.round().astype(np.int64), np.linalg.solve(basis, needed)


@dataclass
class Plan:
    """Slots sorted by (class, first rank): pieces of a class with ranks from
    ``rank`` on fill ``each`` places in sequence after sequence from ``sequence`` on."""

    size_class: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray
    sequences: int

    def place(self, size_class: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order within it for each piece."""
        at = np.searchsorted((self.size_class << 48) + self.rank, (size_class << 48) + rank, "right") - 1
        inside = rank - self.rank[at]
        return self.sequence[at] + inside // self.each[at], self.slot[at] + inside % self.each[at]


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns, rounded, for ``histogram[class] = pieces``, classes in units."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    demand = np.array([histogram[int(k)] for k in sizes], np.int64)
    patterns: list[tuple[int, np.ndarray]] = []
    left = demand.copy()
    if len(sizes):
        columns, used = generate_patterns(sizes, demand, capacity)
        for pattern, level in sorted(zip(columns, used), key=lambda x: -x[1]):
            taken = pattern > 0
            copies = min(int(np.floor(level + 1e-6)), int((left[taken] // pattern[taken]).min()) if taken.any() else 0)
            if copies > 0:
                patterns.append((copies, pattern))
                left -= copies * pattern
    while left.any():
        # what rounding left: fill one sequence from the largest class down, as often as that fits
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(pattern[k] * sizes[k])
        taken = pattern > 0
        copies = int((left[taken] // pattern[taken]).min())
        patterns.append((copies, pattern))
        left -= copies * pattern
    rows, sequence = [], 0
    next_rank = dict.fromkeys(sizes.tolist(), 0)
    for copies, pattern in patterns:
        slot = 0
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            rows.append((size, next_rank[size], each, sequence, slot))
            next_rank[size] += copies * each
            slot += each
        sequence += copies
    rows.sort()
    columns = [np.array(x, np.int64) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequence)


def _pieces(docs: DataFrame, file: str | None, length: int) -> DataFrame:
    """Tokenise and cut; number the pieces of each class within the task."""
    unit = UNIT
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size_class int, part int, rank long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(length // unit + 2, np.int64)
        for batch in text_slices(batches):
            ids, starts = tokenizer(file).encode(batch.column("text"))
            tokens = np.diff(starts)
            pieces = -(-tokens // length)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(tokens[doc] - start, length)
            data, at = ids.astype("<u4").tobytes(), starts[:-1][doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
            size_class = -(-size // unit)
            # place among the task's pieces of the same class
            order = np.argsort(size_class, kind="stable")
            ranked = size_class[order]
            first = np.searchsorted(ranked, ranked)
            rank = np.empty(len(doc), np.int64)
            rank[order] = seen[ranked] + np.arange(len(doc)) - first
            seen += np.bincount(size_class, minlength=len(seen))
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                pa.array(tokens[doc]), pa.array(size_class.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(task, schema)


def packed(docs: DataFrame, file: str | None = None, length: int = LENGTH) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row per piece.

    ``file`` is the tokenizer's vocabulary (the public word tokenizer if None).
    A null or empty text is the end id alone, so every row has a piece.
    Repeated rows are packed as often as they stand there; a null doc_id stays
    null. Other columns are ignored. An empty table gives no piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(_pieces(rows, file, length), "pieces")
    counts = materialise(pieces.groupBy("size_class", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # one row per class, of which there are length / UNIT
    histogram = {r["size_class"]: r["n"] for r in counts.groupBy("size_class").agg(F.sum("n").alias("n")).collect()}
    plan = plan_sequences(histogram, length // UNIT)
    earlier = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size_class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        size_class = batch.column("size_class").to_numpy(zero_copy_only=False).astype(np.int64)
        sequence, slot = plan.place(size_class, batch.column("rank").to_numpy(zero_copy_only=False))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"]
        )

    ranked = pieces.join(offsets, ["size_class", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "size_class", (F.col("rank") + F.col("before")).alias("rank")
    )
    placed = map_slices(
        ranked, assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long", None
    )
    # a sequence holds at most `length` pieces
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(sequences, tokens, padding)`` of packed pieces, for reports; a
    sequence whose tokens are a power of two is not padded."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.bit_count("n") == 1
    return filled.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"),
        F.sum(F.when(whole, 0).otherwise(length - F.col("n"))).alias("padding"),
    )
