"""Operator 4, benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so one MinHash signature for all
documents would lose small items in long documents. Documents are therefore
partitioned by size (number of shingles, powers of two) and each partition gets
its own sketch resolution: a one-permutation MinHash whose bins number twice
the partition's upper size. An item inside a document then shows most of its
shingles as bin minima of that document, whatever the document's length: a
shingle is its bin's minimum with probability above 0.78, so an item with k
contained shingles is missed with probability below 0.22^k. Pairs that share
``least_hits`` bin minima (1, or none for items of under ``sure`` shingles,
which are looked up directly) are verified by exact containment of the full
shingle sets, in the same task, which has both sets at hand: no shuffle.

The items' index is sent to the tasks in blocks of at most ``BLOCK_SHINGLES``
distinct shingles, read one block at a time, whatever the number of items. Rows
of the benchmark that repeat an item_id are one item before blocks are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import map_slices, mixed, shingle_sets, text_slices, window_hashes, without, words_of
from twinedge.scratch import materialise

WIDTH = 5
CONTAINMENT = 0.75
BLOCK_SHINGLES = 1 << 20
SURE = 8
"""Items with fewer contained shingles than this are looked up without a sketch."""

_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash of each set at its size partition's resolution.

    Returns which shingles are the minimum of their bin, as (set, shingle).
    """
    sizes = np.diff(starts)
    bits = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1) + 1)).astype(np.int64) + 1, 0)
    bins = np.where(sizes > 0, 1 << bits, 0)
    first = np.concatenate([[0], np.cumsum(bins)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    value = mixed(shingles)
    at = first[owner] + (value & (bins[owner] - 1).astype(np.uint64)).astype(np.int64)
    least = np.full(int(first[-1]), _FREE)
    np.minimum.at(least, at, value)
    minimum = least[at] == value
    return owner[minimum], shingles[minimum]


class ItemBlock:
    """Distinct shingles of one block of test items, sorted, with their items.

    Item k of the block has the id ``ids[k]``, ``sizes[k]`` shingles and words
    in runs of ``widths[k]``.
    """

    def __init__(self, shingles: np.ndarray, items: np.ndarray, ids: list[int], sizes: list[int], widths: list[int]):
        order = np.argsort(shingles, kind="stable")
        self.ids = np.array(ids, np.int64)
        self.owners, listed = items[order], shingles[order]
        self.values, self.first = np.unique(listed, return_index=True)
        self.end = np.append(self.first[1:], len(listed))
        self.sizes = sizes
        self.widths = widths
        self.mask = np.zeros(1 << 22, bool)
        self.mask[(self.values >> np.uint64(42)).astype(np.int64)] = True

    def find(self, sets: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, item) for every shingle that an item has too."""
        near = self.mask[(shingles >> np.uint64(42)).astype(np.int64)]
        sets, shingles = sets[near], shingles[near]
        at = np.minimum(np.searchsorted(self.values, shingles), max(0, len(self.values) - 1))
        hit = self.values[at] == shingles if len(self.values) else np.zeros(0, bool)
        sets, at = sets[hit], at[hit]
        many = self.end[at] - self.first[at]
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(sets, many), self.owners[np.repeat(self.first[at], many) + inside]


def _item_rows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, width, own, sets)``: an item with the distinct shingle sets of
    its texts of five words or more, and one for each distinct shorter text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        shingles, starts = shingle_sets(words, WIDTH)
        sizes, n = np.diff(starts), words.counts
        keep = np.flatnonzero(sizes > 0)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("item_id").take(pa.array(keep)),
                pa.array(np.minimum(n[keep], WIDTH)),
                pa.array([shingles[starts[k] : starts[k + 1]].tobytes() for k in keep], pa.binary()),
            ],
            names=["item_id", "width", "shingles"],
        )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = map_slices(rows.where("item_id IS NOT NULL"), work, "item_id long, width long, shingles binary")
    # a text of fewer than five words is looked for by itself
    own = F.when(F.col("width") < WIDTH, F.col("shingles"))
    return found.groupBy("item_id", "width", own.alias("own")).agg(F.collect_set("shingles").alias("sets"))


def _blocks(benchmark: DataFrame) -> Iterator[ItemBlock]:
    """Items in blocks; the driver holds one block at a time."""
    ids, sizes, widths, shingles = [], [], [], []
    held = 0

    def block() -> ItemBlock:
        return ItemBlock(np.concatenate(shingles), np.repeat(np.arange(len(ids)), sizes), ids, sizes, widths)

    for row in materialise(_item_rows(benchmark), "benchmark-items").toLocalIterator():
        values = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in row["sets"]]))
        if held and held + len(values) > BLOCK_SHINGLES:
            yield block()
            ids, sizes, widths, shingles, held = [], [], [], [], 0
        ids.append(row["item_id"])
        sizes.append(len(values))
        widths.append(row["width"])
        shingles.append(values)
        held += len(values)
    if held:
        yield block()


def _short_windows(words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words, as items of so few words have them."""
    token = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    values = window_hashes(token, width)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    n = len(values)
    inside = owner[:n] == owner[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    return owner[:n][inside], values[inside]


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` for every document
    that holds at least ``containment`` of the distinct word shingles of an item.

    An item of fewer than five words is its whole sequence and must occur as
    such. Null texts, empty texts and items without words match nothing; rows
    without an item id are no items; repeated rows of a document give one row.
    Rows that repeat an item id are one item: the shingles of its texts are
    pooled, but each text of fewer than five words stands for the item itself.
    Extra columns of either table are ignored.
    """
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for block in _blocks(benchmark):
        shipped = spark.sparkContext.broadcast(block)
        found.append(rows.mapInArrow(_searcher(shipped, containment), schema))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found).distinct()


def _searcher(shipped, containment: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        short = sorted({w for w in block.widths if w < WIDTH})
        direct = np.array([i for i, n in enumerate(block.sizes) if n * containment < SURE], np.int64)
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            shingles, starts = shingle_sets(words, WIDTH)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            sets, items = block.find(*sketch(shingles, starts))
            pairs = {*zip(sets.tolist(), items.tolist())}
            if len(direct):
                sets, items = block.find(owner, shingles)
                small = np.isin(items, direct)
                pairs |= {*zip(sets[small].tolist(), items[small].tolist())}
            # verification: the full sets of the candidates' documents
            doubtful = np.zeros(len(starts) - 1, bool)
            doubtful[[k for k, _ in pairs]] = True
            whole = doubtful[owner]
            shared: dict[tuple[int, int], int] = {}
            for pair in zip(*(x.tolist() for x in block.find(owner[whole], shingles[whole]))):
                if pair in pairs:
                    shared[pair] = shared.get(pair, 0) + 1
            for width in short:
                for k, item in {*zip(*(x.tolist() for x in block.find(*_short_windows(words, width))))}:
                    if block.widths[item] == width:
                        shared[k, item] = 1
            out = [(k, i, block.sizes[i], n) for (k, i), n in shared.items() if n >= containment * block.sizes[i]]
            if out:
                at, item, size, n = (np.array(x, np.int64) for x in zip(*sorted(out)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(block.ids[item]), pa.array(size), pa.array(n), pa.array(n / size)],
                    names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

    return task


def without_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no test item; rows and columns as they are.

    Null and empty texts hold nothing and stay, as does a null doc_id; rows that
    repeat a doc_id stay or go together."""
    return without(docs, contained_items(docs, benchmark, containment).select("doc_id"))
