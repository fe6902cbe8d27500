"""Columnar word handling inside tasks: Arrow batches in, numpy arrays out.

Words are runs of characters other than space and the controls 9 to 13; only
A-Z is lower-cased. Tasks handle a few megabytes of text at a time, so their
memory does not depend on the number of rows in an Arrow batch; one text is
never split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 6 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(length) // size
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def map_slices(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, column: str | None = "text"
) -> DataFrame:
    """Run ``work`` on slices of ``df``, or on its Arrow batches if no column
    is long (None); a slice may give any number of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column) if column else batches:
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(task, schema)


def bounded_sample(rows: DataFrame, limit: int, column: str, most_bytes: int) -> DataFrame:
    """``(column)``: at most ``limit`` distinct values of a text column with at
    most ``most_bytes`` together (but one at least), drawn by their hash, so that
    the same come out whatever the partitioning and however often each occurs.

    The hash is first cut where about twice ``limit`` distinct values pass. Only
    hashes and sizes of these reach the driver; the values stay distributed.
    """
    drawn = F.xxhash64(column)
    rows = rows.where(F.col(column).isNotNull()).select(column, drawn.alias("_drawn"))
    n = rows.agg(F.approx_count_distinct("_drawn", 0.02)).first()[0]
    if n > 2 * limit:
        rows = rows.where(F.col("_drawn") < int((2 * limit / n - 0.5) * 2.0**64))
    sized = rows.groupBy("_drawn").agg(F.max(F.octet_length(column)).alias("size")).orderBy("_drawn").limit(limit).collect()
    total, cut = 0, None
    for r in sized:
        total += r["size"]
        if cut is not None and total > most_bytes:
            break
        cut = r["_drawn"]
    if cut is None:
        return rows.select(column)
    return rows.where(F.col("_drawn") <= cut).groupBy("_drawn").agg(F.min(column).alias(column)).select(column)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in the one column of ``gone``; a
    null doc_id stays. The column gets a name that ``docs`` does not have."""
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    listed = gone.toDF(name).distinct()
    return docs.join(listed, docs["doc_id"].cast("long") == listed[name], "left_anti")


@dataclass
class Words:
    """Words of several texts: text k has the codes ``codes[starts[k]:starts[k + 1]]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of the vocabulary, the same in every task."""
        digest = xxhash.xxh3_64_intdigest
        data, ends = text_bytes(self.vocabulary)
        data, ends = data.tobytes(), ends.tolist()
        return np.fromiter((digest(data[a:b]) for a, b in zip(ends[:-1], ends[1:])), np.uint64, len(ends) - 1)


def plain(column: pa.Array) -> pa.Array:
    """Null texts are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins in them."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(texts: pa.Array) -> pa.Array:
    data, ends = text_bytes(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data]))


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    texts = plain(texts)
    if lower:
        texts = ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # the split leaves an empty string at either end of a padded text
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not filled.all():
        owner = np.repeat(np.arange(len(texts)), counts)
        counts = np.bincount(owner[filled], minlength=len(texts))
        flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        coded.dictionary,
    )


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words (over all texts in a row)."""
    n = max(0, len(word_hash) - width + 1)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h *= _BASE
        h += word_hash[k : k + n]
    return mixed(h)


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and where each set starts.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; a text without words has an empty set.
    """
    token = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts, starts = words.counts, words.starts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(int(out_starts[-1]), np.uint64)
    windows = window_hashes(token, width)
    long_texts = counts >= width
    owner = np.repeat(np.arange(len(counts)), np.where(long_texts, sizes, 0))
    at = np.arange(int(np.where(long_texts, sizes, 0).sum()))
    first = np.concatenate([[0], np.cumsum(np.where(long_texts, sizes, 0))])[:-1]
    inside = at - first[owner]
    out[out_starts[owner] + inside] = windows[starts[owner] + inside]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            h = np.full(len(short), n, np.uint64)
            for k in range(n):
                h *= _BASE
                h += token[starts[short] + k]
            out[out_starts[short]] = mixed(h)
    for a, b in zip(out_starts[:-1].tolist(), out_starts[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[out_starts[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[out_starts]
