"""Operator 11, ranked lexical search with hashed max-sketches.

A term adds ``w * impact`` to a document's score; the impact rises with the
term's occurrences and falls with the document's length. Each document folds
the occurrences of all its terms into hashed coordinates and keeps the maximum
in each: ``ROWS`` rows with a hash each, of 2 to 4 coordinates per distinct term
whatever the length, one byte each (255 stands for all from 255 on). As the
impact only rises with the occurrences, the least of a term's coordinates, put
through the document's own impact formula, is an upper bound of its impact, and
the sum over an item's terms bounds the score: for all items of a block at once.

1. One pass over the texts: sketches, N, L, and how many documents hold each
   term of the items.
2. The highest bounds of each item, found in two steps by item, are rescored
   exactly. Their k-th score is the item's threshold.
3. Documents of a bound that reaches the threshold and that are not yet scored
   are rescored, in descending order of bound within a task, until the threshold,
   which rises on the way, is above the bound. What is left out cannot be among
   the k.

Items come in blocks of at most ``BLOCK_TERMS`` distinct terms; each block reads
the sketches (a fraction of the texts) twice and the texts of its candidates.
All numbers are 64-bit integers as in the definition of the score; products
that would pass 64 bits are worked out with unbounded ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinedge.llm.words import Words, mixed, plain, text_bytes, text_slices
from twinedge.scratch import materialise

ROWS = 3
SATURATED = 255
BLOCK_TERMS = 4096
FIRST_BATCH = 4
"""The first batch of an item is this many times as large as what is asked for."""

SCORED = "doc_id long, item int, score long, bound long"

# The bytes that part terms (controls, space and ASCII signs), and A-Z lower-cased.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def terms_of(texts: pa.Array) -> Words:
    """Runs of letters, digits and characters beyond ASCII; only A-Z is lower-cased."""
    texts = plain(texts)
    data, ends = text_bytes(texts)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_FOLD[data]))
    split = pc.ascii_split_whitespace(folded)
    flat = split.flatten()
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not filled.all():
        owner = np.repeat(np.arange(len(texts)), counts)
        counts = np.bincount(owner[filled], minlength=len(texts))
        flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), coded.dictionary
    )


def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, times)`` of every distinct term of a document; terms are hashes."""
    size = max(1, len(words.vocabulary))
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    used, times = np.unique(owner * size + words.codes, return_counts=True)
    hashes = words.hashes() if len(words.codes) else np.zeros(0, np.uint64)
    return used // size, hashes[used % size], times


def coordinate(terms: np.ndarray, row: int, bits: np.ndarray | int) -> np.ndarray:
    """Where a term falls in a row of ``2 ** bits`` coordinates."""
    spread = mixed(terms + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return (spread >> (np.uint64(64) - np.asarray(bits, np.uint64))).astype(np.int64)


def impact(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * norm)


def norms(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The length norm of documents of ``n_terms`` terms."""
    return np.array([10 + 90 * n * n_docs // all_terms for n in n_terms.tolist()], np.int64)


@dataclass
class Queries:
    """A block of items: distinct terms, and the terms of each item as positions."""

    terms: np.ndarray
    items: list[np.ndarray]
    ids: list[int | None]


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once; rows that repeat an item id are one item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, term, _ = occurrences(terms_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), pa.array(term.view(np.int64))], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "item_id long, term long").distinct()


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Items in blocks; the driver holds one block at a time. An item of more
    than ``BLOCK_TERMS`` terms is a block of its own."""
    rows = _item_terms(items).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    held: list[tuple[int | None, np.ndarray]] = []
    known: set[int] = set()

    def block() -> Queries:
        terms = np.array(sorted(known), np.int64).view(np.uint64)
        terms.sort()
        return Queries(terms, [np.searchsorted(terms, own) for _, own in held], [i for i, _ in held])

    for row in materialise(rows, "search-items").toLocalIterator():
        own = {*row["terms"]}
        if held and len(known | own) > BLOCK_TERMS:
            yield block()
            held, known = [], set()
        known |= own
        held.append((row["item_id"], np.array(row["terms"], np.int64).view(np.uint64)))
    if held:
        yield block()


def sketches(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``(doc_id, n_terms, bits, sketch, found, held)`` of documents that have
    terms; the last two, in one row of each slice, count the documents of the
    slice that hold each of ``terms`` (by position)."""
    schema = "doc_id long, n_terms long, bits int, sketch binary, found array<int>, held array<long>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = terms_of(batch.column("text"))
            owner, term, times = occurrences(words)
            sizes = np.bincount(owner, minlength=batch.num_rows)
            bits = np.ceil(np.log2(np.maximum(2 * sizes, 2))).astype(np.int64)
            width = (1 << bits) * ROWS
            first = np.cumsum(width) - width
            cells = np.zeros(int(width.sum()), np.uint8)
            capped = np.minimum(times, SATURATED).astype(np.uint8)
            for row in range(ROWS):
                np.maximum.at(cells, first[owner] + (row << bits[owner]) + coordinate(term, row, bits[owner]), capped)
            keep = np.flatnonzero(sizes)
            if not len(keep):
                continue
            at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
            asked = at[terms[at] == term] if len(terms) else np.zeros(0, np.int64)
            found, held = np.unique(asked, return_counts=True)
            raw = cells.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(keep)), pa.array(words.counts[keep]), pa.array(bits[keep], pa.int32()),
                    pa.array([raw[first[k] : first[k] + width[k]] for k in keep], pa.binary()),
                    pa.array([found] + [None] * (len(keep) - 1), pa.list_(pa.int32())), pa.array([held] + [None] * (len(keep) - 1), pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_terms", "bits", "sketch", "found", "held"],
            )

    return docs.mapInArrow(task, schema)


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """As :func:`sketches`, for a later block: only (found, held)."""
    return sketches(docs, terms).where("found IS NOT NULL").select("found", "held")


def _held(rows: DataFrame, n: int) -> np.ndarray:
    """How many documents hold each of the block's terms (a row per term)."""
    both = F.explode(F.arrays_zip("found", "held")).alias("p")
    counts = rows.where("found IS NOT NULL").select(both).groupBy("p.found").agg(F.sum("p.held").alias("n"))
    out = np.zeros(n, np.int64)
    for r in counts.collect():
        out[r["found"]] = r["n"]
    return out


@dataclass
class Search:
    """What the tasks need of a block: terms, weights, items, the corpus' size."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[np.ndarray]
    n_docs: int
    all_terms: int

    def bounds(self, sketch: list[bytes], bits: int, n_terms: np.ndarray) -> np.ndarray:
        """Upper bounds (item, document) of documents whose sketches are equally wide."""
        cells = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), ROWS, 1 << bits)
        times = reduce(np.minimum, [cells[:, row, coordinate(self.terms, row, bits)] for row in range(ROWS)]).T
        norm = norms(n_terms, self.n_docs, self.all_terms)
        upper = np.zeros(times.shape, np.int64)
        term, doc = np.nonzero(times)
        seen = times[term, doc].astype(np.int64)
        # whatever a saturated coordinate stands for, no impact reaches a million
        upper[term, doc] = self.weights[term] * np.where(seen == SATURATED, 1_000_000, impact(seen, norm[doc]))
        return np.stack([upper[own].sum(axis=0) for own in self.items])

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact parts: (document, term position, weighted impact)."""
        owner, term, times = occurrences(words)
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        hit = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        owner, at, times = owner[hit], at[hit], times[hit]
        norm = norms(words.counts, self.n_docs, self.all_terms)
        return owner, at, self.weights[at] * impact(times, norm[owner])


def _bounded(index: DataFrame, search, cut: np.ndarray | None, k: int) -> DataFrame:
    """``(doc_id, item, bound)``: without ``cut`` the ``k`` highest bounds of each
    item and task, else all that reach the item's cut (and are above 0)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            for b in np.unique(bits).tolist():
                own = batch.filter(pa.array(bits == b))
                # bounds of this many documents take a few tens of megabytes
                step = max(1, min(512, (1 << 24) // (ROWS << b)))
                for at in range(0, own.num_rows, step):
                    yield b, own.slice(at, step)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = search.value
        best: list[list[tuple[int, int | None]]] = [[] for _ in held.items]
        lowest = np.zeros(len(held.items), np.int64)
        for bits, part in slices(batches):
            upper = held.bounds(part.column("sketch").to_pylist(), bits, part.column("n_terms").to_numpy())
            item, doc = np.nonzero((upper >= np.maximum(1, cut)[:, None]) if cut is not None else upper > lowest[:, None])
            if not len(item):
                continue
            found, ids = upper[item, doc], part.column("doc_id").take(pa.array(doc))
            if cut is not None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int32()), pa.array(found)], names=["doc_id", "item", "bound"])
                continue
            begins = np.flatnonzero(np.diff(item, prepend=-1))
            ids = ids.to_pylist()
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(item)]):
                own = best[item[a]]
                top = a + np.argsort(-found[a:b], kind="stable")[:k]
                own.extend((int(found[x]), ids[x]) for x in top.tolist())
                own.sort(key=lambda x: -x[0])
                del own[k:]
                if len(own) == k:
                    lowest[item[a]] = own[-1][0]
        rows = [(i, n, bound) for n, own in enumerate(best) for bound, i in own]
        if cut is None and rows:
            ids, item, bound = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int32()), pa.array(bound, pa.int64())], names=["doc_id", "item", "bound"])

    return index.select("doc_id", "n_terms", "bits", "sketch").mapInArrow(task, "doc_id long, item int, bound long")


def _top(rows: DataFrame, k: int, by: str) -> DataFrame:
    """The ``k`` best rows of each item: first among shares of its rows, then of all."""

    def ranked(rows: DataFrame, *keys: str | Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return ranked(ranked(rows.withColumn("share", F.pmod(F.hash("doc_id"), F.lit(64))), "item", "share"), "item").drop("share")


def _rescored(docs: DataFrame, candidates: DataFrame, search, cut: np.ndarray, k: int) -> DataFrame:
    """``(doc_id, item, score, bound)`` of the candidates' texts. A task goes
    through a slice's candidates by descending bound and leaves an item when its
    ``k``-th best so far, or ``cut``, is above the bound."""
    # rows of one doc_id share the highest of their bounds, and are all rescored
    pairs = candidates.groupBy("doc_id", "item").agg(F.max("bound").alias("bound"))
    asked = pairs.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_list(F.struct("item", "bound")).alias("asked"))
    # Spark broadcasts the candidates only if their table is small
    rows = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select(
        "doc_id", "text", F.col("asked.item").alias("items"), F.col("asked.bound").alias("bounds")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = search.value
        best = [[] for _ in held.items]
        lowest = cut.copy()
        for batch in text_slices(batches):
            doc, term, part = held.scores(terms_of(batch.column("text")))
            upto = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("items")).to_numpy())
            item, bound = batch.column("items").flatten().to_numpy(), batch.column("bounds").flatten().to_numpy()
            out = []
            value = np.zeros(len(held.terms), np.int64)
            by_doc = np.argsort(-bound, kind="stable")
            for x in by_doc.tolist():
                i, d = int(item[x]), int(owner[x])
                if bound[x] < lowest[i]:
                    continue
                own = slice(upto[d], upto[d + 1])
                value[term[own]] = part[own]
                score = int(value[held.items[i]].sum())
                value[term[own]] = 0
                if score > 0 and score >= lowest[i]:
                    out.append((d, i, score, int(bound[x])))
                    best[i].append(score)
                    if len(best[i]) >= 2 * k:
                        best[i] = sorted(best[i], reverse=True)[:k]
                        lowest[i] = max(lowest[i], best[i][-1])
            if out:
                d, i, score, upper = (np.array(c, np.int64) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(d)), pa.array(i, pa.int32()), pa.array(score), pa.array(upper)],
                    names=["doc_id", "item", "score", "bound"],
                )

    return rows.mapInArrow(task, SCORED)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item
    with a score above 0; equal scores by ascending doc_id, null ids last.

    A null or empty text, or one without terms, is no document; an item without
    terms has no rows. Rows that repeat an item id are one item with the terms
    of all its texts, and rows with a null item id likewise. Repeated rows of
    ``docs`` are documents of their own, also with one doc_id. Extra columns of
    either table are ignored.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = None
    out = []
    for block in query_blocks(items):
        if index is None:
            index = materialise(sketches(rows, block.terms), "sketches")
            total = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("l")).first()
            holds = _held(index, len(block.terms))
        else:
            holds = _held(term_counts(rows, block.terms), len(block.terms))
        n_docs, all_terms = total["n"], total["l"] or 0
        if not n_docs:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in holds], np.int64)
        search = spark.sparkContext.broadcast(Search(block.terms, weights, block.items, n_docs, all_terms))
        first = materialise(_top(_bounded(index, search, None, FIRST_BATCH * k), FIRST_BATCH * k, "bound"), "first-bounds")
        cut = np.zeros(len(block.items), np.int64)
        scored = materialise(_rescored(rows, first, search, cut, k), "first-scores")
        kth = scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == k)
        for r in kth.select("item", "score").collect():  # a row per item of the block
            cut[r["item"]] = r["score"]
        rest = _unscored(_bounded(index, search, cut, k), first)
        more = _rescored(rows, materialise(rest, "more-bounds"), search, cut, k)
        best = _top(scored.select("doc_id", "item", "score").unionAll(more.select("doc_id", "item", "score")), k, "score")
        names = spark.createDataFrame([*enumerate(block.ids)], "item int, item_id long")
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], schema)


def _unscored(bounds: DataFrame, first: DataFrame) -> DataFrame:
    done = first.select(F.col("item").alias("of"), F.col("doc_id").alias("done"))
    return bounds.join(done, (F.col("item") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("done")), "left_anti")
