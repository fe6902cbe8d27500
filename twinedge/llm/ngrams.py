"""Operator 10, language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing,
p(w | c) = n(c, w) / (n(c) + MU) + MU / (n(c) + MU) * p1(w), on words and the end
of a text, which is also the context of a first word. Counts cover all training
texts and are not pruned.

The trie has two levels, split into shards that are built from what Spark has
shuffled to one task and are memory-mapped there:

* level 1, by ranges of the word hash: the sorted hashes, Elias-Fano coded. The
  position of a word is its id, so ids follow the hash order over all shards.
  Its counts are exact, as the unigram score needs them; what goes on to level 2
  is quantised to two bytes;
* level 2, by context: the heads (contexts of the shard), monotone pointers to
  where the successors of each begin, the successors' word ids relative to their
  context, all Elias-Fano coded, and the quantised logarithms of
  n(c, w) / (n(c) + MU). A bigram is looked up from its head by the pointer and
  a successor search for its word in the context's row.

No task, and not the driver, ever holds the vocabulary or the trie. Texts are
turned once into chunks of a few megabytes (distinct words and codes). Chunks
send their distinct words to level 1 and get ids and counts back; then they
send their bigrams, with the texts they stand in, to level 2, and get one sum
per text and shard back. A context with many bigrams is spread over shards by
the next word: its total is known from level 1, so no shard needs all of it.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import text_slices, words_of
from twinedge.scratch import materialise

MU = 100.0
FOLDS, HELD_OUT = 7, 2
SHARD = 1 << 21
"""Words, or bigrams, that a shard receives on average."""
STEPS = 16383
"""Quantisation steps of the root of -log10 of a probability, so that those near 1,
which stand in long repetitions, are told apart finely; 10^-16 is the least."""
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
"""The end of a text; no word holds a line break."""


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers in a memory-mapped file.

    The low bytes of each number are stored as they are; the high part is a bit
    vector in unary. A directory of zero counts per 64 bits finds the numbers
    with a given high part.
    """

    def __init__(self, values: np.ndarray, file):
        values = values.astype(np.uint64)
        self.n = len(values)
        universe = int(values[-1]) + 1 if self.n else 1
        self.width = max(0, (universe // max(1, self.n)).bit_length() + 4) // 8
        self.shift = np.uint64(8 * self.width) if self.width < 8 else np.uint64(0)
        high = (values >> self.shift).astype(np.int64) if self.width < 8 else np.zeros(self.n, np.int64)
        self.highest = int(high[-1]) if self.n else -1
        bits = np.zeros((self.n + self.highest + 2 + 63) // 64 * 64, bool)
        bits[high + np.arange(self.n)] = True
        low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, : self.width]) if self.n else np.zeros((0, self.width), np.uint8)
        self.low = _mapped(low, file)
        self.bits = _mapped(np.packbits(bits, bitorder="little"), file)
        zeros = 64 - bits.reshape(-1, 64).sum(axis=1)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = 64 * np.arange(len(self.zeros)) - self.zeros

    def _end_of(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part of at most ``high``: the place of
        zero number ``high`` in the bit vector, less the zeros before it."""
        inside = (high >= 0) & (high <= self.highest)
        asked = np.where(inside, high, 0)
        word = np.searchsorted(self.zeros, asked, "right") - 1
        rest = asked - self.zeros[word]
        window = self.bits[8 * word[:, None] + np.arange(8)]
        zeros = 8 - _ONES[window]
        upto = np.cumsum(zeros, axis=1)
        byte = (upto <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(asked))
        rest = rest - (upto[rows, byte] - zeros[rows, byte])
        place = 64 * word + 8 * byte + _ZERO_AT[window[rows, byte], rest]
        return np.where(high < 0, 0, np.where(inside, place - asked, self.n))

    def find(self, queries: np.ndarray) -> np.ndarray:
        """Index of each number, or -1: a successor search in its high part."""
        if not self.n:
            return np.full(len(queries), -1)
        queries = queries.astype(np.uint64)
        high = (queries >> self.shift).astype(np.int64) if self.width < 8 else np.zeros(len(queries), np.int64)
        low, end = self._end_of(high - 1), self._end_of(high)
        last = end.copy()
        mask = ~np.uint64(0) if self.width >= 8 else (np.uint64(1) << self.shift) - np.uint64(1)
        wanted = queries & mask
        while True:
            active = low < end
            if not active.any():
                break
            middle = np.where(active, (low + end) // 2, 0)
            less = self._low_part(middle) < wanted
            low = np.where(active & less, middle + 1, low)
            end = np.where(active & ~less, middle, end)
        at = np.minimum(low, self.n - 1)
        return np.where((low < last) & (self._low_part(at) == wanted), low, -1)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The numbers at places that exist: the place of one number ``index`` in
        the bit vector, less the ones before it, is the high part."""
        word = np.searchsorted(self.ones, index, "right") - 1
        rest = index - self.ones[word]
        window = self.bits[8 * word[:, None] + np.arange(8)]
        ones = _ONES[window]
        upto = np.cumsum(ones, axis=1)
        byte = (upto <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(index))
        rest = rest - (upto[rows, byte] - ones[rows, byte])
        high = 64 * word + 8 * byte + _ONE_AT[window[rows, byte], rest] - index
        return (high.astype(np.uint64) << self.shift) | self._low_part(index) if self.width < 8 else self._low_part(index)

    def _low_part(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.width] = self.low[at]
        return out.view(np.uint64).ravel()


_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BYTES.sum(axis=1).astype(np.int64)
_ZERO_AT = np.array([[*np.flatnonzero(row == 0), *[0] * 8][:8] for row in _BYTES])
_ONE_AT = np.array([[*np.flatnonzero(row), *[0] * 8][:8] for row in _BYTES])


class Successors:
    """The deeper level of a trie: the successors of each context in a row.

    ``pointers`` says where the row of each context begins, a monotone sequence.
    Within a row the word ids rise; from row to row they are made to rise by
    adding the last number of the row before (``bases``), so that all rows are
    one Elias-Fano sequence of numbers relative to their context.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, file):
        """``words[i]`` follows ``contexts[i]``; sorted by both, without copies."""
        own, begins = np.unique(contexts, return_index=True)
        ends = np.append(begins[1:], len(contexts)) if len(own) else begins
        last = (words[ends - 1].astype(np.uint64) + np.uint64(1)) if len(own) else np.zeros(0, np.uint64)
        base = np.cumsum(last) - last
        self.heads = EliasFano(own, file)
        self.pointers = EliasFano(np.append(begins, len(contexts)).astype(np.uint64), file)
        self.bases = EliasFano(base, file)
        self.words = EliasFano(words.astype(np.uint64) + np.uint64(1) + np.repeat(base, ends - begins), file)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each (context, word), or -1: from the context's head by its
        pointer to its row, and a successor search for the word there."""
        head = self.heads.find(contexts)
        out = np.full(len(contexts), -1)
        at = np.flatnonzero(head >= 0)
        if len(at):
            head = head[at]
            begin, end = self.pointers.at(head).astype(np.int64), self.pointers.at(head + 1).astype(np.int64)
            found = self.words.find(self.bases.at(head) + words[at].astype(np.uint64) + np.uint64(1))
            out[at] = np.where((found >= begin) & (found < end), found, -1)
        return out


def _mapped(values: np.ndarray, file) -> np.ndarray:
    """Append an array to the file and map it."""
    if not values.size:
        return values
    file.seek(0, os.SEEK_END)
    start = file.tell()
    file.write(values.tobytes())
    file.flush()
    return np.memmap(file, values.dtype, "r", start, values.shape)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays), 1)


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of equal weight side by side, which compress far better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)


def _numbers(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _chunks(docs: DataFrame) -> DataFrame:
    """``(chunk, n_words, n_tokens, texts, words, data)``: texts of a few
    megabytes as their ids, sorted distinct word hashes with training counts,
    and word codes."""
    schema = "chunk long, n_words long, n_tokens long, texts binary, words binary, data binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            real = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            fold = np.array([zlib.crc32(b"%d" % i) % FOLDS for i in ids.tolist()])
            held = real & (fold == HELD_OUT)
            texts = len(ids)
            # each text with its end
            tokens = np.full(len(words.codes) + texts, len(words.vocabulary), np.int64)
            starts = words.starts + np.arange(texts + 1)
            owner = np.repeat(np.arange(texts), words.counts)
            tokens[np.arange(len(words.codes)) + owner] = words.codes
            hashes = np.append(words.hashes(), END)
            values, back = np.unique(hashes, return_inverse=True)
            codes = back[tokens].astype(np.uint32)
            learnt = np.repeat(~held, np.diff(starts))
            counts = np.bincount(codes[learnt], minlength=len(values)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([len(values)]), pa.array([len(tokens)]),
                    pa.array([_packed(ids, real, held, np.diff(starts))], pa.binary()),
                    pa.array([_packed(values, _planes(counts))], pa.binary()), pa.array([_packed(starts, held, _planes(codes))], pa.binary()),
                ],
                names=["chunk", "n_words", "n_tokens", "texts", "words", "data"],
            )
            number += 1

    return docs.mapInArrow(task, schema)


def _level_one(chunks: DataFrame, parts: int) -> DataFrame:
    """``(part, chunk, data, vocabulary, tokens)``: what level 1 answers each
    chunk; a row without chunk holds the part's numbers of words and tokens."""
    bits = parts.bit_length() - 1
    edges = np.array([k << (64 - bits) for k in range(1, parts)], np.uint64) if bits else np.zeros(0, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist()):
                values, counts = _unpacked(data)
                counts = _numbers(counts, np.uint32)
                at = [0, *np.searchsorted(values, edges).tolist(), len(values)]
                blobs = [_packed(values[a:b], _planes(counts[a:b])) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(parts, dtype=np.int32)), pa.array([chunk] * parts), pa.array(blobs, pa.binary())], names=["part", "chunk", "data"]
                )

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpacked(x) for x in rows["data"]]
        values = np.concatenate([v for v, _ in asked])
        counts = np.concatenate([_numbers(c, np.uint32) for _, c in asked]).astype(np.int64)
        distinct, back = np.unique(values, return_inverse=True)
        total = np.bincount(back, counts, len(distinct)).astype(np.int64)
        known = total > 0
        out = []
        with tempfile.TemporaryFile() as file:
            level = EliasFano(distinct[known], file)
            known_counts = _mapped(total[known], file)
            for chunk, (v, _) in zip(rows["chunk"], asked):
                ids = level.find(v)
                count = np.where(ids >= 0, known_counts[np.maximum(ids, 0)] if len(known_counts) else 0, 0)
                out.append((key[0], chunk, _packed(_planes(ids.astype(np.int32)), _planes(count.astype(np.int64))), 0, 0))
        out.append((key[0], None, None, int(known.sum()), int(known_counts.sum())))
        return pd.DataFrame(out, columns=["part", "chunk", "data", "vocabulary", "tokens"]).astype({"chunk": "Int64"})

    asked = chunks.select("chunk", "words").mapInArrow(ask, "part int, chunk long, data binary")
    return asked.groupBy("part").applyInPandas(answer, "part int, chunk long, data binary, vocabulary long, tokens long")


EXACT = 10
"""log2 of the counts below which a code is the count itself."""


def _code(count: np.ndarray) -> np.ndarray:
    """A count of up to 2^63 in two bytes: exact below 1024, then in steps of a
    1024th of a doubling, so that it is off by at most 0.034%."""
    least = 1 << EXACT
    large = least + np.round(least * (np.log2(np.maximum(count, least)) - EXACT))
    return np.where(count < least, count, large).astype(np.uint16)


def _count(code: np.ndarray) -> np.ndarray:
    code, least = code.astype(np.float64), 1 << EXACT
    return np.where(code < least, code, 2.0 ** (EXACT + (code - least) / least))


def _spread(context: np.ndarray, word: np.ndarray, count: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a bigram; a context of many bigrams has several."""
    fan = 1 + count // SHARD * 4
    part = (word % fan).astype(np.uint64)
    x = (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (part * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def scored(docs: DataFrame, mu: float = MU) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    a row for each input row.

    Texts whose id is in the held-out fold are scored but not learnt from; a
    null id is not held out. A null or empty text is its end alone. Repeated
    rows count as often as they stand there. ``base_score`` is the add-one
    unigram score, ``score`` the model's log10 probability. Words never learnt
    have the add-one share of an unseen word. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialise(_chunks(rows), "lm-chunks")
    size = chunks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    parts = 1 << max(0, int((size["words"] or 0) // SHARD).bit_length())
    shards = 1 + int((size["tokens"] or 0) // SHARD)
    words = materialise(_level_one(chunks, parts), "lm-words")
    # a row per part, of which there is one per two million words
    totals = {r["part"]: (r["vocabulary"], r["tokens"]) for r in words.where("chunk IS NULL").collect()}
    first = np.cumsum([0, *(totals.get(k, (0, 0))[0] for k in range(parts))])
    vocabulary, learnt = int(first[-1]), sum(t for _, t in totals.values())
    if vocabulary >= 1 << 32:
        raise ValueError(f"{vocabulary} distinct words do not fit the 32 bits of a word in a bigram")
    floor = float(learnt + vocabulary + 1)

    def ask(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        starts, held, codes = _unpacked(chunk["data"].iloc[0])
        codes = _numbers(codes, np.uint32)
        ids, counts = [], []
        for part, data in sorted(zip(answers["part"], answers["data"])):
            local, count = _unpacked(data)
            local = _numbers(local, np.int32).astype(np.int64)
            ids.append(np.where(local >= 0, local + first[part], vocabulary))
            counts.append(_numbers(count, np.int64))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        texts = len(starts) - 1
        owner = np.repeat(np.arange(texts), np.diff(starts))
        known = np.bincount(owner, (counts > 0)[codes], texts).astype(np.int64)
        base = np.bincount(owner, np.log10((counts[codes] + 1) / floor), texts)
        # the context of a first word is the end of a text: the last token of each
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts[:-1]] = codes[starts[1:] - 1]
        learnt_from = ~held[owner]
        context, word = ids[before], ids[codes]
        shard = _spread(context, word, counts[before], shards)
        pair = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        order = np.lexsort((pair, shard))
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        out = []
        for k in range(shards):
            own = order[edge[k] : edge[k + 1]]
            if not len(own):
                continue
            p = pair[own]
            new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            times = np.diff(np.append(new, len(p)))
            data = _packed(
                _planes(np.diff(p[new], prepend=np.uint64(0))), _planes(np.add.reduceat(learnt_from[own].astype(np.int64), new).astype(np.uint32)),
                _planes(_code(counts[codes[own[new]]])), _planes(counts[before[own[new]]]), _planes(times.astype(np.uint32)),
                _planes(owner[own].astype(np.uint32)), texts,
            )
            out.append((k, key[0], False, data))
        out.append((int(key[0] % shards), key[0], True, _packed(known, base)))
        return pd.DataFrame(out, columns=["shard", "chunk", "plain", "data"])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(c, True, d) for c, plain, d in zip(rows["chunk"], rows["plain"], rows["data"]) if plain]
        asked = []
        for chunk, plain, data in zip(rows["chunk"], rows["plain"], rows["data"]):
            if not plain:
                asked.append((chunk, *_unpacked(data)))
        if asked:
            pairs = [np.cumsum(_numbers(x[1], np.uint64)) for x in asked]
            grown = np.concatenate(pairs)
            seen = np.concatenate([_numbers(x[2], np.uint32) for x in asked]).astype(np.int64)
            of_context = np.concatenate([_numbers(x[4], np.int64) for x in asked])
            order = np.argsort(grown)
            ordered = grown[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            times = np.add.reduceat(seen[order], new)
            kept = times > 0
            distinct, times, total = ordered[new][kept], times[kept], of_context[order][new][kept]
            share = np.minimum(np.round(np.sqrt(-np.log10(times / (total + mu))) * STEPS), 65535).astype(np.uint16)
            with tempfile.TemporaryFile() as file:
                successors = Successors(distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF), file)
                shares = _mapped(share, file)
                for (chunk, _, _, word_code, total, times, owner, texts), pair in zip(asked, pairs):
                    at = successors.find(pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF))
                    upper = np.where(at >= 0, 10.0 ** -((shares[np.maximum(at, 0)] / STEPS) ** 2) if len(shares) else 0.0, 0.0)
                    total = _numbers(total, np.int64).astype(np.float64)
                    value = np.log10(upper + mu / (total + mu) * (_count(_numbers(word_code, np.uint16)) + 1) / floor)
                    sums = np.bincount(_numbers(owner, np.uint32), np.repeat(value, _numbers(times, np.uint32)), texts)
                    out.append((chunk, False, _packed(sums)))
        return pd.DataFrame(out, columns=["chunk", "plain", "data"])

    def finish(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known, base = _unpacked(answers["data"][answers["plain"]].iloc[0])
        score = np.zeros(len(base))
        for data in answers["data"][~answers["plain"]]:
            score += _unpacked(data)[0]
        ids, real, held, lengths = _unpacked(chunk["texts"].iloc[0])
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.copy(), ~real), "held_out": held, "n_tokens": lengths, "n_known": known,
            "train_tokens": learnt, "base_score": base, "score": score,
        })

    by_chunk = lambda df: df.groupBy("chunk")
    asked = by_chunk(chunks.select("chunk", "data")).cogroup(by_chunk(words.where("chunk IS NOT NULL").select("chunk", "part", "data"))).applyInPandas(
        ask, "shard int, chunk long, plain boolean, data binary"
    )
    answered = asked.groupBy("shard").applyInPandas(answer, "chunk long, plain boolean, data binary")
    return by_chunk(chunks.select("chunk", "texts")).cogroup(by_chunk(answered)).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
