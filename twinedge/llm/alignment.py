"""Operator 13, alignment of two tokenizers, each distinct text once.

Texts are shuffled by their full text, so every distinct text is tokenised and
aligned once and counts as often as it occurs. Tokenizer A is a byte-level BPE,
B a piece BPE with byte fallback; both see a space before the text. Byte
offsets where a token of A and a token of B both end cut a text into groups,
and every A token of a group is linked with every B token of it.

A piece of text between two single spaces has the same tokens wherever it
stands: no token of either vocabulary has a space behind another character, and
the splitting pattern of A ends a word before a space. Such a piece is aligned
once per chunk of texts. Texts where a space meets more white space, or a text's
end, are taken whole. Each encoded run is checked: its bytes must be those that
went in and every piece must end at a token's end, else its pieces are encoded
one by one.

How many documents hold a pair needs the whole corpus, and every text needs the
counts of its pairs. A chunk (some megabytes of texts) sends each of its
distinct pairs once, with the number of documents; the counts come back by
chunk and meet the chunk's stored links. So neither texts nor token lists are
shuffled again, and no table of pairs is held whole anywhere.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinedge.llm.words import text_slices
from twinedge.scratch import materialise

RUN_CHARS = 1 << 15
"""Pieces are encoded in runs of about this many characters."""

RUNS_AT_ONCE = 8
"""An encoded run holds some hundred bytes for each id until its ids are copied."""

CHUNK_BYTES = 3 << 20
"""Texts of a chunk, or one text."""

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
ODD = rf"^ | $|{_SPACE} | {_SPACE}|\x{{2581}}"
"""Texts that must be encoded whole."""

ALIGNED = (
    "chunk long, place int, key binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, weights array<long>, links binary, links_size long"
)
MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Side:
    """One vocabulary: the bytes of id k are ``data[first[k]:first[k + 1]]``."""

    data: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Side:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids + 1] - self.first[ids]

    def spelled(self, ids: np.ndarray) -> bytes:
        size = self.sizes(ids)
        at = np.arange(int(size.sum())) + np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.data[at].tobytes()


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        alphabet = _byte_alphabet()
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        tokens_a = [b""] * (entries[-1][1] + 1)
        for entry, i in entries:
            tokens_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        tokens_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            tokens_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sides = Side.of(tokens_a), Side.of(tokens_b)

    def ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(texts), RUNS_AT_ONCE):
            some = texts[k : k + RUNS_AT_ONCE]
            a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)]
            b = [np.array(y, np.int64) for y in self.b.encode(some, num_threads=1)]
            yield from zip(a, b)

    def lossless(self, text: str, ids: tuple[np.ndarray, np.ndarray]) -> bool:
        whole = b" " + text.encode()
        return all(side.spelled(own) == whole for side, own in zip(self.sides, ids))

    def encode(self, pieces: list[str]) -> Encoded:
        """Each piece by both tokenizers; a piece that does not come back has no tokens."""
        runs, odd, size = [[]], [], 0
        for k, piece in enumerate(pieces):
            if not piece or " " in piece or "▁" in piece:
                odd.append(k)
                continue
            if size > RUN_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(k)
            size += len(piece) + 1
        owners, found = ([], []), ([], [])
        good = np.ones(len(pieces), bool)

        def add(piece_of: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> None:
            for side in (0, 1):
                owners[side].append(piece_of[side])
                found[side].append(ids[side])

        runs = [np.array(r) for r in runs if r]
        joined = [" ".join([pieces[k] for k in run]) for run in runs]
        for run, text, ids in zip(runs, joined, self.ids(joined)):
            ends = np.cumsum([1 + len(pieces[k].encode()) for k in run])
            upto = [np.cumsum(side.sizes(own)) for side, own in zip(self.sides, ids)]
            if self.lossless(text, ids) and all(np.isin(ends, u, assume_unique=True).all() for u in upto):
                add(tuple(run[np.searchsorted(ends, u)] for u in upto), ids)
            else:
                odd.extend(run.tolist())
        for k, ids in zip(odd, self.ids([pieces[k] for k in odd])):
            if self.lossless(pieces[k], ids):
                add(tuple(np.full(len(x), k) for x in ids), ids)
            else:
                good[k] = False
        out = []
        for side in (0, 1):
            owner = np.concatenate([np.zeros(0, np.int64), *owners[side]])
            order = np.argsort(owner, kind="stable")
            out.append((owner[order], np.concatenate([np.zeros(0, np.int64), *found[side]])[order]))
        return Encoded(good, *out)


@dataclass
class Encoded:
    """Tokens of several pieces: (piece, id) for either tokenizer, by piece and place."""

    good: np.ndarray
    a: tuple[np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray]


@dataclass
class Aligned:
    """Pieces aligned: per piece its counts and its groups as text, and its links
    ``(piece, pair)`` with multiplicity, where ``pairs[pair]`` is A id, B id."""

    good: np.ndarray
    counts: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray
    link_piece: np.ndarray
    link_pair: np.ndarray
    link_times: np.ndarray


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0..n-1 as bytes, left-aligned with a free byte behind, and how many."""
    digits = np.arange(n).astype(f"S{len(str(n)) + 1}")
    table = digits.view(np.uint8).reshape(n, -1).copy()
    return table, (table > 0).sum(axis=1)


@lru_cache(maxsize=2)
def tokenizers(file_a: str, file_b: str) -> Tokenizers:
    """Made once per Python worker."""
    return Tokenizers(file_a, file_b)


@lru_cache(maxsize=4)
def _digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _decimals(n)


def align(tok: Tokenizers, pieces: list[str]) -> Aligned:
    found = tok.encode(pieces)
    n = len(pieces)
    (piece_a, ids_a), (piece_b, ids_b) = found.a, found.b
    # the pieces stand in the same order on both sides and have the same bytes
    ends_a, ends_b = (np.cumsum(side.sizes(ids)) for side, ids in zip(tok.sides, (ids_a, ids_b)))
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    piece_of = piece_a[np.searchsorted(ends_a, cuts)] if len(cuts) else np.zeros(0, np.int64)
    counts = np.stack(
        [
            np.bincount(piece_a, minlength=n), np.bincount(piece_b, minlength=n), np.bincount(piece_of, minlength=n),
            np.bincount(piece_of, weights=in_a * in_b, minlength=n).astype(np.int64),
        ],
        axis=1,
    )
    # groups as text: A ids, B ids of each group in a row, every id with the sign behind it
    table, length = _digit_table(max(len(s.first) for s in tok.sides))
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    ids, side = np.concatenate([ids_a, ids_b])[order], side[order]
    shown = table[ids]
    last = np.append(side[1:] != side[:-1], True)[: len(side)]
    shown[np.arange(len(ids)), length[ids]] = np.where(last, np.where(side % 2 == 0, ord("|"), ord(";")), ord(","))
    flat = shown[shown > 0].tobytes()
    upto = np.concatenate([[0], np.cumsum(np.bincount(piece_of[side // 2], weights=length[ids] + 1, minlength=n))]).astype(np.int64)
    groups = [flat[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())]
    # links: every A token as often as its group has B tokens
    times = in_b[group_a]
    first_b = (np.cumsum(in_b) - in_b)[group_a]
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    code = (np.repeat(ids_a, times) << 32) | ids_b[np.repeat(first_b, times) + inside]
    pairs, pair = np.unique(code, return_inverse=True)
    both, link_times = np.unique(np.repeat(piece_a, times) * max(1, len(pairs)) + pair, return_counts=True)
    return Aligned(found.good, counts, groups, pairs, both // max(1, len(pairs)), both % max(1, len(pairs)), link_times)


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """``(order, starts, codes, vocabulary)``: text ``order[k]`` is the pieces
    ``codes[starts[k]:starts[k + 1]]`` with single spaces between them."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat = pa.concat_arrays([split.flatten().cast(pa.large_string()), texts.filter(pa.array(odd))])
    counts = np.concatenate([split.value_lengths().to_numpy(zero_copy_only=False), np.ones(int(odd.sum()), np.int64)])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return order, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), codes, coded.dictionary.to_pylist()


def aligned_texts(texts: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Each row of ``texts(text, key, n_docs)`` aligned, and a row per chunk with
    its pairs (``place`` is null there)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(file_a, file_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, size=CHUNK_BYTES):
            order, starts, codes, vocabulary = _pieces(batch.column("text"))
            found = align(tok, vocabulary)
            n, text_of = len(order), np.repeat(np.arange(len(order)), np.diff(starts))
            good = np.bincount(text_of, weights=~found.good[codes], minlength=n) == 0
            # a piece as often as it stands in a text, then its pairs
            base = max(1, len(vocabulary))
            used, times = np.unique((text_of * base + codes)[good[text_of]], return_counts=True)
            owner, piece = used // base, used % base
            counts = np.zeros((n, 4), np.int64)
            np.add.at(counts, owner, found.counts[piece] * times[:, None])
            first = np.searchsorted(found.link_piece, np.arange(base + 1))
            many = (first[1:] - first[:-1])[piece]
            at = np.arange(int(many.sum())) + np.repeat(first[piece] - (np.cumsum(many) - many), many)
            code = np.repeat(owner, many) * max(1, len(found.pairs)) + found.link_pair[at]
            occurs = found.link_times[at] * np.repeat(times, many)
            by = np.argsort(code, kind="stable")
            links, begin = np.unique(code[by], return_index=True)
            occurs = np.add.reduceat(occurs[by], begin) if len(begin) else np.zeros(0, np.int64)
            owner, pair = links // max(1, len(found.pairs)), links % max(1, len(found.pairs))
            n_docs = batch.column("n_docs").to_numpy()[order]
            weights = np.zeros(len(found.pairs), np.int64)
            np.add.at(weights, pair, n_docs[owner])
            bounds, digests = starts.tolist(), []
            for k in range(n):
                own = codes[bounds[k] : bounds[k + 1]].tolist() if good[k] else ()
                digests.append(hashlib.sha256(b"".join([found.groups[c] for c in own])[:-1]).hexdigest() if own else "")
            held = weights > 0
            renumbered = np.cumsum(held) - 1
            stored = np.concatenate([np.bincount(owner, minlength=n), np.diff(renumbered[pair], prepend=0), occurs]).astype("<i4")
            raw = np.ascontiguousarray(stored.view(np.uint8).reshape(-1, 4).T).tobytes()
            whole = [
                pa.array([chunk] * (n + 1)), pa.array([*range(n), None], pa.int32()),
                pa.array([*batch.column("key").take(pa.array(order)).to_pylist(), None], pa.binary()),
                pa.array([*n_docs.tolist(), None], pa.int64()),
                *[pa.array([*counts[:, j].tolist(), None], pa.int64()) for j in range(4)],
                pa.array([*digests, None], pa.string()),
                pa.array([None] * n + [found.pairs[held]], pa.list_(pa.int64())),
                pa.array([None] * n + [weights[held]], pa.list_(pa.int64())),
                pa.array([None] * n + [pa.compress(raw, codec="zstd", asbytes=True)], pa.binary()),
                pa.array([None] * n + [len(raw)], pa.int64()),
            ]
            names = [c.split()[0] for c in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays(whole, names=names)
            chunk += 1

    return texts.mapInArrow(task, ALIGNED)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(text, key, n_docs)``: every distinct text that is not empty, once."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    counted = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.select("text", _key().alias("key"), "n_docs")


def _key():
    return F.unhex(F.sha2(F.col("text").cast("string"), 256))


def _requests(aligned: DataFrame) -> DataFrame:
    """``(chunk, pair, weight)``: each distinct pair of a chunk once."""
    both = F.explode(F.arrays_zip("pairs", "weights")).alias("p")
    return aligned.where("place IS NULL").select("chunk", both).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("weight"))


def _counted(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many documents, and whether an A id has no
    more frequent partner. An A id has at most as many pairs as B has ids."""
    counts = _requests(aligned).groupBy("pair").agg(F.sum("weight").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one chunk with the counts of the chunk's pairs."""
    left = left.combine_chunks()
    head = left.filter(pc.is_null(left.column("place")))
    texts = left.filter(pc.is_valid(left.column("place"))).sort_by("place")
    n = texts.num_rows
    pairs = np.array(head.column("pairs")[0].as_py(), np.int64)
    size = head.column("links_size")[0].as_py()
    raw = pa.decompress(head.column("links")[0].as_py(), decompressed_size=size, codec="zstd", asbytes=True)
    stored = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    owner = np.repeat(np.arange(n), stored[:n])
    pair, times = np.cumsum(stored[n : n + len(owner)]), stored[n + len(owner) :]
    asked = np.searchsorted(pairs, right.column("pair").to_numpy())
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    count[asked] = right.column("n").to_numpy()
    best[asked] = right.column("best").to_numpy().astype(np.int64)
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(n_best, owner, best[pair] * times)
    np.add.at(count_sum, owner, count[pair] * times)
    kept = [texts.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")]
    columns = [*kept, pa.array(n_best), pa.array(count_sum), texts.column("groups_sha256")]
    return pa.table(columns, names=[c.split()[0] for c in MEASURES.split(", ")])


def text_measures(aligned: DataFrame) -> DataFrame:
    """One row of measures per distinct text of :func:`aligned_texts`."""
    answers = _requests(aligned).join(_counted(aligned), "pair").select(F.col("chunk").alias("asker"), "pair", "n", "best")
    return aligned.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(_measured, MEASURES)


def correspondences(docs: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """``(a_id, b_id, n_docs, best)``: pairs of token ids that are linked in
    ``n_docs`` documents; ``best`` if the A id has no more frequent partner."""
    a, b = default_files()
    aligned = materialise(aligned_texts(distinct_texts(docs), file_a or a, file_b or b), "aligned")
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return _counted(aligned).select(F.shiftright("pair", 32).alias("a_id"), low.alias("b_id"), F.col("n").alias("n_docs"), "best")


def alignment(docs: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``
    for every row of ``docs(doc_id, text)``.

    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have zeros and ''. Rows with a null or repeated doc_id are
    documents of their own; repeated rows give equal rows and count each. Ties
    for an A id's best partner all count. Extra columns are ignored.
    """
    a, b = default_files()
    aligned = materialise(aligned_texts(distinct_texts(docs), file_a or a, file_b or b), "aligned")
    measures = materialise(text_measures(aligned), "alignment-measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(measures, "key", "left").select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
