"""Tokenising inside tasks with a tokenizer whose words do not affect each other.

``word_bpe_49k`` drops white space and splits at it before merging, so the ids
of a text are the ids of its words one after another. Each task encodes a word
once and copies its ids wherever the word stands. Known words are kept as
arrays (hash, ids) per Python worker, up to ``CACHE_WORDS``; when they are more,
those that fewer slices of texts had go.

New words are encoded in runs. The last id of what the tokenizer takes as one
word carries an end mark, and a word of Latin letters has one such end, or two
with signs behind the letters; so the ids of a run are cut into words by their
ends. Other words are encoded one by one.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from twinedge.llm.words import Words, words_of

END = 1
"""The id that follows each document."""

CACHE_WORDS = 1 << 20
RUN_WORDS = 1000
RUNS_AT_ONCE = 8
"""An encoded run holds some hundred bytes for each id until its ids are copied."""

_LETTERS = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
_SIGNS = r"[.,;:!?*#$%&|<>()=+/-]+"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _batches(self, texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts in a row, and how many each has."""
        ids, length = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), size):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + size], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                length.append(len(ids[-1]))
        return np.concatenate(ids), np.array(length, np.int64)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word in a row, and how many each has."""
        shape = [pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (f"^{_LETTERS}$", f"^{_LETTERS}{_SIGNS}$")]
        plain = np.flatnonzero(shape[0] | shape[1])
        wanted = np.where(shape[0][plain], 1, 2)
        listed = words.take(pa.array(plain)).to_pylist()
        ids, _ = self._batches([" ".join(listed[k : k + RUN_WORDS]) for k in range(0, len(listed), RUN_WORDS)], RUNS_AT_ONCE)
        upto = np.cumsum(self.ends[ids])
        if len(plain) and (not len(upto) or upto[-1] != wanted.sum()):
            plain, ids = plain[:0], ids[:0]  # another vocabulary: one by one
        last = np.searchsorted(upto, np.cumsum(wanted[: len(plain)]))
        length = np.zeros(len(words), np.int64)
        length[plain] = np.diff(last, prepend=-1)
        other = np.setdiff1d(np.arange(len(words)), plain)
        more, length[other] = self._batches(words.take(pa.array(other)).to_pylist(), RUN_WORDS)
        # back into the order of the words
        place = np.concatenate([plain, other])
        start = np.concatenate([np.cumsum(length[plain]) - length[plain], len(ids) + np.cumsum(length[other]) - length[other]])
        begins = np.empty(len(words), np.int64)
        begins[place] = start
        at = np.arange(int(length.sum())) + np.repeat(begins - (np.cumsum(length) - length), length)
        return np.concatenate([ids, more])[at], length

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        ids, length = self.encode_words(words)
        first = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        for name, new in (("known", hashes), ("first", first), ("length", length), ("seen", np.zeros(len(hashes), np.int64))):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))

    def _forget(self, room: int) -> None:
        """Keep the words of most slices, so that ``room`` more fit."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: max(0, CACHE_WORDS // 2 - room)])
        length = self.length[keep]
        at = np.arange(int(length.sum())) + np.repeat(self.first[keep] - (np.cumsum(length) - length), length)
        self.ids, self.known, self.length, self.seen = self.ids[at], self.known[keep], length, self.seen[keep]
        self.first = np.cumsum(length) - length

    def vocabulary(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of the vocabulary has its ids in ``self.ids``, and how many."""
        hashes = words.hashes()
        if len(self.known) + len(hashes) > CACHE_WORDS and len(self.known):
            self._forget(len(hashes))
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            fresh = np.flatnonzero(new)
            self._learn(words.vocabulary.take(pa.array(fresh)), hashes[fresh])
            at = np.searchsorted(self.known, hashes)
        self.seen[at] += 1
        return self.first[at], self.length[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text with ``END``, and where each begins."""
        words = words_of(texts, lower=False)
        counts, n = words.counts, len(words.counts)
        first, length = self.vocabulary(words) if len(words.codes) else (np.zeros(0, np.int64),) * 2
        per_word = length[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per_word)])
        starts = total[words.starts] + np.arange(n + 1)
        out = np.full(int(starts[-1]), END, np.uint32)
        if len(per_word):
            # one END lies between the texts, so a word's place moves by its text's number
            owner = np.repeat(np.arange(n), counts)
            shift = np.repeat(total[:-1] + owner, per_word)
            place = np.arange(int(total[-1])) + np.repeat(owner, per_word)
            out[place] = self.ids[np.repeat(first[words.codes], per_word) + (place - shift)]
        return out, starts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without ``END``."""
        words = words_of(texts, lower=False)
        if not len(words.codes):
            return np.zeros(len(texts), np.int64)
        _, length = self.vocabulary(words)
        total = np.concatenate([[0], np.cumsum(length[words.codes])])
        return total[words.starts[1:]] - total[words.starts[:-1]]


@lru_cache(maxsize=2)
def tokenizer(file: str | None = None) -> WordTokenizer:
    """The worker's tokenizer; made once per Python worker."""
    return WordTokenizer(file or default_file())
