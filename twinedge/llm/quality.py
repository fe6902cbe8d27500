"""Operator 2, quality rules: a ledger of rule bits, judged later by policies.

Every rule is evaluated once per document. The ledger keeps all measurements
and one LONG in which bit k says that rule k failed. A policy is a named,
versioned set of rules, again a bit mask; judging is ``failed & mask``, so a
new policy, or the effect of leaving a rule out, never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import map_slices, mixed, plain, sums, text_bytes, words_of
from twinedge.scratch import materialise

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_letter_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit is its place in ``RULES``."""

    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 50 * F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("shouting", lambda: 100 * F.col("n_upper_words") > 70 * F.col("n_words")),
    Rule("few_letters", lambda: 100 * F.col("n_letter_words") < 50 * F.col("n_words")),
)
BITS = {rule.name: 1 << k for k, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(BITS))


def _repeats(codes: np.ndarray, starts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of words of each text in 3-word windows that occur twice or more in it."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(codes) - WINDOW + 1)
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n]) if n else np.zeros(0, np.int64)
    grams = np.stack([owner[at], codes[at], codes[at + 1], codes[at + 2]])
    key = mixed(grams[0])
    for row in grams[1:]:
        key = mixed(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # equal hashes first, then the few that are left word by word
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    doubtful = np.zeros(len(key), bool)
    doubtful[order[1:][same]] = doubtful[order[:-1][same]] = True
    left = np.flatnonzero(doubtful)
    covered = np.zeros(len(codes) + 1, bool)
    if len(left):
        _, which, times = np.unique(grams[:, left], axis=1, return_inverse=True, return_counts=True)
        twice = at[left[times[which.ravel()] >= 2]]
        for k in range(WINDOW):
            covered[twice + k] = True
    return sums(covered[:-1].astype(np.int64), starts)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = plain(batch.column("text"))
    words = words_of(texts, lower=False)
    vocabulary, codes, starts = words.vocabulary, words.codes, words.starts
    per_word = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)[codes]

    data, ends = text_bytes(texts)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    n_symbols = sums(symbol[data], ends)

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten().dictionary_encode()
    filled = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_code = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    real = filled[line_code]
    n_lines = np.bincount(owner[real], minlength=len(texts))
    distinct = np.unique(owner[real] * (len(filled) + 1) + line_code[real])
    n_distinct = np.bincount(distinct // (len(filled) + 1), minlength=len(texts))
    out = {
        "n_words": words.counts,
        "word_chars": sums(per_word(pc.utf8_length(vocabulary)), starts),
        "n_symbols": n_symbols,
        "n_lines": n_lines,
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": _repeats(codes, starts, len(vocabulary)),
        "n_upper_words": sums(per_word(pc.utf8_is_upper(vocabulary)), starts),
        "n_letter_words": sums(per_word(pc.match_substring_regex(vocabulary, r"\pL")), starts),
    }
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("source"), *(pa.array(np.asarray(out[m], np.int64)) for m in MEASURES)],
        names=["doc_id", "source", *MEASURES],
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, measurements..., failed)``, a row for each input row.

    One pass over the texts, no shuffle. A null text has no words and fails
    the rules that an empty text fails; a null or missing source stays null;
    repeated rows stay repeated; other columns are ignored.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    failed = sum((F.when(rule.fails(), F.lit(BITS[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")) for rule in RULES), F.lit(0).cast("long"))
    return map_slices(rows, _measure, schema).withColumn("failed", failed)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: policies, ablations and profiles
    read this table of numbers, and no text."""
    return materialise(ledger(docs), "rule-ledger")


def judged(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Ledger rows with ``base_failed`` and the policy's ``kept``."""
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    verdict = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & verdict)


def ablation(rows: DataFrame, policies: Sequence[Policy] = (STANDARD,)) -> DataFrame:
    """``(policy, version, rule, n_failed, n_only, n_kept_without)``: documents
    that a rule rejects, that it alone rejects, and that stay without it.

    Documents are first counted by their failure bits, at most 2^rules groups,
    so the shuffle holds a handful of rows per task whatever the input. Repeated
    rows count each; an empty ledger gives no rows.
    """
    counted = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for policy in policies:
        hit = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
        for rule in policy.rules:
            bit = F.lit(BITS[rule]).cast("long")
            out.append(
                F.struct(
                    F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.lit(rule).alias("rule"),
                    F.when(hit.bitwiseAND(bit) != 0, F.col("n")).otherwise(0).alias("failed"),
                    F.when(hit == bit, F.col("n")).otherwise(0).alias("only"),
                    F.when(hit.bitwiseAND(F.lit(~BITS[rule]).cast("long")) == 0, F.col("n")).otherwise(0).alias("without"),
                )
            )
    return (
        counted.select(F.explode(F.array(*out)).alias("x")).select("x.*").groupBy("policy", "version", "rule")
        .agg(F.sum("failed").alias("n_failed"), F.sum("only").alias("n_only"), F.sum("without").alias("n_kept_without"))
    )


def failure_profile(rows: DataFrame) -> DataFrame:
    """``(source, n, any_failed, all_failed)``: the rules that some, and that all,
    documents of a source fail, by OR and AND of the bits. Null is a source of
    its own, and repeated rows count each."""
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed")
    )


def names_of(bits: int, rules: Mapping[str, int] = BITS) -> list[str]:
    return [name for name, bit in rules.items() if bits & bit]
