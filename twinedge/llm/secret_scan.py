"""Operator 8, secret scans with inferred credential grammars.

Three base patterns find assignments, access keys and hex strings. For formats
that no pattern lists, a grammar is inferred from labelled credentials: their
prefix tree is turned into a probabilistic automaton by merging states whose
futures are statistically compatible (a Hoeffding test on every branch, the
ALERGIA algorithm). Within a long token, a credential may begin at the token's
start or after a separator, and ends where its automaton ends best. Spans are
reported whose likelihood under some automaton exceeds that under a Markov
model of ordinary long tokens by ``MARGIN`` nats a character; of those that
overlap, the ones with the largest sum of what exceeds the margin, each as long
as it stays above it.

Labels: what the base patterns find in at most ``SAMPLE_ROWS`` documents, and
``EXAMPLES`` generated strings of each public format below. The automata have
at most a few hundred states and go to the tasks; every text is scanned whole.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import bounded_sample, map_slices, plain, text_slices

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20
EXAMPLES = 200
LABELS = 1000
"""Labelled strings per kind that a grammar is inferred from, at most."""
MARGIN = 0.5
LONGEST = 96
"""Characters of a label that an automaton is inferred from; candidates are scored whole."""
SHORTEST = 16
SEPARATORS = frozenset("=/._-")
ALPHA = 0.05

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
# cheap tests that every text with a match passes
HINTS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "format": r"[A-Za-z0-9+/_.=-]{16}",
}

_ALNUM = string.ascii_letters + string.digits
# fixed values: public credential formats as (prefix, alphabet, length of the rest)
FORMATS = {
    "aws": ("AKIA", string.ascii_uppercase + "234567", 16),
    "github": ("ghp_", _ALNUM, 36),
    "gitlab": ("glpat-", _ALNUM + "-_", 20),
    "google": ("AIza", _ALNUM + "-_", 35),
    "slack": ("xoxb-", string.digits + "-", 40),
    "stripe": ("sk_live_", _ALNUM, 24),
    "npm": ("npm_", _ALNUM, 36),
    "jwt": ("eyJhbGciOi", _ALNUM + "-_.", 90),
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _symbol(place: int, c: str) -> str:
    """Early characters stand for themselves, later ones for their class."""
    if place < 8 or not c.isalnum():
        return c
    return "0" if c.isdigit() else ("a" if c in "abcdef" else "z" if c.islower() else "A" if c in "ABCDEF" else "Z")


SIZE = {"0": 10, "a": 6, "z": 20, "A": 6, "Z": 20}


def _symbols(text: str) -> list[str]:
    return [_symbol(k, c) for k, c in enumerate(text)]


class Automaton:
    """A probabilistic automaton inferred by state merging."""

    def __init__(self, samples: Sequence[str]):
        self.count, self.end, self.next = [0], [0], [{}]  # of each state
        self.used: list[dict[str, int]] = [{}]
        for text in samples:
            state = 0
            self.count[0] += 1
            for s in _symbols(text[:LONGEST]):
                self.used[state][s] = self.used[state].get(s, 0) + 1
                if s not in self.next[state]:
                    self.next[state][s] = len(self.count)
                    self.count.append(0)
                    self.end.append(0)
                    self.next.append({})
                    self.used.append({})
                state = self.next[state][s]
                self.count[state] += 1
            self.end[state] += len(text) <= LONGEST
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        open_pairs = [(a, b)]
        while open_pairs:
            a, b = open_pairs.pop()
            if a == b:
                continue
            n, m = self.count[a], self.count[b]
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for s in {*self.used[a], *self.used[b]}:
                if self._differ(self.used[a].get(s, 0), n, self.used[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    open_pairs.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        open_pairs = [(a, b)]
        while open_pairs:
            a, b = open_pairs.pop()
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            for s, n in self.used[b].items():
                self.used[a][s] = self.used[a].get(s, 0) + n
                if s in self.next[a]:
                    open_pairs.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(r, s, b) for r in red for s, b in self.next[r].items() if b not in red]
            if not blue:
                break
            parent, s, b = max(blue, key=lambda x: self.count[x[2]])
            for r in red:
                if self._compatible(r, b):
                    self.next[parent][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.states = len(red)

    def log_likelihood(self, text: str) -> float:
        total, state = 0.0, 0
        for s in _symbols(text):
            step = self.step(state, s) if state >= 0 else None
            state = step[1] if step else -1
            total += step[0] if step else math.log(0.02 / 4096)
        return total + (self.stop(state) if state >= 0 else math.log(0.01))

    def step(self, state: int, s: str) -> tuple[float, int] | None:
        """Log-probability of a symbol and the state after it."""
        if s not in self.next[state]:
            return None
        p = self.used[state][s] / self.count[state]
        return math.log((0.98 * p + 0.02 / 64) / SIZE.get(s, 1)), self.next[state][s]

    def stop(self, state: int) -> float:
        return math.log(0.98 * self.end[state] / self.count[state] + 0.01)


class Background:
    """Ordinary long tokens: a first-order Markov chain over the same symbols."""

    def __init__(self, samples: Sequence[str]):
        self.pairs: dict[str, Counter] = defaultdict(Counter)
        for text in samples:
            symbols = ["", *self._classes(text)]
            for a, b in zip(symbols, symbols[1:]):
                self.pairs[a][b] += 1
        self.totals = {a: sum(c.values()) for a, c in self.pairs.items()}

    @staticmethod
    def _classes(text: str) -> list[str]:
        return [_symbol(8, c) for c in text]

    def step(self, before: str, s: str) -> float:
        p = (self.pairs[before][s] if before in self.pairs else 0) + 0.5
        return math.log(p / (self.totals.get(before, 0) + 5) / SIZE.get(s, 1))

    def log_likelihood(self, text: str) -> float:
        classes = self._classes(text)
        return sum(self.step(a, b) for a, b in zip(["", *classes], classes))


class Grammar:
    def __init__(self, automata: Sequence[Automaton], background: Background):
        self.automata, self.background = automata, background

    def score(self, token: str) -> float:
        """Nats a character by which the best format explains a token better."""
        ordinary = self.background.log_likelihood(token)
        return (max(a.log_likelihood(token) for a in self.automata) - ordinary) / len(token)

    def spans(self, run: str, fresh: bool = True) -> list[tuple[int, int, float]]:
        """``(start, end, score)`` of the best non-overlapping spans of a run of
        candidate characters; ``fresh`` tells whether one may begin at its start.

        Two walks of one automaton in one state go on alike once they are
        SHORTEST long, and only the better one is kept: the time grows with the
        length of the run, however many separators it has.
        """
        classes = Background._classes(run)
        best, back = [0.0] * (len(run) + 1), [(-1, 0)] * (len(run) + 1)
        young: list[tuple[int, int, int, float]] = []  # start, automaton, state, value
        grown: dict[tuple[int, int], tuple[float, int]] = {}
        for j, c in enumerate(run):
            best[j + 1], back[j + 1] = best[j], (-1, 0)
            if fresh if j == 0 else run[j - 1] in SEPARATORS:
                young += [(j, k, 0, best[j]) for k in range(len(self.automata))]
            if not young and not grown:
                continue
            cost = self.background.step(classes[j - 1] if j else "", classes[j]) + MARGIN
            walks = [(start, k, state, value) for (k, state), (value, start) in grown.items()] + young
            young, grown = [], {}
            for start, k, state, value in walks:
                step = self.automata[k].step(state, _symbol(j - start, c))
                if step is None:
                    continue
                value += step[0] - (cost if start < j else self.background.step("", classes[j]) + MARGIN)
                state = step[1]
                if j + 1 - start < SHORTEST:
                    young.append((start, k, state, value))
                    continue
                if (k, state) not in grown or grown[k, state][0] < value:
                    grown[k, state] = value, start
                whole = value + self.automata[k].stop(state)
                if whole > best[j + 1] and self._may_end(run, classes, j + 1, k, state):
                    best[j + 1], back[j + 1] = whole, (start, k)
        found, j, free = [], len(run), len(run)
        while j:
            start, k = back[j]
            if start < 0:
                j -= 1
            else:
                found.append((start, *self._longest(run, classes, start, j, free, k)))
                j = free = start
        return found[::-1]

    def _may_end(self, run: str, classes: list[str], end: int, k: int, state: int) -> bool:
        """A word that the automaton can go on with does not end inside."""
        return end == len(run) or not run[end].isalnum() or self.automata[k].step(state, classes[end]) is None

    def _longest(self, run: str, classes: list[str], start: int, end: int, free: int, k: int) -> tuple[int, float]:
        """The last end up to ``free`` at which a span is above the margin, and its score."""
        value, state, score = 0.0, 0, 0.0
        for j in range(start, free):
            step = self.automata[k].step(state, _symbol(j - start, run[j]))
            if step is None:
                break
            value += step[0] - self.background.step(classes[j - 1] if j > start else "", classes[j])
            state = step[1]
            whole = (value + self.automata[k].stop(state)) / (j + 1 - start)
            if j + 1 == end or (j + 1 > end and whole >= MARGIN and self._may_end(run, classes, j + 1, k, state)):
                end, score = j + 1, whole
        return end, score


def examples(prefix: str, alphabet: str, length: int, n: int = EXAMPLES) -> list[str]:
    draw = random.Random(prefix)
    return [prefix + "".join(draw.choice(alphabet) for _ in range(length)) for _ in range(n)]


def _drawn(values: Iterable[str]) -> list[str]:
    """At most ``LABELS`` of the values, drawn by a hash."""
    return sorted(sorted(values, key=lambda v: (xxhash.xxh3_64_intdigest(v.encode()), v))[:LABELS])


def labelled(docs: DataFrame, limit: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Labelled credentials and ordinary tokens of at most ``limit`` distinct
    texts (and ``SAMPLE_BYTES``)."""
    texts = bounded_sample(docs, limit, "text", SAMPLE_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set[str]] = defaultdict(set)
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for kind, a, b in spans:
                    found[kind].add(ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b])
                for m in CANDIDATE.finditer(text):
                    if not any(a < m.end() and m.start() < b for _, a, b in spans):
                        found["ordinary"].add(m[0])
        rows = [(k, v) for k, values in found.items() for v in _drawn(values)]
        if rows:
            kinds, values = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["kind", "value"])

    out: dict[str, list[str]] = defaultdict(list)
    # at most LABELS values of each kind from the one partition of the limit
    for row in texts.mapInArrow(task, "kind string, value string").distinct().collect():
        out[row["kind"]].append(row["value"])
    return {k: _drawn(v) for k, v in out.items()}


def infer(docs: DataFrame) -> Grammar:
    labels = labelled(docs)
    groups = [examples(*f) for f in FORMATS.values()] + [labels[k] for k in KINDS[:3] if len(labels.get(k, ())) >= 20]
    return Grammar([Automaton(g) for g in groups], Background(labels.get("ordinary", ())))


def scan(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """``(doc_id, spans)``, a row for each input row; a span has kind, start, end
    (code points, end exclusive) and, for a format, its score.

    Spans are ordered by start, then by kind in the order of ``KINDS``. A null
    or empty text has none. Format spans never overlap base spans. Repeated
    rows stay; other columns are ignored. ``grammar`` is inferred from ``docs``
    unless given.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(_plain_grammar(grammar or infer(rows)))
    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
    rank = {k: n for n, k in enumerate(KINDS)}
    types = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _grammar(shipped.value)
        texts = plain(batch.column("text"))
        masks = {k: pc.match_substring_regex(texts, hint).to_numpy(zero_copy_only=False) for k, hint in HINTS.items()}
        spans: list[list[tuple]] = [[] for _ in range(len(texts))]
        known: dict[tuple[str, bool], list[tuple[int, int, float]]] = {}
        for k in np.flatnonzero(np.logical_or.reduce(list(masks.values()))).tolist():
            text = texts[k].as_py()
            base = base_spans(text) if masks["assign"][k] or masks["access"][k] or masks["hex"][k] else []
            found = [(*s, None) for s in base]
            taken = sorted((a, b) for _, a, b in base)
            for m in CANDIDATE.finditer(text) if masks["format"][k] else ():
                for a, b in _free(*m.span(), taken):
                    key = text[a:b], a == m.start() or text[a - 1] in SEPARATORS
                    if key not in known:
                        known[key] = model.spans(*key)
                    found += [("format", a + x, a + y, score) for x, y, score in known[key]]
            found.sort(key=lambda s: (s[1], rank[s[0]]))
            spans[k] = [dict(zip(("kind", "start", "end", "score"), s)) for s in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, types)], names=["doc_id", "spans"])

    return map_slices(rows, work, schema)


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a run between the sorted spans ``taken`` that are long enough."""
    for a, b in taken:
        if b <= start:
            continue
        if a >= end:
            break
        if a - start >= SHORTEST:
            yield start, a
        start = max(start, b)
    if end - start >= SHORTEST:
        yield start, end


def _plain_grammar(grammar: Grammar) -> dict:
    """Plain containers, which any worker can read."""
    return {
        "automata": [(a.count, a.end, a.next, a.used, a.states) for a in grammar.automata],
        "pairs": {k: dict(v) for k, v in grammar.background.pairs.items()},
    }


def _grammar(parts: dict) -> Grammar:
    automata = []
    for count, end, following, used, states in parts["automata"]:
        a = Automaton.__new__(Automaton)
        a.count, a.end, a.next, a.used, a.states = count, end, following, used, states
        automata.append(a)
    background = Background(())
    background.pairs = {k: Counter(v) for k, v in parts["pairs"].items()}
    background.totals = {a: sum(c.values()) for a, c in background.pairs.items()}
    return Grammar(automata, background)


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans and the list of all spans."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, name))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
