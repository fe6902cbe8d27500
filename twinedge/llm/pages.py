"""Operator 5, main text of web pages by a conditional random field over blocks.

A page is read into its leaf blocks: runs of text between block-level tags,
each with its ancestors. A linear-chain CRF with the labels text / not text
scores each block by ancestor tags, words of their class and id, and features
of the text, and neighbouring labels by their transition; Viterbi decoding
gives the best labelling of the page.

It is trained on at most ``TRAIN_PAGES`` of the given pages, drawn by a hash,
whose markup says where the article is (an ``article`` element, without the
parts that markup excludes), and on as many pages composed of ``LAYOUTS``:
labelled parts of common page layouts, filled with text of the given pages.
The weights (a few thousand numbers) go to the tasks; pages are independent.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import bounded_sample, plain, text_slices

TRAIN_PAGES = 300
TRAIN_BYTES = 32 << 20
EPOCHS = 80
LEAST_SEEN = 3
"""Features in fewer training blocks are left out."""

# a quote opens a value only behind "="; comments end as browsers end them
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")
# fixed values: elements by their role in HTML
RAW = frozenset("script style template noscript iframe svg textarea select title object canvas".split())
TO_THE_END = frozenset("script style textarea title".split())
"""Elements that hold the rest of a page if they are not closed."""
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
EXCLUDED = frozenset("nav aside footer form header menu button dialog".split())
EXCLUDED_WORDS = frozenset(
    "ad ads advert advertisement comment comments sidebar menu nav footer header cookie notice banner promo share social related newsletter "
    "replies reply reactions responses discussion disqus consent gdpr subscribe signup popup modal pagination pager breadcrumb sponsored recommended".split())


@dataclass(frozen=True)
class Place:
    """An open element and what is known of it and those around it. Elements
    inside each other share one ``context`` as long as they add nothing to it,
    so deep nesting costs no more than its tags."""

    tag: str
    context: frozenset[str]
    last: str
    """The innermost element that is not inline."""
    article: bool = False
    excluded: bool = False
    told: int | None = None
    """The label that a composed page states."""

    def inside(self, tag: str, attributes: str) -> Place:
        if tag in INLINE:
            return replace(self, tag=tag)
        if tag in ("x-0", "x-1"):
            return replace(self, tag=tag, told=int(tag[2:]))
        names = _described(attributes)
        new = {f"in {tag}", *(f"word {w}" for w in names)}
        return Place(
            tag, self.context if new <= self.context else self.context | new, tag,
            self.article or tag == "article", self.excluded or tag in EXCLUDED or bool(names & EXCLUDED_WORDS), self.told,
        )


@dataclass(frozen=True)
class Block:
    text: str
    place: Place
    linked: int
    """Characters inside links."""


PAGE = Place("", frozenset(), "")


def _described(attributes: str) -> frozenset[str]:
    if not attributes:
        return frozenset()
    names = [part for m in _NAMES.finditer(attributes) for part in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    if _HIDDEN.search(attributes):
        names.append("hidden")
    return frozenset(names)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; unclosed and unmatched tags are tolerated."""
    out: list[Block] = []
    stack: list[Place] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else PAGE, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for place in stack[k:]:
            open_tags[place.tag] -= 1
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            in_link -= in_link > 0 and tag == "a"
            continue
        if tag in RAW:
            if tag != "svg":
                flush()
            if not m[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page) if tag in TO_THE_END else at
            continue
        if tag not in INLINE:
            flush()
            ended = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if any(open_tags[t] for t in ended):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in ended:
                        close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((stack[-1] if stack else PAGE).inside(tag, m[3]))
            open_tags[tag] += 1
            in_link += tag == "a"
    rest = page[at:]
    if rest and not rest.lstrip().startswith("<"):
        parts.append(rest)
    flush()
    return out


_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_DATED = re.compile(r"\d{1,4}[./-]\d{1,2}|\b(?:19|20)\d\d\b|\d{1,2}:\d\d")
_WORDS = (1, 2, 3, 5, 8, 13, 21, 40, 80)


def features(blocks: Sequence[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    words = [b.text.count(" ") + 1 for b in blocks]
    # blocks of one kind (same elements around them), as the items of a list are
    kinds = [hash((b.place.context, b.place.last)) for b in blocks]
    twins = Counter(kinds)
    longest = max(range(n), key=words.__getitem__, default=0)
    for k, b in enumerate(blocks):
        own = ["bias", *b.place.context]
        if b.place.last:
            own.append(f"tag {b.place.last}")
        own.append(f"words {sum(words[k] >= x for x in _WORDS)}")
        share = b.linked / max(1, len(b.text))
        own.append("linked " + ("all" if share > 0.8 else "much" if share > 0.3 else "some" if share else "none"))
        own.append("ends " + (b.text[-1] if b.text[-1] in ".!?:;,|" else "open"))
        if "©" in b.text or "·" in b.text or "|" in b.text:
            own.append("marks")
        if _DATED.search(b.text[:60]):
            own.append("dated")
        own.append(f"place {10 * k // n}")
        own.append(f"twins {min(4, twins[kinds[k]])}")
        own.append("before longest" if k < longest else "after longest" if k > longest else "longest")
        if kinds[k] == kinds[longest]:
            own.append("as longest")
        out.append(own)
    return out


def marked_up(blocks: Sequence[Block]) -> list[int] | None:
    """Labels that the markup itself states, if it has an article."""
    labels = [int(b.place.article and not b.place.excluded) for b in blocks]
    return labels if any(labels) else None


# labelled parts of common layouts: opening tags, their closing tags, what fills them
LAYOUTS = {
    "body": [
        ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"),
        ('<section class="post-body">', "</section>"), ('<div class="entry text">', "</div>"), ('<div itemprop="articleBody">', "</div>"),
        ('<div role="main"><article class="story">', "</article></div>"), ("<div><div>", "</div></div>"),
    ],
    "links": [
        ("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ('<ul id="navigation">', "</ul>"),
        ('<div class="breadcrumb">', "</div>"), ('<aside class="related"><ul>', "</ul></aside>"), ('<div class="tags">', "</div>"), ('<div class="share social">', "</div>"),
    ],
    "aside": [
        ('<div class="ad">', "</div>"), ('<div class="advert banner">', "</div>"), ("<aside><p>", "</p></aside>"), ('<div class="sidebar"><p>', "</p></div>"),
        ('<div id="cookie-notice"><p>', "</p></div>"), ('<div class="notice">', "</div>"), ("<header><p>", "</p></header>"), ('<div class="header">', "</div>"),
        ("<form><label>", "</label><input><button>OK</button></form>"), ('<div class="newsletter"><form><p>', "</p></form></div>"),
        ('<section class="comments"><div class="comment"><p>', "</p></div></section>"), ('<div id="comments"><p>', "</p></div>"),
        ('<ol class="comment-list"><li>', "</li></ol>"), ('<div class="promo sponsored"><p>', "</p></div>"), ('<div role="dialog">', "</div>"),
    ],
    "end": [("<footer><p>", "</p></footer>"), ('<div class="footer">', "</div>"), ("<footer>", "</footer>"), ('<div id="copyright">', "</div>")],
}


def composed(texts: Sequence[str], n: int) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages of random layouts, filled with given paragraphs."""
    draw = random.Random(7)
    pages = []
    for _ in range(n if texts else 0):
        short = lambda: " ".join(draw.choice(texts).split()[: draw.randint(1, 4)])
        part = lambda most: " ".join(draw.choice(texts).split()[: draw.randint(3, most)])
        body = draw.choice(LAYOUTS["body"])
        inner = [(f"<h1>{html.escape(part(9))}</h1>", 1)] if draw.random() < 0.8 else []
        for _ in range(draw.randint(1, 8)):
            text = html.escape(draw.choice(texts))
            shape = draw.random()
            inner.append((f"<h2>{html.escape(part(6))}</h2>" if shape < 0.1 else f"<ul><li>{text}</li></ul>" if shape < 0.15 else f"<p>{text}</p>", 1))
        for _ in range(draw.randint(0, 2)):
            a, b = draw.choice(LAYOUTS["aside"])
            inner.insert(draw.randint(1, len(inner)), (f"{a}{html.escape(part(25))}{b}", 0))
        if draw.random() < 0.3:
            a, b = draw.choice(LAYOUTS["links"])
            inner.append((a + "".join(f'<li><a href="#">{html.escape(short())}</a></li>' for _ in range(3)) + b, 0))
        before, after = [], []
        for side in (before, after):
            for _ in range(draw.randint(0, 3)):
                if draw.random() < 0.5:
                    a, b = draw.choice(LAYOUTS["links"])
                    side.append((a + "".join(f'<li><a href="#">{html.escape(short())}</a></li>' for _ in range(draw.randint(2, 7))) + b, 0))
                else:
                    a, b = draw.choice(LAYOUTS["aside"])
                    side.append((a + html.escape(part(40)) + b, 0))
        a, b = draw.choice(LAYOUTS["end"])
        after.append((f"{a}&copy; {html.escape(part(12))}{b}", 0))
        # the label of a block is told by an element that features do not see
        tell = lambda items: "".join(f"<x-{label}>{markup}</x-{label}>" for markup, label in items)
        blocks = blocks_of(tell(before) + body[0] + tell(inner) + body[1] + tell(after))
        pages.append((blocks, [b.place.told for b in blocks]))
    return pages


class Crf:
    """Two labels; weights per feature and label, and per pair of labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.index, self.weights, self.transitions = index, weights, transitions

    def decode(self, blocks: Sequence[Block]) -> list[int]:
        if not blocks:
            return []
        index, (w0, w1), t = self.index, self.weights.T.tolist(), self.transitions.tolist()
        back, best = [], None
        for own in features(blocks):
            at = [index[f] for f in own if f in index]
            score = (sum(w0[f] for f in at), sum(w1[f] for f in at))
            if best is None:
                best = score
                continue
            came = [int(best[1] + t[1][y] > best[0] + t[0][y]) for y in (0, 1)]
            back.append(came)
            best = tuple(best[came[y]] + t[came[y]][y] + score[y] for y in (0, 1))
        path = [int(best[1] > best[0])]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood with a small L2 penalty, by Adam on all pages at once."""
    pages = [p for p in pages if p[0]]
    listed = [features(blocks) for blocks, _ in pages]
    seen: dict[str, int] = {}
    for own in listed:
        for block in own:
            for f in block:
                seen[f] = seen.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    count, longest = len(pages), max((len(b) for b, _ in pages), default=0)
    weights, transitions = np.zeros((len(index), 2)), np.zeros((2, 2))
    if not count:
        return Crf(index, weights, transitions)
    cell, feature = [], []
    gold = np.zeros((count, longest), np.int64)
    real = np.zeros((count, longest), bool)
    for p, own in enumerate(listed):
        gold[p, : len(own)] = pages[p][1]
        real[p, : len(own)] = True
        for k, block in enumerate(own):
            at = [index[f] for f in block if f in index]
            cell += [p * longest + k] * len(at)
            feature += at
    cell, feature = np.array(cell), np.array(feature)
    target = np.stack([(gold == 0) & real, (gold == 1) & real], axis=2).astype(float)
    pair_target = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & real[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for epoch in range(1, epochs + 1):
        score = np.stack([np.bincount(cell, weights[feature, y], count * longest).reshape(count, longest) for y in (0, 1)], axis=2)
        forward = np.zeros((count, longest, 2))
        backward = np.zeros((count, longest, 2))
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(forward[:, k - 1, :, None] + transitions[None], axis=1) + score[:, k]
            forward[:, k] = np.where(real[:, k, None], step, forward[:, k - 1])
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(transitions[None] + (score[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], step, 0)
        single = np.exp(forward + backward - norm[:, None, None]) * real[:, :, None]
        joint = np.exp(
            forward[:, :-1, :, None] + transitions + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        ) * real[:, 1:, None, None]
        wrong = (single - target).reshape(-1, 2) / count
        slope = np.stack([np.bincount(feature, wrong[cell, y], len(index)) for y in (0, 1)], axis=1) + 1e-4 * weights
        pair_slope = (joint.sum(axis=(0, 1)) - pair_target) / count + 1e-4 * transitions
        for value, g, m, v in ((weights, slope, moments[0], moments[1]), (transitions, pair_slope, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Crf(index, weights, transitions)


def fitted(pages: DataFrame, limit: int = TRAIN_PAGES) -> Crf:
    """A model for ``pages(html)``, from at most ``limit`` distinct ones of
    them (and ``TRAIN_BYTES``) and composed ones."""
    sample = bounded_sample(pages, limit, "html", TRAIN_BYTES)
    labelled, texts = [], []
    for row in sample.toLocalIterator():
        blocks = blocks_of(row["html"])
        labels = marked_up(blocks)
        if labels:
            labelled.append((blocks, labels))
        texts += [b.text for b in blocks if b.text.count(" ") >= 3][:20]
    return train(labelled + composed(texts or ["a b c d e f g h"], max(100, len(labelled))))


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each input row.

    A null or empty page, and one without main text, has the empty text.
    Repeated rows stay; a null id or url stays null; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    model = model or fitted(rows)
    shipped = pages.sparkSession.sparkContext.broadcast((model.index, model.weights, model.transitions))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shipped.value)
        for batch in text_slices(batches, "html"):
            texts = []
            for page in plain(batch.column("html")).to_pylist():
                blocks = blocks_of(page)
                texts.append(" ".join(b.text for b, y in zip(blocks, crf.decode(blocks)) if y))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")
