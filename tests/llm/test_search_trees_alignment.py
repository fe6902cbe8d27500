"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinedge.llm import alignment, merkle, search


def tuples(df):
    return [tuple(r) for r in df.collect()]


# 11 ranked search

def items_of(corpus):
    texts = dict(corpus)
    return [
        (1, " ".join(texts[5].split()[2:12])), (2, " ".join(texts[9].split()[:8]) + " X É q"), (3, "never seen words here"),
        (4, None), (5, "..."), (6, "x x X x"), (7, texts[44]), (7, "two words"), (None, "one"), (8, "Word's 2nd É"),
    ]


@pytest.mark.parametrize("block", [4096, 40])
def test_search(spark, docs, corpus, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in items_of(corpus)], "item_id bigint, text string, rank int, bound int")
    assert sorted(tuples(search.ranked(docs, items)), key=str) == sorted(brute.search(corpus, items_of(corpus)), key=str)


def test_search_ties_and_copies(spark):
    """Many equal scores: the smallest ids; repeated rows and null ids are documents."""
    rows = [(i, "same words in all of these") for i in range(300, 0, -1)] + [(7, "same words in all of these"), (None, "same words"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([(1, "same words"), (2, "of these")], "item_id bigint, text string")
    for k in (3, 10):
        assert sorted(tuples(search.ranked(docs, items, k)), key=str) == sorted(brute.search(rows, [(1, "same words"), (2, "of these")], k), key=str)


def test_search_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "a b same")], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(tuples(search.ranked(odd, items)), key=str) == sorted(brute.search(rows, [(1, "a b same")]), key=str)
    assert search.ranked(nothing, items).count() == 0
    assert search.ranked(odd, items.where("false")).count() == 0


def test_bounds_are_never_below_scores(corpus):
    """Also where coordinates are saturated."""
    import pyarrow as pa

    texts = [t or "" for _, t in corpus]
    words = search.terms_of(pa.array(texts))
    owner, term, times = search.occurrences(words)
    wanted = np.unique(term)
    held = search.Search(wanted, np.full(len(wanted), 7), [np.arange(k, len(wanted), 3) for k in range(3)], len(texts), int(words.counts.sum()))
    doc, at, part = held.scores(words)
    assert times.max() > search.SATURATED
    for k in range(len(texts)):
        own = owner == k
        bits = 8
        cells = np.zeros((search.ROWS, 1 << bits), np.uint8)
        for row in range(search.ROWS):
            np.maximum.at(cells[row], search.coordinate(term[own], row, bits), np.minimum(times[own], 255).astype(np.uint8))
        upper = held.bounds([cells.tobytes()], bits, words.counts[k : k + 1])
        exact = np.zeros(len(wanted), np.int64)
        exact[at[doc == k]] = part[doc == k]
        assert all(upper[i, 0] >= exact[item].sum() for i, item in enumerate(held.items))


# 12 Merkle fingerprints

def expected_fingerprints(rows):
    ring = sorted(((i, t or "") for i, t in rows), key=lambda x: x[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(ring):
        after = ring[(k + 1) % len(ring)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following = brute.tree(t), brute.tree(edited), brute.tree(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0], changed[0], brute.likeness(own, changed), brute.likeness(own, following), t, edited)
    return out


@pytest.mark.parametrize("arc", [64, 2])
def test_fingerprints(docs, corpus, arc, monkeypatch):
    monkeypatch.setattr(merkle, "ARC_ROWS", arc)
    expected = expected_fingerprints(corpus)
    found = {r["doc_id"]: r for r in merkle.edit_fingerprints(docs).collect()}
    assert set(found) == set(expected)
    for i, (n, sha, own, changed, near_edited, near_next, text, edited) in expected.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, own, changed), i
        assert r["near_edited"] == pytest.approx(near_edited) and r["near_next"] == pytest.approx(near_next), i
        assert (r["near_edited"] == 1) == (text == edited) == (r["edit_start"] is None)
        if text != edited:
            # the first differing piece begins at or before the first differing character
            first = next((k for k, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
            assert r["edit_start"] <= first and text[: r["edit_start"]] == edited[: r["edit_start"]]


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    rows = merkle.edit_fingerprints(odd).collect()
    assert len(rows) == 7 and merkle.edit_fingerprints(nothing).count() == 0
    # ids descend, null ids last, equal rows follow each other
    assert sorted((r["near_next"] == 1 for r in rows if r["doc_id"] == 8)) == [False, True]
    single = merkle.edit_fingerprints(spark.createDataFrame([(1, "abc d")], "doc_id bigint, text string")).first()
    assert single["near_next"] == 1 and single["near_edited"] < 1


def test_changed_paragraphs(spark):
    text = "Aa bb.\nCc dd.\n\n# Head\nlast line"
    old = spark.createDataFrame([(1, text), (2, "same"), (3, None)], "doc_id bigint, text string")
    new = spark.createDataFrame([(1, text.replace("dd", "xx")), (2, "same"), (3, ""), (4, "new")], "doc_id bigint, text string")
    found = sorted((r["doc_id"], r["section"], r["paragraph"], r["length"], r["n_old"]) for r in merkle.changed_paragraphs(old, new).collect())
    assert found == [(1, 1, 0, 7, 5), (4, 0, 0, 3, 0)]


def test_insertion_moves_no_other_branch(spark):
    text = "\n".join(f"line {k} of the text, with words {k * k}" for k in range(300))
    rows = spark.createDataFrame([(text, "Inserted line\n" + text)], "a string, b string")
    for column in "ab":
        rows = merkle.with_tree(rows, column, f"{column}_tree")
    pieces = rows.select(merkle.pieces("a_tree").alias("a"), merkle.pieces("b_tree").alias("b"))
    r = pieces.select(merkle.likeness(F.lit(False), "a", "b").alias("x"))
    assert r.first()["x"] > 0.99


# 13 tokenizer alignment

ODD_TEXTS = [" ", "  a", "a  b", "a \n b", "end ", "\n", "a▁b", "<|endoftext|> <s> </s>", "<0x41>", "漢字 かな", " x y", "á b", "ﬁ x", "\x00 y", "don't it's", "x" * 5000, "tab\tx y"]


def expected_alignment(tok, rows):
    found = [(i, brute.align(tok, t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in set(x[1]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, x in found:
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = x
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest(),
        ))
    return out


def test_alignment(spark, corpus):
    tok = alignment.tokenizers(*alignment.default_files())
    rows = [(i, t) for i, t in corpus if len(t or "") < 5000] + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(0, corpus[0][1]), (None, "two words")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, key int, chunk int").repartition(4)
    assert sorted(tuples(alignment.alignment(docs)), key=str) == sorted(expected_alignment(tok, rows), key=str)
    pairs = Counter(p for _, t in rows for x in [brute.align(tok, t)] if x for p in set(x[1]))
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in alignment.correspondences(docs).collect()} == pairs


def test_alignment_odd_rows(spark, odd, nothing):
    tok = alignment.tokenizers(*alignment.default_files())
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(tuples(alignment.alignment(odd)), key=str) == sorted(expected_alignment(tok, rows), key=str)
    assert alignment.alignment(nothing).count() == 0


def test_long_text_is_aligned_whole():
    tok = alignment.tokenizers(*alignment.default_files())
    text = "word and \n" * 30000
    found = alignment.align(tok, [text])
    groups, links = brute.align(tok, text)
    assert found.counts[0].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links)]
