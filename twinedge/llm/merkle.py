"""Operator 12, document fingerprints: a Merkle tree over paragraphs and sections.

Native: DataFrame functions only. A text is cut into sections, a section into
paragraphs (lines) and a paragraph into pieces; all cuts are places between
characters, so the parts of a level in a row are the text again. A paragraph's
hash is the SHA-256 of its text, a section's of its paragraphs' hashes, the
root's of the sections' hashes: equal roots mean equal texts, and where roots
differ, following the differing branches leads to the edit.

Sections begin after an empty line, at a heading and at any line that begins
with a digit or one of the letters A-F. Pieces end after a sign that is neither
letter nor digit and white space, and after a word in d, n, r or y. Both depend on the characters at
the cut alone, so inserted text moves no other cut.

Likeness is the share of characters in pieces that both texts have: pieces
carry 44 bits of hash and their length, as one number.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_CUT = r"(?<=\n[\x20\t]{0,8}\n)|(?<=\n)(?=[#0-9A-Fa-f])"
PARAGRAPH_CUT = r"(?<=\n)"
PIECE_CUT = r"(?<=[^\p{L}\p{N}\x20\t\n][\x20\t])|(?<=[dnry]\x20)"
LENGTH_BITS = 20
"""A piece of 2^20 characters or more weighs 2^20 - 1."""

ARC_ROWS = 64
MOST_ARCS = 1 << 16
"""Neighbours are found in arcs of about ``ARC_ROWS`` rows, and longer ones where
there would be more than ``MOST_ARCS``."""


def _cut(text: Column, where: str) -> Column:
    return F.filter(F.split(text, where, -1), lambda part: part != "")


def _piece(text: Column) -> Column:
    longest = (1 << LENGTH_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~longest)).bitwiseOR(F.least(F.length(text), F.lit(longest)).cast("long"))


def _weight(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: total + p.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)))


def _paragraph(text: Column) -> Column:
    return F.struct(
        F.sha2(text, 256).alias("hash"),
        F.length(text).cast("long").alias("length"),
        F.transform(_cut(text, PIECE_CUT), _piece).alias("pieces"),
    )


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part["length"])


def _hashes(parts: Column) -> Column:
    return F.transform(parts, lambda part: part["hash"])


def _section(paragraphs: Column) -> Column:
    return F.struct(
        F.sha2(F.concat_ws(",", _hashes(paragraphs)), 256).alias("hash"), _total(paragraphs).alias("length"), paragraphs.alias("paragraphs")
    )


def with_tree(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sections of ``text``, each with hash, length and paragraphs.

    A null text is an empty text, which has no sections. Steps are columns of
    their own, so that nothing is worked out twice.
    """
    lines = F.transform(_cut(F.coalesce(F.col(text).cast("string"), F.lit("")), SECTION_CUT), lambda s: F.transform(_cut(s, PARAGRAPH_CUT), _paragraph))
    return rows.withColumn(out, lines).withColumn(out, F.transform(out, _section))


def root(tree: str) -> Column:
    """The fingerprint: SHA-256 over the sections' hashes, in hex."""
    return F.sha2(F.concat_ws(";", _hashes(F.col(tree))), 256)


def pieces(tree: str) -> Column:
    """The distinct pieces of a tree."""
    return F.array_distinct(F.flatten(F.transform(tree, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["pieces"])))))


def likeness(same: Column, a: str, b: str) -> Column:
    """Twice the weight of the common pieces in the columns ``a`` and ``b``, by
    the weight of both; 1 if, and only if, the texts are the ``same``."""
    shared = _weight(F.array_intersect(a, b))
    share = 2.0 * shared / (_weight(F.col(a)) + _weight(F.col(b)))
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.coalesce(share, F.lit(0.0)), F.lit(0.999)))


def _common(a: Column, b: Column) -> Column:
    """How many parts at the start of two lists are equal."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def with_first_difference(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: (section, paragraph, start) where tree ``b`` leaves tree
    ``a``, counted from 0; null if they are equal.

    Only the first differing branch of each level is followed. ``start`` is the
    code point at which the first differing piece begins.
    """
    A, B = F.col(a), F.col(b)
    rows = rows.withColumn(out, F.struct(_common(_hashes(A), _hashes(B)).alias("section")))
    at = F.col(out)["section"]
    start = _total(F.slice(A, F.lit(1), at))
    own = [F.coalesce(F.get(t, at)["paragraphs"], F.array().cast("array<struct<hash:string,length:bigint,pieces:array<bigint>>>")) for t in (A, B)]
    rows = rows.withColumn(out, F.struct(at.alias("section"), start.alias("start"), own[0].alias("a"), own[1].alias("b")))
    step = F.col(out)
    line = _common(_hashes(step["a"]), _hashes(step["b"]))
    rows = rows.withColumn(
        out,
        F.struct(
            step["section"].alias("section"), line.alias("paragraph"), (step["start"] + _total(F.slice(step["a"], F.lit(1), line))).alias("start"),
            *[F.coalesce(F.get(step[t], line)["pieces"], F.array().cast("array<bigint>")).alias(t) for t in "ab"],
        ),
    )
    piece = _common(step["a"], step["b"])
    found = F.struct(step["section"].alias("section"), step["paragraph"].alias("paragraph"), (step["start"] + _weight(F.slice(step["a"], F.lit(1), piece))).alias("start"))
    return rows.withColumn(out, F.when(root(a) != root(b), found))


def paragraphs(rows: DataFrame, tree: str, *keys: str) -> DataFrame:
    """``(keys, section, paragraph, hash, length)``: the leaves of stored trees."""
    sections = rows.select(*keys, F.posexplode(tree).alias("section", "s"))
    return sections.select(*keys, "section", F.posexplode("s.paragraphs").alias("paragraph", "p")).select(
        *keys, "section", "paragraph", F.col("p.hash").alias("hash"), F.col("p.length").alias("length")
    )


def changed_paragraphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_id, section, paragraph, hash, length, n_old)`` of the paragraphs of
    ``new(doc_id, text)`` in documents whose root differs from that in ``old``,
    where a paragraph's hash is not among the old ones of that document.

    ``n_old`` is the number of the document's paragraphs before (0 if it is
    new). Null ids are never matched; ids are taken as unique in ``old``.
    """
    before = with_tree(old.select(F.col("doc_id").alias("id"), "text"), "text", "tree").select("id", root("tree").alias("root"), "tree")
    after = with_tree(new.select("doc_id", "text"), "text", "tree").withColumn("now", root("tree"))
    moved = after.join(before.select("id", "root"), F.col("doc_id") == F.col("id"), "left").where("root IS NULL OR root <> now")
    held = paragraphs(before, "tree", "id").groupBy("id", F.col("hash").alias("h")).agg(F.lit(True).alias("known"))
    sizes = before.select(F.col("id").alias("i"), _count("tree").alias("n_old"))
    found = paragraphs(moved.select("doc_id", "tree"), "tree", "doc_id")
    fresh = found.join(held, (F.col("doc_id") == F.col("id")) & (F.col("hash") == F.col("h")), "left_anti")
    return fresh.join(sizes, F.col("doc_id") == F.col("i"), "left").select(
        "doc_id", "section", "paragraph", "hash", "length", F.coalesce("n_old", F.lit(0)).alias("n_old")
    )


def _count(tree: str) -> Column:
    return F.aggregate(tree, F.lit(0), lambda n, s: n + F.size(s["paragraphs"])).cast("long")


def with_next_text(rows: DataFrame) -> DataFrame:
    """``(doc_id, text, next_text)``: the text of the next row by descending
    doc_id; after the last comes the first. A single row is its own next.

    The ring of rows is cut into arcs at rows drawn by a hash of their key
    (doc_id, hash of the text), about ``ARC_ROWS`` apart and at most about
    ``MOST_ARCS`` in all, which is all that the driver sees. A row goes to its
    arc, and the first row of an arc also to the end of the arc before, so that
    one shuffle of the texts brings neighbours together. Null ids come last,
    rows of one id in the order of their texts' hashes. Rows that are equal in
    id and text stay in one arc.
    """
    least = F.lit(-(1 << 63)).cast("long")
    keyed = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select("doc_id", "text", F.struct(F.coalesce("doc_id", least).alias("i"), F.xxhash64("text").alias("h")).alias("key"))
    every = max(ARC_ROWS, rows.count() // MOST_ARCS)
    drawn = F.pmod(F.xxhash64("key.i", "key.h"), F.lit(every)) == 0
    ends = keyed.agg(F.max("key").alias("top"), F.collect_set(F.when(drawn, F.col("key"))).alias("some")).first()
    cuts = sorted({(c["i"], c["h"]) for c in [*ends["some"], ends["top"]] if c is not None}, reverse=True)
    # in two levels: an arc's number is found by two short scans
    width = max(1, int(len(cuts) ** 0.5))
    shelves = [cuts[k : k + width] for k in range(0, len(cuts), width)]

    def constant(value: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def named(cut: tuple[int, int]) -> dict[str, int]:
        return {"i": cut[0], "h": cut[1]}

    one = "array<struct<i:bigint,h:bigint>>"
    heads = constant([named(s[0]) for s in shelves], one)
    inside = F.get(constant([[named(c) for c in s] for s in shelves], f"array<{one}>"), F.col("shelf"))
    placed = keyed.withColumn("shelf", F.size(F.filter(heads, lambda c: c >= F.col("key"))) - 1)
    placed = placed.withColumn("within", F.filter(inside, lambda c: c >= F.col("key")))
    placed = placed.withColumn("arc", F.col("shelf") * width + F.size("within") - 1)
    first = F.element_at("within", -1) == F.col("key")
    before = F.pmod(F.col("arc") - 1, F.lit(max(1, len(cuts))))
    here = F.struct(F.col("arc").alias("arc"), F.lit(False).alias("guest"))
    there = F.struct(before.alias("arc"), F.lit(True).alias("guest"))
    both = placed.select("doc_id", "text", "key", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    ring = both.select("doc_id", "text", "key", "at.arc", "at.guest")
    order = Window.partitionBy("arc").orderBy("guest", F.desc("key"), F.desc("text"))
    return ring.withColumn("next_text", F.lead("text").over(order)).where("NOT guest").select("doc_id", "text", "next_text")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edit_section, edit_paragraph, edit_start)`` for every
    row of ``docs(doc_id, text)``.

    The edited text has the last half of the code points replaced by the first
    as many of the next document's. ``near_*`` is the likeness to the edited
    text and to the next document's; ``edit_*`` says where the edited tree
    leaves the other, null if they are equal. A null text is an empty text;
    two empty texts are alike. Repeated rows are documents of their own, whose
    next is the repeated row. Extra columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    # substring, as left() takes no column length
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    for text, tree in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_tree(rows, text, tree)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed", *[root(t).alias(f"{t}_root") for t in ("own", "changed", "following")],
        *[pieces(t).alias(f"{t}_pieces") for t in ("own", "changed", "following")],
    )
    rows = with_first_difference(rows, "own", "changed", "edit")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own_root").alias("fingerprint"), F.col("changed_root").alias("edited_fingerprint"),
        likeness(F.col("own_root") == F.col("changed_root"), "own_pieces", "changed_pieces").alias("near_edited"),
        likeness(F.col("own_root") == F.col("following_root"), "own_pieces", "following_pieces").alias("near_next"),
        F.col("edit.section").alias("edit_section"), F.col("edit.paragraph").alias("edit_paragraph"), F.col("edit.start").alias("edit_start"),
    )
