"""Operator 9, line dedup by content-defined line chunks; DataFrame functions only.

Lines with a word are hashed. A rolling hash over two neighbouring line hashes
puts chunk boundaries, so an inserted or deleted line moves only the boundaries
beside it. A chunk between boundaries misses a passage that starts or ends
between two of them; therefore every line also starts, and ends, the shortest
run of lines that holds more than ``PASSAGE_WORDS`` words. Each line of a
passage of more words than that lies in such a run inside the passage, whatever
stands around it. Chunks of two lines or more, and these runs, are the
candidates; a line alone counts only if it is a passage by itself.

Of candidates with equal hashes the first one, by (doc_id, place), stays; the
others lose their lines after their bytes were compared. Whatever is removed
is therefore still in the corpus.

Scale: a candidate row holds hashes and positions, no text. Equal candidates
are found by a grouped minimum (combined map-side) and one join whose right
side has one row per key, so AQE can split a hot passage. Each document's text
is shuffled once, with its own removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.scratch import discard, materialise, new_path

PASSAGE_WORDS = 50
BOUNDARY = 3
"""One of so many line pairs is a chunk boundary."""

_WORD = r"[^\x20\x09-\x0D]+"


def _units(text: Column) -> Column:
    """Lines with a word: their number, hash and word count."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line, at: F.struct(at.alias("at"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(_WORD)).alias("w")),
    )
    return F.filter(lines, lambda x: x["w"] > 0)


def _run(words: Column) -> Column:
    """Number of leading entries of ``words`` that together exceed the passage length, else null."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    step = lambda acc, w: F.when(acc["sum"] > PASSAGE_WORDS, acc).otherwise(
        F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + w).alias("sum"))
    )
    return F.aggregate(words, zero, step, lambda acc: F.when(acc["sum"] > PASSAGE_WORDS, acc["n"]))


def _candidates(rows: DataFrame) -> DataFrame:
    """``(id, version, s, e, key)``: runs of units [s, e) of each document."""
    # a generator between them, so that the arrays are computed once per row
    # and not again inside each lambda
    arrays = (
        rows.select("id", "version", _units(F.col("text")).alias("u"))
        .where(F.size("u") > 0)
        .select("id", "version", F.inline(F.array(F.struct(F.col("u.h").alias("h"), F.col("u.w").alias("w")))))
    )
    n = F.size("h")
    at = F.sequence(F.lit(0), n - 1)
    reach = PASSAGE_WORDS + 1  # every unit has a word
    forward = F.transform(at, lambda i: F.struct(i.alias("s"), (i + _run(F.slice("w", i + 1, F.lit(reach)))).alias("e")))
    backward = F.transform(
        at,
        lambda i: F.struct(
            (i + 1 - _run(F.reverse(F.slice("w", F.greatest(i - reach + 2, F.lit(1)), F.least(i + 1, F.lit(reach)))))).alias("s"),
            (i + 1).alias("e"),
        ),
    )
    boundary = lambda i: (
        (i == 0)
        | (F.pmod(F.xxhash64(F.get("h", i - 1), F.get("h", i)), F.lit(BOUNDARY)) == 0)
        | (F.get("w", i) > PASSAGE_WORDS)
        | (F.get("w", i - 1) > PASSAGE_WORDS)
    )
    cut = arrays.select("id", "version", "h", F.filter(at, boundary).alias("cuts"), forward.alias("forward"), backward.alias("backward"))
    chunks = F.transform(
        "cuts", lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get("cuts", k + 1), F.size("h")).alias("e"))
    )
    runs = F.array_distinct(
        F.concat(
            F.filter(chunks, lambda c: c["e"] - c["s"] > 1),
            F.filter(F.concat("forward", "backward"), lambda c: c["s"].isNotNull() & c["e"].isNotNull()),
        )
    )
    listed = cut.select("id", "version", "h", F.inline(runs))
    return listed.select("id", "version", "s", "e", F.xxhash64(F.slice("h", F.col("s") + 1, F.col("e") - F.col("s"))).alias("key"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and the columns
    ``n_lines`` (lines with a word) and ``n_removed`` (of these), which take
    the place of columns of these names.

    Every row stays. A null text stays null and an empty one empty, with 0
    lines. Lines without a word stay where they are, unless nothing else is
    left; then the text is empty. Rows with equal doc_id and text are one
    document, so they keep the same lines; a null doc_id comes first. Ties
    between equal passages go to the smallest (doc_id, place).
    """
    spark = docs.sparkSession
    keyed = {"id": F.col("doc_id").cast("long"), "version": F.xxhash64("text")}
    candidates = _candidates(docs.select(*(c.alias(k) for k, c in keyed.items()), F.col("text").cast("string").alias("text")))
    # numbers only, written once: they are grouped, and then looked up
    candidates = materialise(candidates.select("id", "version", "s", (F.col("e") - F.col("s")).alias("n"), "key"), "line-candidates")
    place = F.struct("id", "version", "s")
    repeated = (
        candidates.groupBy("key", "n").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last").select("key", "n", "first")
    )
    runs = (
        candidates.join(repeated, ["key", "n"])
        .select("id", "version", F.struct("key", "n", "s", (F.struct("id", "version", "s") != F.col("first")).alias("later")).alias("run"))
        .groupBy("id", "version").agg(F.collect_list("run").alias("_runs"))
    )
    # one row per document: its own runs, no more than twice its lines
    own = runs.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "_runs")
    path = new_path(spark, "line-runs")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *(c.alias(f"_k_{k}") for k, c in keyed.items()))
    marked = whole.join(own, _same("_k_id", "_id") & _same("_k_version", "_version"), "left").select("row", "_runs")
    marked.write.option("compression", "zstd").parquet(path)
    marked = spark.read.parquet(path)
    discard(candidates)

    # byte comparison: candidates of one key must have one text
    text = F.col("row.text").cast("string")
    filled = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD))
    found = (
        marked.where("_runs IS NOT NULL")
        .select(F.inline(F.array(F.struct(filled.alias("lines"), F.col("_runs").alias("runs")))))
        .select("lines", F.inline("runs"))
        .select("key", "n", F.array_join(F.slice("lines", F.col("s") + 1, F.col("n")), "\n").alias("passage"))
    )
    clashes = (
        found.groupBy("key", "n").agg(F.min("passage").alias("a"), F.max("passage").alias("b")).where("a <> b")
        .agg(F.collect_set(F.struct("key", "n")).alias("_clashes"))
    )
    # different passages under one 64-bit key: about pairs / 2^64, so next to none
    ready = (
        marked.crossJoin(F.broadcast(clashes))
        .select("row", F.inline(F.array(F.struct(
            F.split(text, "\n", -1).alias("_lines"), F.col("_runs"), F.col("_clashes"), F.transform(_units(text), lambda u: u["at"]).alias("_at")
        ))))
    )
    later = F.filter(
        F.coalesce("_runs", F.array().cast(marked.schema["_runs"].dataType)),
        lambda r: r["later"] & ~F.array_contains(F.col("_clashes"), F.struct(r["key"].alias("key"), r["n"].alias("n"))),
    )
    gone = F.array_distinct(F.flatten(F.transform(later, lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1))))
    chosen = ready.select("row", "_lines", "_at", gone.alias("_gone"))
    kept = F.array_except(
        F.sequence(F.lit(0), F.size("_lines") - 1), F.transform("_gone", lambda i: F.get("_at", i))
    )
    left = (
        F.when(F.col("row.text").isNull() | (F.size("_gone") == 0), F.col("row.text"))
        .when(F.size("_gone") == F.size("_at"), F.lit(""))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    )
    return chosen.select(
        *(left.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names),
        F.greatest(F.size("_at"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
