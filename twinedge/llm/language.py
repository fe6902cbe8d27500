"""Operator 6, language ID by Bayesian fusion of text and context.

The evidence of a document: the likelihood of its text under byte-trigram
models, the language it declares, the suffix of its address and its host.
Each is a term of one log posterior:

* text: trigram log-likelihoods of its distinct words, taken once per word and
  summed over the text; divided by ``TEMPER``, since neighbouring trigrams are
  not independent;
* declaration and suffix: how often documents whose text speaks for language l
  declare d, or carry suffix s, by a grouped aggregation over all documents;
* host: the share of languages on the host, shrunk towards the share on its
  domain, which is shrunk towards that of all documents.

The trigram models are fitted on at most ``TRAIN_ROWS`` distinct texts of each
label, drawn by a hash; every label with ``LEAST_ROWS`` rows in the whole table
is learnt. Counts of declarations, suffixes and hosts cover all documents. A document is rejected if it has no word, if no known language
explains its text better than bytes drawn at random, or if the best language
has a posterior below ``CONFIDENT``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinedge.llm.words import map_slices, sums, text_bytes, text_slices, without, words_of
from twinedge.scratch import materialise

TRAIN_ROWS = 4000
"""Distinct texts of a label that its model is fitted on, at most."""
LEAST_ROWS = 5
"""Labels with fewer rows in the whole table are not learnt."""
TEMPER = 20.0
CONFIDENT = 0.5
STRENGTH = 10.0
"""How many documents a parent's shares count for on a host or domain."""
BUCKETS = 1 << 16
FIELDS = ("text", "declared", "host", "domain", "suffix")


def _trigrams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of `` word `` for each word, and where each word's begin."""
    data, ends = text_bytes(vocabulary)
    n = len(ends) - 1
    size = np.diff(ends)
    padded = np.full(len(data) + 2 * n, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, size)] = data
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n), size)
    gram = (padded[at] << 16) | (padded[at + 1] << 8) | padded[at + 2]
    return (gram * np.uint32(2654435761)) >> np.uint32(16), ends


def _training_texts(labelled: DataFrame, limit: int) -> tuple[list[str], DataFrame]:
    """Labels with enough rows, and ``(declared, text)``: about the ``limit``
    distinct texts of each such label with the smallest hashes, or all it has.

    Copies are told by their hash, so a text with many rows counts once, and
    only hashes are shuffled until a label's last hash is known.
    """
    hashed = labelled.withColumn("drawn", F.xxhash64("text"))
    sizes = hashed.groupBy("declared").agg(F.count("*").alias("rows"), F.approx_count_distinct("drawn").alias("texts"))
    # one row per label
    sizes = [r for r in sizes.collect() if r["rows"] >= LEAST_ROWS]
    if not sizes:
        return [], labelled.where("false")
    spark = labelled.sparkSession
    # where about twice the limit pass: the exact bound sees a few thousand hashes of a label
    cut = [(r["declared"], min(2**64 * 2 * limit // max(1, r["texts"]), 2**64 - 1) - 2**63) for r in sizes]
    cuts = spark.createDataFrame(cut, "declared string, cut long")
    near = hashed.join(F.broadcast(cuts), "declared").where("drawn <= cut").select("declared", "drawn").distinct()
    place = F.row_number().over(Window.partitionBy("declared").orderBy("drawn"))
    last = near.withColumn("place", place).where(F.col("place") <= limit).groupBy("declared").agg(F.max("drawn").alias("cut"))
    cuts = spark.createDataFrame([(r["declared"], r["cut"]) for r in last.collect()], "declared string, cut long")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # at most ``limit`` of each label
        for batch in batches:
            new = []
            for k, key in enumerate(zip(batch.column("declared").to_pylist(), batch.column("drawn").to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            if new:
                yield batch.take(pa.array(new))

    drawn = hashed.join(F.broadcast(cuts), "declared").where("drawn <= cut").select("declared", "drawn", "text")
    once = drawn.mapInArrow(firsts, "declared string, drawn long, text string")
    texts = once.groupBy("declared", "drawn").agg(F.min("text").alias("text")).select("declared", "text")
    return sorted(r["declared"] for r in sizes), texts


def fit(rows: DataFrame, limit: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from at most ``limit``
    distinct texts of each label in ``(text, declared)``; labels that are blank
    are no labels."""
    labelled = rows.where("text IS NOT NULL AND trim(declared) <> ''").select("text", "declared")
    names, sample = _training_texts(labelled, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            gram, starts = _trigrams(words.vocabulary)
            labels = batch.column("declared").to_pylist()
            for k, label in enumerate(labels):
                own = words.codes[words.starts[k] : words.starts[k + 1]]
                total = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
                distinct, times = np.unique(own, return_counts=True)
                size = np.diff(starts)[distinct]
                at = np.arange(int(size.sum())) + np.repeat(starts[:-1][distinct] - (np.cumsum(size) - size), size)
                total += np.bincount(gram[at], np.repeat(times, size), BUCKETS).astype(np.int64)
        for label, total in counts.items():
            used = np.flatnonzero(total)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(used)), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["label", "bucket", "n"]
                )

    if not names:
        return [], np.zeros((BUCKETS, 0))
    counted = sample.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # at most BUCKETS numbers for each label, in columns
    found = counted.toArrow()
    place = {x: k for k, x in enumerate(names)}
    table = np.zeros((BUCKETS, len(names)))
    for part in found.to_batches():
        column = np.array([place[x] for x in part.column("label").to_pylist()], np.int64)
        table[part.column("bucket").to_numpy(zero_copy_only=False), column] = part.column("n").to_numpy(zero_copy_only=False)
    return names, np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * BUCKETS))


def _likelihoods(rows: DataFrame, keys: list[str], table: np.ndarray) -> DataFrame:
    """``(keys, n_words, n_grams, text_ll)``: one number per language and text."""
    model = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # BUCKETS x languages
    languages = table.shape[1]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        gram, starts = _trigrams(words.vocabulary)
        score = np.empty((len(words.counts), languages))
        for k in range(languages):
            per_word = sums(model.value[gram, k].astype(np.float64), starts)
            score[:, k] = sums(per_word[words.codes], words.starts) if len(words.codes) else 0.0
        grams = sums(np.diff(starts)[words.codes], words.starts) if len(words.codes) else np.zeros(len(words.counts), np.int64)
        flat = pa.array(score.ravel())
        offsets = pa.array(np.arange(len(words.counts) + 1, dtype=np.int32) * languages)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keys), pa.array(words.counts), pa.array(grams), pa.ListArray.from_arrays(offsets, flat)],
            names=[*keys, "n_words", "n_grams", "text_ll"],
        )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_words long, n_grams long, text_ll array<double>"
    return map_slices(rows.select(*keys, "text"), work, schema)


def _posterior(score: Column) -> Column:
    """Log scores to probabilities."""
    weight = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
    total = F.aggregate(weight, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weight, lambda w: w / total)


def _shares(rows: DataFrame, key: str, languages: int) -> DataFrame:
    """Text-based language weights of all documents, summed by ``key``."""
    total = [F.sum(F.get("text_p", F.lit(k))).alias(f"_{k}") for k in range(languages)]
    return rows.where(f"{key} IS NOT NULL AND n_words > 0").groupBy(key).agg(F.array(*total).alias(f"{key}_n"))


def identify(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_words, language, probability, declared, kept)``, a row for each
    row of ``rows(keys, text, declared, host, domain, suffix)``.

    Every field but the keys may be null: a null says nothing, and a null text
    has no words. Rows without a word have language null and are rejected.
    Without any labelled row nothing can be told: language is null, and rows
    with words are kept. Repeated rows stay; other columns are ignored.
    """
    names, table = fit(rows)
    languages = len(names)
    context = [c for c in FIELDS if c != "text"]
    if not languages:
        plain = _likelihoods(rows, [*keys, "declared"], table)
        return plain.select(
            *keys, "n_words", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"),
            "declared", (F.col("n_words") > 0).alias("kept"),
        )
    scored = _likelihoods(rows, [*keys, *context], table)
    tempered = F.transform("text_ll", lambda x: x / TEMPER)
    scored = materialise(scored.withColumn("text_p", _posterior(tempered)), "language-text")

    everything = scored.where("n_words > 0").agg(*[F.coalesce(F.sum(F.get("text_p", F.lit(k))), F.lit(0.0)).alias(f"_{k}") for k in range(languages)]).first()
    total = np.array([everything[f"_{k}"] for k in range(languages)])
    overall = ((total + 1) / (total.sum() + languages)).tolist()

    def lit(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def shrunk(counts: Column, parent: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.when(counts.isNull(), parent).otherwise(
            F.transform(F.arrays_zip(counts.alias("c"), parent.alias("p")), lambda x: (x["c"] + STRENGTH * x["p"]) / (n + STRENGTH))
        )

    def given(counts: Column) -> Column:
        # P(this value | language), up to a factor that all languages share
        return F.when(counts.isNull(), lit([0.0] * languages)).otherwise(
            F.transform(F.arrays_zip(counts.alias("c"), lit(total.tolist()).alias("t")), lambda x: F.log((x["c"] + 1) / (x["t"] + languages)))
        )

    # one row per host, domain, declaration or suffix on the right
    joined = scored
    for key in context:
        joined = joined.join(_shares(scored, key, languages), key, "left")
    prior = shrunk(F.col("host_n"), F.col("domain_p"))
    fused = (
        joined.withColumn("domain_p", shrunk(F.col("domain_n"), lit(overall)))
        .withColumn("prior", prior).withColumn("by_declared", given(F.col("declared_n"))).withColumn("by_suffix", given(F.col("suffix_n")))
        .withColumn("score", F.transform(
            F.arrays_zip("text_ll", "prior", "by_declared", "by_suffix"),
            lambda x: x["text_ll"] / TEMPER + F.log(x["prior"]) + x["by_declared"] + x["by_suffix"],
        ))
        .withColumn("posterior", _posterior(F.col("score")))
    )
    best = F.array_max("posterior")
    place = F.array_position("posterior", best).cast("int")
    known = F.array_max("text_ll") > F.col("n_grams") * float(-np.log(BUCKETS))
    language = F.when((F.col("n_words") > 0) & known, F.element_at(F.array(*[F.lit(x) for x in names]), place))
    return fused.select(
        *keys, "n_words", language.alias("language"), F.when(language.isNotNull(), best).alias("probability"), "declared",
        (language.isNotNull() & (best >= CONFIDENT)).alias("kept"),
    )


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents: ``lang`` is what they declare and ``source`` is their host;
    they have no address. Either column may be missing."""
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text("lang").alias("declared"),
        text("source").alias("host"), none.alias("domain"), none.alias("suffix"),
    )


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Pages: the visible text, the ``lang`` of the markup, and the address."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    full = F.when(host != "", host)
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), bare.alias("text"), F.when(declared != "", declared).alias("declared"),
        full.alias("host"), F.regexp_extract(full, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(full, r"([^.]+)$", 1).alias("suffix"),
    )


def with_known_language(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected; rows and columns as they are.
    Rows with equal doc_id are kept or dropped together; a null doc_id stays."""
    gone = identify(documents_evidence(docs), ["doc_id"]).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return without(docs, gone)
