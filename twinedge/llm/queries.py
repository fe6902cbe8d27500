"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.llm import (
    alignment,
    decontaminate,
    language,
    lines,
    merkle,
    neardup,
    ngrams,
    packing,
    pages,
    quality,
    rollup,
    search,
    secret_scan,
)
from twinedge.scratch import materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, from the stored ledger."""
    rows = quality.stored_ledger(table(spark, sf_dir, "documents"))
    return quality.ablation(rows, (quality.STANDARD, quality.BASE))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.documents_evidence(table(spark, sf_dir, "documents")), ["doc_id"])


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.pages_evidence(table(spark, sf_dir, "pages")), ["page_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come in, repeated texts go, and the counts
    of the rest are revised to include the end id; the second is sent twice."""
    version = "word_bpe_49k/1"
    counts = materialise(rollup.document_counts(table(spark, sf_dir, "documents"), version), "token-counts")
    totals = rollup.Rollup(spark, new_path(spark, "token-rollup"))
    totals.commit("load", rollup.inserts(counts))
    firsts = counts.groupBy("text_hash", "n_tokens").agg(F.min("doc_id").alias("first"))
    marked = materialise(
        counts.join(firsts, ["text_hash", "n_tokens"]).withColumn("again", F.col("doc_id") > F.col("first")), "token-repeats"
    )
    totals.commit("repeats", rollup.deletes(marked.where("again")))
    totals.commit("repeats", rollup.deletes(marked.where("again")))
    rest = marked.where("NOT again")
    totals.commit("end-id", rollup.revisions(rest, rest.withColumn("n_tokens", F.col("n_tokens") + 1)))
    totals.compact()
    return totals.totals()


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_fingerprints": op12_merkle_fingerprints,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "language_id_of_pages": language_id_of_pages,
    "rule_ablation": rule_ablation,
}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOC_WORDS = f"""SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS w FROM documents"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
            FROM documents
        ), g AS (
            SELECT doc_id, i, w[i:i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
        ), twice AS (
            SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
        ), r AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper,
                len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter
            FROM d LEFT JOIN r USING (doc_id)
        ), f AS (
            SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                + CASE WHEN 100 * n_upper > 70 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_letter < 50 * n_words THEN 128 ELSE 0 END AS failed
            FROM m
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM f""",
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE d AS ({DOC_WORDS}), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)
        ), both_ways AS (
            SELECT u, v FROM links UNION ALL SELECT v, u FROM links
        ), reach AS (
            SELECT u AS doc_id, u AS other FROM both_ways UNION SELECT r.doc_id, e.v FROM reach r JOIN both_ways e ON e.u = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
            coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op4_benchmark_decontamination": f"""
        WITH d AS ({DOC_WORDS}), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS w FROM benchmark
        ), ds AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
        ), bs AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
        ), n AS (
            SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
        ), hits AS (
            SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL
        ), short AS (
            SELECT DISTINCT d.doc_id, b.item_id FROM b JOIN d ON len(b.w) BETWEEN 1 AND 4
                AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
        )
        SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared / n_item AS containment
        FROM hits JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
        UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM short""",
    "op11_ranked_search": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, {LETTERS}), '{TERM}') AS w FROM documents WHERE text IS NOT NULL
        ), own AS (
            SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0
        ), total AS (
            SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM own
        ), b AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) AS term FROM benchmark
        ), tf AS (
            SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM own) WHERE term IN (SELECT term FROM b) GROUP BY ALL
        ), weight AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term
        ), norm AS (
            SELECT doc_id, 10 + 90 * n * n_docs // all_terms AS m FROM own, total
        ), s AS (
            SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM b JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (doc_id) GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s
        WHERE score > 0 QUALIFY rank <= 10""",
}


def _ablation_sql() -> str:
    """From the failure bits of operator 2's SQL."""
    listed = [(p.name, p.version, r, quality.BITS[r], p.mask) for p in (quality.STANDARD, quality.BASE) for r in p.rules]
    rows = ", ".join(f"('{name}', {version!r}, '{rule}', {bit}, {mask})" for name, version, rule, bit, mask in listed)
    return f"""
        WITH judged AS ({ORACLE_SQL["op2_quality_rules"]}), r AS (SELECT * FROM (VALUES {rows}) AS x(policy, version, rule, rule_bit, mask))
        SELECT policy, version, rule, count(*) FILTER (failed & mask & rule_bit <> 0) AS n_failed,
            count(*) FILTER (failed & mask = rule_bit) AS n_only, count(*) FILTER (failed & mask & ~rule_bit = 0) AS n_kept_without
        FROM judged, r GROUP BY ALL"""


ORACLE_SQL["rule_ablation"] = _ablation_sql()
