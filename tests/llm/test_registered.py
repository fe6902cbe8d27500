"""The registered queries and the pipeline on a small folder of tables."""

import zlib

import brute
import pytest

import corpus_pipeline
from twinedge.llm import queries, tokens


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    texts = dict(corpus)
    items = [(1, " ".join(texts[5].split()[2:12])), (2, " ".join(texts[9].split()[:8])), (3, "never seen words here at all")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), items


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: queries.QUERIES[name](spark, folder[0]).collect()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_dedup_query(run, corpus):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run("op3_minhash_near_dedup")} == brute.near(corpus)


def test_line_dedup_query(run, corpus):
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in run("op9_line_dedup")} == brute.dedup_lines(corpus)


def test_token_counts_query(run, corpus):
    """Distinct texts, each with its end id."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_file())
    firsts = {}
    for i, t in corpus:
        firsts.setdefault(t or "", i)
    expected = {}
    for t, i in firsts.items():
        n, k = expected.get(f"s{i % 3}", (0, 0))
        expected[f"s{i % 3}"] = (n + 1, k + len(plain.encode(t, add_special_tokens=False).ids) + 1)
    assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in run("op7_token_counts")} == expected


def test_secret_query(run, corpus):
    assert all(r["spans"] == "" and r["n_assign"] == r["n_access"] == r["n_hex"] == 0 for r in run("op8_secret_scan"))


def test_language_query(run, corpus):
    rows = {r["doc_id"]: r for r in run("op6_language_id")}
    assert all(rows[i]["kept"] for i, t in corpus[:50]) and not any(rows[i]["kept"] for i, t in corpus if not brute.words(t))


def test_pipeline(spark, folder, corpus, tmp_path):
    root, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, stages, seen = docs.columns, dict(corpus_pipeline.STAGES), dict(corpus)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]

    def after(name):
        nonlocal docs
        stages[name](spark, docs, root).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = after("language_id")
    assert set(kept) <= set(seen) and all(kept[i] == seen[i] for i in kept)
    assert set(range(50)) <= set(kept) and not any(i in kept for i, t in corpus if not brute.words(t))
    expected = {i: t for i, (n, gone, t) in brute.dedup_lines(kept.items()).items() if not gone or gone < n}
    assert after("line_dedup") == expected
    expected = {i: expected[i] for i, (_, c) in brute.near(expected.items()).items() if i == c}
    assert after("near_dedup") == expected
    leaked = {x[0] for x in brute.leaks(expected.items(), items)}
    assert leaked
    expected = {i: t for i, t in expected.items() if i not in leaked}
    assert after("decontamination") == expected
    pieces = stages["packing"](spark, docs, root).collect()
    assert {p["doc_id"] for p in pieces} == set(expected)
    whole = {(p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces}
    assert {(p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in corpus_pipeline.run(spark, root).collect()} == whole


def test_packing_query(run, corpus):
    pieces = run("op1_packing")
    assert {p["doc_id"] for p in pieces} == {i for i, _ in corpus}
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    empty = [p for p in pieces if p["doc_tokens"] == 1]
    assert empty and all(p["ids_crc32"] == zlib.crc32(tokens.END.to_bytes(4, "little")) for p in empty)
