"""Raw format, stores and the completeness check."""

import gzip
import json
import zlib

import pytest
from helpers import rows
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from twinedge import scratch
from twinedge.operators import embed, graph
from twinedge.plans.entities import EntityGraph
from twinedge.plans.fixture import DerivedGraph
from twinedge.plans.queries import write_raw
from twinedge.schema import AUTHOR, PUBLICATION, RAW_DATASETS
from twinedge.sources import raw, store


@pytest.fixture()
def raw_dir(tmp_path):
    def author(**fields):
        return {"id": "a", "fullname": "F", "name": "N", "surname": "S", "pub_embedding": [0.5, 1.0], **fields}

    payloads = [
        json.dumps(author(id="a0", orcid="0-0")),
        json.dumps(author(id="a1", surname="O'Neil", orcid=None)),
        json.dumps(author(id="a2", fullname="René")),  # é escape, no orcid
        json.dumps(author(id="a3", fullname='say "orcid"', orcid=""), ensure_ascii=False),
        json.dumps(author(id="a4", extra={"orcid": None})),
    ]
    lines = [repr((p, i)) for i, p in enumerate(payloads)]
    lines += ["not a tuple", "('{\"id\": \"a9\"}', 'x')", "('{broken', 7)", "__import__('os').system('true')", ""]
    folder = tmp_path / "authors"
    folder.mkdir()
    with gzip.open(folder / "part-0.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(lines[:4]) + "\n")
    (folder / "part-1").write_text("\n".join(lines[4:]) + "\n", encoding="utf-8")
    rel = tmp_path / "writes_rels"
    rel.mkdir()
    edges = [repr(e) for e in [("a0", "p0"), ("a0", "p0"), ("a'1", "p\\0"), ("a0", "px")]] + ["('a0',)", "('a', 1)"]
    (rel / "part-0").write_text("\n".join(edges) + "\n")
    return str(tmp_path)


def test_scan_nodes(spark, raw_dir):
    found = rows(raw.scan_nodes(spark, raw_dir, AUTHOR).select("idx", "id", "fullname", "surname", "orcid", "feat"))
    feat = [0.5, 1.0]
    assert found == [
        (0, "a0", "F", "S", "0-0", feat),
        (1, "a1", "F", "O'Neil", None, feat),
        (2, "a2", "René", "S", "", feat),
        (3, "a3", 'say "orcid"', "S", "", feat),
        (4, "a4", "F", "S", "", feat),
    ]
    bad = raw.quarantine(raw.parse_nodes(spark.read.text(f"{raw_dir}/authors"), AUTHOR))
    assert bad.count() == 5


def test_scan_edges(spark, raw_dir):
    found = rows(raw.scan_edges(spark, raw_dir, "writes_rels"))
    assert found == [("a'1", "p\\0"), ("a0", "p0"), ("a0", "p0"), ("a0", "px")]
    assert raw.quarantine(raw.parse_edges(spark.read.text(f"{raw_dir}/writes_rels"))).count() == 2


def test_orcids_are_read_without_the_vectors(spark, raw_dir):
    plan = raw.author_orcids(spark, raw_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "pub_embedding" not in plan


def test_resolution_keeps_copies_and_drops_unknown(spark, raw_dir):
    edges = raw.scan_edges(spark, raw_dir, "writes_rels")
    authors = spark.createDataFrame([("a0", 0), ("a'1", 1)], "id string, idx bigint")
    pubs = spark.createDataFrame([("p0", 5), ("p\\0", 6)], "id string, idx bigint")
    assert rows(graph.resolve_edges(edges, authors, pubs)) == [(0, 5), (0, 5), (1, 6)]
    together = graph.resolve_relations({"writes": edges}, authors, pubs)
    assert rows(together) == [("writes", 0, 5), ("writes", 0, 5), ("writes", 1, 6)]
    assert tuple(graph.unresolved_report(edges, authors, pubs).first()) == (4, 3, 0, 1)


def test_completeness(spark, raw_dir, tmp_path):
    (tmp_path / "simrels").mkdir()
    (tmp_path / "simrels" / "part-0").write_text("")
    found = {name: (ok, n) for name, ok, n in rows(raw.dataset_completeness(spark, raw_dir))}
    assert set(found) == set(RAW_DATASETS)
    assert {k for k, (ok, _) in found.items() if ok} == {"authors", "writes_rels"}
    assert all((n > 0) == ok for ok, n in found.values())
    assert not any(ok for _, ok, _ in rows(raw.dataset_completeness(spark, str(tmp_path / "none"))))


def test_odd_lines_are_set_aside(spark):
    import ast

    lines = [
        r"('\ud800', 'b')", r"('a\'b', 'c\\d')", r'''("it's", "x\"y")''', "('a', 'b', 'c')", r"('é', 'b')",
        "('x\x01y', 'b')", r"('a\\', 'b')", r"('a\', 'b')", "(1, 'b')", "", "('', '')",
    ]
    parsed = raw.parse_edges(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = {r["line"]: (r["src_id"], r["dst_id"]) for r in parsed.collect()}
    for line in lines:
        try:
            expected = ast.literal_eval(line)
            expected = tuple(x.encode().decode() for x in expected) if len(expected) == 2 else (None, None)
        except Exception:
            expected = (None, None)
        assert found[line] == expected, line
    nodes = [
        """('{"id": "a"}', 99999999999999999999)""", """('{"id": "a"}', 7)""", """("{'id'}", 7)""",
        """('{"id": "a, b"}', 9)""", r"""('{"id": "it\'s \\n"}', 3)""",
    ]
    parsed = raw.parse_nodes(spark.createDataFrame([(x,) for x in nodes], "value string"), "author", only=("orcid",))
    found = {r["line"]: (r["idx"], r["id"]) for r in parsed.collect()}
    assert [found[x] for x in nodes] == [(None, None), (7, "a"), (7, None), (9, "a, b"), (3, "it's \n")]


def test_json_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    raw.write_json_gz(spark.createDataFrame([("é", None)], "a string, b string"), path)
    # empty partitions write empty parts
    parts = sorted((tmp_path / "out").glob("part-*.json.gz"))
    assert "".join(gzip.open(part, "rt", encoding="utf-8").read() for part in parts) == '{"a":"é","b":null}\n'


def test_graph_store(spark, tmp_path):
    stored = store.GraphStore(spark, str(tmp_path / "graph"))
    assert not stored.has_graph()
    with pytest.raises(FileNotFoundError):
        stored.edges()
    built = []

    def build():
        built.append(1)
        nodes = {AUTHOR: spark.range(len(built)).withColumnRenamed("id", "idx"), PUBLICATION: spark.range(1)}
        edges = {"writes": spark.createDataFrame([(0, 1), (0, 1)], "src bigint, dst bigint")}
        return nodes, graph.edge_table(edges)

    stored.load_or_build(build).load_or_build(build)
    assert len(built) == 1 and stored.nodes(AUTHOR).count() == 1
    assert rows(graph.subgraph(stored.edges(), "is_written_by")) == [(1, 0), (1, 0)]
    plan = graph.subgraph(stored.edges(), "writes")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(etype" in plan
    stored.load_or_build(build, force_reload=True)
    assert len(built) == 2 and stored.nodes(AUTHOR).count() == 2


def test_half_written_graph_is_not_stored(spark, tmp_path):
    stored = store.GraphStore(spark, str(tmp_path / "graph"))
    nodes = {AUTHOR: spark.range(1)}
    broken = spark.range(1).selectExpr("'writes' AS etype", "raise_error('lost') AS src", "id AS dst")
    with pytest.raises(Exception):
        stored.save(nodes, broken)
    assert not stored.has_graph()


def test_model_store_keeps_the_newest(spark, tmp_path):
    data = spark.createDataFrame([(0.0, Vectors.dense(0, 1)), (1.0, Vectors.dense(1, 0))], ["label", "features"])
    model = MultilayerPerceptronClassifier(layers=[2, 2, 2], maxIter=1, seed=1).fit(data)
    root = str(tmp_path)
    for epoch in (1, 2, 12):
        store.save_model(spark, model, root, epoch)
    assert store.stored_models(spark, root) == ["MultilayerPerceptronClassificationModel-epoch12"]


def test_weights_roundtrip(spark, tmp_path):
    weights = embed.formula_weights(5, 3)
    embed.save_weights(spark, weights, str(tmp_path / "w"))
    again = embed.load_weights(spark, str(tmp_path / "w"))
    for name, lin in embed._named_linears(weights).items():
        other = embed._named_linears(again)[name]
        assert (lin.weight == other.weight).all() and (lin.bias == other.bias).all()


def test_metrics_append(spark, tmp_path):
    path = str(tmp_path / "m")
    store.append_metrics(spark, path, [("r", 1, "train", "loss", 0.5)])
    store.append_metrics(spark, path, [("r", 2, "train", "loss", 0.4)])
    assert rows(store.training_metrics(spark, path)) == [("r", 1, "train", "loss", 0.5), ("r", 2, "train", "loss", 0.4)]


# ---- bucketed tables and retention ---------------------------------------

def stored_graph(spark, root, n=50):
    nodes = {"author": spark.range(n).select(F.col("id").alias("idx"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))}
    edges = spark.range(n * 4).select(F.lit("cites").alias("etype"), (F.col("id") % n).alias("src"), (F.col("id") * 7 % n).alias("dst"))
    found = store.GraphStore(spark, root)
    found.save(nodes, edges)
    return found


def test_bucketed_tables_meet_without_exchange(spark, tmp_path):
    from twinedge.operators.embed import neighbour_mean

    found = stored_graph(spark, str(tmp_path / "g"))
    views = lambda: found.edges().select(F.lit("v").alias("view"), "src", "dst", F.lit(1).cast("long").alias("w"))
    built = []
    edges = found.bucketed("views", "src", lambda: built.append(1) or views(), 4)
    found.bucketed("views", "src", lambda: built.append(1) or views(), 4)
    nodes = found.bucketed("features", "idx", lambda: found.nodes("author"), 4)
    assert built == [1]
    assert rows(edges) == rows(views()) and rows(nodes.select("idx")) == [(k,) for k in range(50)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mean = neighbour_mean(edges, nodes, 2)
        plan = mean._jdf.queryExecution().executedPlan().toString()
        loose = neighbour_mean(views(), found.nodes("author"), 2)
        # the one exchange left is that of the sums, by the node they belong to
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
        assert loose._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3
        assert rows(mean) == rows(loose)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # another session's catalog does not know the table yet
    again = store.GraphStore(spark.newSession(), str(tmp_path / "g"))
    assert again.bucketed("views", "src").count() == 200
    with pytest.raises(FileNotFoundError):
        found.bucketed("other", "src")


def test_versions_expire_unless_read(spark, tmp_path):
    root = str(tmp_path / "g")
    found = stored_graph(spark, root)
    with found.reading() as version:
        assert version == 0
        held = found.edges()
        for n in (60, 70):
            stored_graph(spark, root, n)
        (tmp_path / "g" / "graph-cut-off").mkdir()
        assert len(found.expire()) == 1  # version 1; 0 is read, 2 is the latest, the last may be being written
        assert held.count() == 200 and found.edges().count() == 280
    gone = found.expire(lease_hours=0)
    assert len(gone) == 2 and "graph-cut-off" in gone
    assert found.edges().count() == 280 and found.expire() == []
    with pytest.raises(ValueError):
        found.expire(0)


def test_missing_datasets_and_lines_of_shared_vectors(spark, tmp_path):
    """A look at one line tells what is missing; the text of a vector is made once."""
    from twinedge.plans import queries

    class Graph:
        publications = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "idx bigint, id string")
        vectors = spark.createDataFrame([(0, [0.1, 2.0]), (1, None), (2, [0.1, 2.0])], "idx bigint, feat array<float>")

        def with_vectors(self, made):
            return self.vectors.select("idx", made)

    raw.write_lines(queries.publication_lines(Graph()), str(tmp_path), "publications")
    (tmp_path / "authors").mkdir()
    missing = raw.missing_datasets(spark, str(tmp_path))
    assert "publications" not in missing and "authors" in missing and len(missing) == 9
    read = raw.scan_nodes(spark, str(tmp_path), "publication").select("idx", "id", "feat").collect()
    assert sorted((r["idx"], r["id"], r["feat"] and [round(x, 3) for x in r["feat"]]) for r in read) == [(0, "p0", [0.1, 2.0]), (1, "p1", None), (2, "p2", [0.1, 2.0])]
    assert "bert_embedding" not in spark.read.text(f"{tmp_path}/publications").where("value like '%p1%'").first()[0]


def test_nodes_are_written_once_to_the_store(spark, tmp_path, monkeypatch):
    """They were parsed to a table of their own and copied from there."""
    folder = write_raw(DerivedGraph(spark, "/root/testdata/sf0.001"), *RAW_DATASETS)
    written = []
    monkeypatch.setattr(scratch, "new_path", lambda spark, name: written.append(name) or f"{tmp_path}/{name}-{len(written)}")
    root = tmp_path / "graph"
    with pytest.raises(ValueError):
        EntityGraph.open(spark, folder, str(root))
    assert not list(root.glob("graph-*"))  # nothing is left of a refused build
    entities = EntityGraph.open(spark, folder, str(root), tolerance=10_000)
    assert "relations" in written and not {"authors", "publications"} & set(written)
    assert rows(entities.authors.select("idx", "id")) == rows(raw.scan_nodes(spark, folder, AUTHOR).select("idx", "id"))
    assert entities.authors.columns == ["idx", "id", "fullname", "name", "surname", "feat", "orcid"]
    assert entities.store.report("quarantine").count() == 4


def test_raw_text_of_numbers_is_packed_well(spark, tmp_path):
    numbers = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.round(F.sin(F.col("id") * 64 + k), 8)))
    raw.write_lines(spark.range(0, 3000, 1, 1).select(numbers.alias("value")), str(tmp_path), "numbers")
    text = "".join(f"{r['value']}\n" for r in spark.read.text(f"{tmp_path}/numbers").collect()).encode()
    assert sum(f.stat().st_size for f in tmp_path.glob("numbers/part*")) < 0.95 * len(zlib.compress(text, 1))
