"""Sums over edges packed by the node they lead into, against those by a join."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinedge.operators import embed, parts
from twinedge.plans import train
from twinedge.schema import VIEWS as VIEW_PATHS
from twinedge.scratch import SWEEP, materialise

VIEWS = list(VIEW_PATHS)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, unknown and null ends, null weights, and vectors that are null, short,
    there twice or have gaps."""
    rng = np.random.default_rng(1)
    ends = zip(rng.integers(0, 40, 400).tolist(), rng.integers(0, 12, 400).tolist(), rng.integers(1, 5, 400).tolist())
    rows = [("ab"[k % 2] if k % 10 else None, s, None if k % 19 == 5 else d, w) for k, (s, d, w) in enumerate(ends)]
    rows += [("a", None, 1, 1), ("a", 3, 777, None), ("a", 99999, 5, 1), ("b", -7, 3, 2)]
    views = spark.createDataFrame(rows, "view string, src bigint, dst bigint, w bigint")

    def vector(i):
        return None if i % 9 == 4 else [float(rng.normal()) if (i + k) % 7 else None for k in range(5 if i % 11 else 3)]

    ids = [*range(40), 3, 4, 5, 5, -7, -7]
    plain = materialise(spark.createDataFrame([(i, vector(i)) for i in ids], "idx bigint, vec array<double>"), "plain")
    named = [(v, i, vector(i)) for v in ("a", "b", None) for i in ids]
    return views, plain, materialise(spark.createDataFrame(named, "view string, idx bigint, vec array<double>"), "named")


def by_key(df):
    found = [((r["view"], r["idx"]), r["vec"]) for r in df.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


def packed_only(monkeypatch):
    monkeypatch.setattr(embed, "MANY_NUMBERS", 0)


@pytest.mark.parametrize("small", [False, True])
def test_packed_means_equal_joined_ones(odd, monkeypatch, small):
    views, *tables = odd
    joined = [by_key(embed.neighbour_mean(views, t, 5)) for t in tables]
    packed_only(monkeypatch)
    if small:  # several parts, groups, passes, chunks and turns
        for name, value in {"LEAST_EDGES": 50, "FLUSH": 30, "GROUP_BYTES": 200, "CHUNK_BYTES": 64, "PASS_BYTES": 600, "STEP_BYTES": 80}.items():
            monkeypatch.setattr(parts, name, value)
    for table, expected in zip(tables, joined):
        found = by_key(embed.neighbour_mean(views, table, 5))
        assert found.keys() == expected.keys()
        for key, vec in expected.items():
            assert found[key] == pytest.approx(vec, abs=1e-9)


def test_many_edges_from_one_source_and_into_one_node(spark, monkeypatch):
    """More edges of a node and chunk than are added in turns."""
    packed_only(monkeypatch)
    rows = [("a", s, 0, 1 + s) for s in range(100)] + [("a", 0, d, 1) for d in range(1, 100)] + [("a", 5, 7, 1)] * 50
    views = spark.createDataFrame(rows, "view string, src bigint, dst bigint, w bigint")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "idx bigint, vec array<float>")
    found = by_key(embed.neighbour_mean(views, vectors, 2))
    assert found["a", 0] == pytest.approx([sum(i * (i + 1) for i in range(100)) / 5050, 1.0])
    assert found["a", 7] == pytest.approx([250 / 51, 1.0]) and found["a", 99] == [0.0, 1.0] and len(found) == 100


def test_neither_vectors_nor_sums_are_shuffled(odd, monkeypatch):
    """Wide vectors went to their blocks' tasks with the edges of each block, and the
    blocks of a sum to the task that put them together."""
    packed_only(monkeypatch)
    views, vectors, _ = odd
    plan = embed.neighbour_mean(views, vectors, 768)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("direct_shuffle_partition_id(part" in line for line in exchanges)


def test_shuffle_files_go_with_the_write(spark):
    def left():
        root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(root.apply(i).getName()) for i in range(root.size()) if root.apply(i).getName().startswith("shuffle_")}

    before = left()
    materialise(spark.range(10_000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "swept")
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    assert spark.conf.get(SWEEP, "false") == "false"


@pytest.fixture(scope="module")
def graph_rows(spark):
    """Nodes 0 to 11, of which 5 is there twice and 11 has no edge; 77 is an end, but no node."""
    rng = np.random.default_rng(2)
    ends = zip(rng.integers(0, 11, 200).tolist(), [77, *rng.integers(0, 11, 199).tolist()])
    rows = [(VIEWS[k % len(VIEWS)], s, d, 1 + k % 3) for k, (s, d) in enumerate(ends)]
    views = spark.createDataFrame(rows, "view string, src bigint, dst bigint, w bigint")
    vectors = [(i, rng.normal(size=6).tolist()) for i in [*range(12), 5]]
    return views, spark.createDataFrame(vectors, "idx bigint, vec array<float>")


def test_packed_layers_equal_joined_ones(graph_rows, monkeypatch):
    views, vectors = graph_rows
    weights = embed.formula_weights(6, 4)
    first = {v: pair[0] for v, pair in weights.layers.items()}
    shares = embed.mean_shares(views)

    def found():
        both = embed.view_embeddings(shares, vectors, weights).select("view", "idx", F.array_append("vec", F.col("logit")).alias("vec"))
        return by_key(embed.sage_layer(shares, vectors, first)), by_key(both)

    joined = found()
    packed_only(monkeypatch)
    for old, new in zip(joined, found()):
        assert old.keys() == new.keys() and any(idx == 77 for _, idx in new)
        for key, vec in old.items():
            assert new[key] == pytest.approx(vec, abs=1e-4)


def test_a_layer_sends_nothing_along_edges(graph_rows, monkeypatch):
    """Messages were joined to the edges and shuffled by the node they go to."""
    packed_only(monkeypatch)
    views, vectors = graph_rows
    weights = embed.formula_weights(6, 4)
    plan = embed.view_embeddings(embed.mean_shares(views), vectors, weights)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MergeJoin" not in plan and "HashJoin" not in plan


def test_both_means_of_training_read_edges_packed_once(graph_rows, monkeypatch):
    views, vectors = graph_rows
    plain = train.propagated_features(views, vectors, 6)
    expected = {r["idx"]: r["vec"] for r in plain.collect()}
    packed_only(monkeypatch)
    packed = []
    of = parts.EdgeParts.of
    monkeypatch.setattr(parts.EdgeParts, "of", lambda *a, **k: packed.append(of(*a, **k)) or packed[-1])
    found = {r["idx"]: r["vec"] for r in train.propagated_features(views, vectors, 6).collect()}
    assert len(packed) == 1 and found.keys() == expected.keys()
    assert all(len(found[i]) == len(vec) and sorted(found[i]) == pytest.approx(sorted(vec), abs=1e-6) for i, vec in expected.items())
