"""The forward function against NumPy."""

import numpy as np
import pytest

from twinedge.operators import embed, graph
from twinedge.schema import VIEWS

N, INPUTS, WIDTH = 12, 6, 4


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, INPUTS)).astype(np.float32).astype(np.float64)
    weight = {v: rng.integers(0, 3, size=(N, N)) * (rng.random((N, N)) < 0.3) + np.eye(N, dtype=int) for v in VIEWS}
    rows = [(v, s, d, int(w[d, s])) for v, w in weight.items() for d in range(N) for s in range(N) if w[d, s]]
    views = spark.createDataFrame(rows, "view string, src bigint, dst bigint, w bigint")
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(N)], "idx bigint, vec array<float>")
    return x, weight, views, vectors


def dense(df, width):
    out = np.full((N, width), np.nan)
    for r in df.collect():
        out[r["idx"]] = r["vec"]
    return out


def forward(x, weight, w):
    h, logits = {}, {}
    for v in VIEWS:
        mean = weight[v] / weight[v].sum(axis=1, keepdims=True)
        a = x
        for n, layer in enumerate(w.layers[v]):
            a = np.maximum(a, 0) if n else a
            a = a @ layer.own.weight.T + layer.own.bias + mean @ (a @ layer.near.weight.T)
        h[v] = a
        logits[v] = (a @ w.attention[v].weight.T + w.attention[v].bias)[:, 0]
    top = np.exp(np.stack([logits[v] for v in VIEWS]))
    share = top / top.sum(axis=0)
    z = sum(share[k][:, None] * h[v] for k, v in enumerate(VIEWS))
    return h, share, z


def test_neighbour_mean(world):
    x, weight, views, vectors = world
    found = embed.neighbour_mean(views, vectors, INPUTS)
    for v in VIEWS:
        expected = weight[v] @ x / weight[v].sum(axis=1, keepdims=True)
        np.testing.assert_allclose(dense(found.where(found.view == v), INPUTS), expected, atol=1e-6)


@pytest.mark.parametrize("block", [1, 4, 5, 6])
def test_blocks_of_any_size(world, monkeypatch, block):
    """Also where the last block is shorter."""
    x, weight, views, vectors = world
    monkeypatch.setattr(embed, "BLOCK", block)
    found = embed.neighbour_mean(views, vectors, INPUTS)
    for v in VIEWS:
        expected = weight[v] @ x / weight[v].sum(axis=1, keepdims=True)
        np.testing.assert_allclose(dense(found.where(found.view == v), INPUTS), expected, atol=1e-6)


def test_wide_sums_are_generated_code(world):
    """No object aggregate, however wide the vectors are."""
    _, _, views, vectors = world
    wide = embed.neighbour_mean(views, vectors, 768)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    physical = wide._jdf.queryExecution().sparkPlan().toString()
    assert "Summarizer" not in plan and "HashAggregate(keys=[view" in physical and "block" in physical


def test_forward(spark, world):
    x, weight, views, vectors = world
    weights = embed.formula_weights(INPUTS, WIDTH)
    h, share, z = forward(x, weight, weights)
    found = embed.view_embeddings(embed.mean_shares(views), vectors, weights).persist()
    attention = {(r["view"], r["idx"]): r["weight"] for r in embed.view_attention(found).collect()}
    for k, v in enumerate(VIEWS):
        np.testing.assert_allclose(dense(found.where(found.view == v), WIDTH), h[v], atol=1e-5)
        np.testing.assert_allclose([attention[v, i] for i in range(N)], share[k], atol=1e-5)
    np.testing.assert_allclose(dense(embed.node_embeddings(found, WIDTH), WIDTH), z, atol=1e-5)

    pairs = [(0, 1), (1, 0), (3, 3), (0, 1)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    scored = embed.score_candidates(edges, views, vectors, weights).collect()
    assert len(scored) == 4
    for r in scored:
        hidden = np.maximum(weights.hidden(np.concatenate([z[r["src"]], z[r["dst"]]])), 0)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-weights.output(hidden)[0])), abs=1e-5)
    by_pair = {(r["src"], r["dst"]): r["score"] for r in scored}
    assert by_pair[0, 1] != by_pair[1, 0]


def test_isolated_nodes_keep_their_own_vector(spark):
    nodes = spark.range(2).withColumnRenamed("id", "idx")
    none = spark.createDataFrame([], "src bigint, dst bigint")
    loops = graph.with_self_loops(none, nodes)
    views = loops.selectExpr("'collaboration' AS view", "src", "dst", "w")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx bigint, vec array<float>")
    assert sorted((r["idx"], r["vec"]) for r in embed.neighbour_mean(views, vectors, 1).collect()) == [(0, [1.0]), (1, [2.0])]


def test_vectors_travel_to_parts_not_along_edges(spark, world):
    """Sums are complete in the part of a node: only lists of ends and vectors are exchanged."""
    _, _, views, vectors = world
    plan = embed.neighbour_mean(views, vectors, INPUTS)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not [line for line in exchanges if "hashpartitioning(view" in line and "idx" in line]


def test_a_source_with_many_ends_takes_several_rows(world, monkeypatch):
    x, weight, views, vectors = world
    monkeypatch.setattr(embed, "HUB_ENDS", 2)
    found = embed.neighbour_mean(views, vectors, INPUTS)
    by_view = embed.neighbour_mean(views, found, INPUTS)
    for v in VIEWS:
        mean = weight[v] / weight[v].sum(axis=1, keepdims=True)
        np.testing.assert_allclose(dense(found.where(found.view == v), INPUTS), mean @ x, atol=1e-6)
        np.testing.assert_allclose(dense(by_view.where(by_view.view == v), INPUTS), mean @ mean @ x, atol=1e-6)


def test_copies_and_nodes_without_edges(spark):
    """A node that is there twice counts twice, an edge twice likewise; a node
    without an edge keeps its own part."""
    views = spark.createDataFrame([("citation", 0, 1, 1), ("citation", 0, 1, 1), ("citation", 2, 1, 1)], "view string, src bigint, dst bigint, w bigint")
    vectors = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (2, [5.0])], "idx bigint, vec array<float>")
    assert [(r["idx"], r["vec"]) for r in embed.neighbour_mean(views, vectors, 1).collect()] == [(1, [pytest.approx(13 / 5)])]
    one = embed.Linear(np.ones((1, 1)), np.zeros(1))
    nodes = spark.createDataFrame([(0, [1.0]), (1, [7.0]), (2, [5.0])], "idx bigint, vec array<float>")
    layer = {"citation": embed.SageLayer(one, one)}
    found = {r["idx"]: r["vec"][0] for r in embed.sage_layer(embed.mean_shares(views), nodes, layer).collect()}
    assert found == {0: 1.0, 1: pytest.approx(7 + 7 / 3), 2: 5.0}


def test_attention_makes_the_embeddings_once(world):
    """Not once for each side of a join with the largest logit or the sum."""
    _, _, views, vectors = world
    found = embed.view_embeddings(embed.mean_shares(views), vectors, embed.formula_weights(INPUTS, WIDTH))
    for df in (embed.view_attention(found), embed.node_embeddings(found, WIDTH)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_narrow_means_make_no_lists(spark):
    rows = [("citation", a, b, 1 + a) for a in range(6) for b in range(4)] + [("colleague", 1, 1, 2)]
    views = spark.createDataFrame(rows, "view string, src bigint, dst bigint, w bigint")

    def means(width):
        nodes = spark.createDataFrame([(i, [float(i + k) for k in range(width)]) for i in range(6)], "idx bigint, vec array<double>")
        return embed.narrow_mean(views, nodes, width)

    narrow, wide = means(embed.NARROW), means(embed.NARROW + 1)
    assert "collect_list" not in narrow._jdf.queryExecution().toString()
    found = {(r["view"], r["idx"]): r["vec"] for r in wide.collect()}
    assert len(found) == 5
    for r in narrow.collect():
        assert r["vec"] == pytest.approx(found[r["view"], r["idx"]][: embed.NARROW])


def test_narrow_means_sort_no_edges(spark):
    """The nodes are looked up by hash, by the source before the view."""
    views = spark.createDataFrame([("citation", 0, 1, 1), ("citation", None, 1, 1)], "view string, src bigint, dst bigint, w bigint")
    by_view = spark.createDataFrame([("citation", 0, [2.0]), ("citation", 0, [4.0])], "view string, idx bigint, vec array<double>")
    found = embed.narrow_mean(views, by_view, 1)
    assert [tuple(r) for r in found.collect()] == [("citation", 1, [3.0])]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [src" in plan and "SortMergeJoin" not in plan
