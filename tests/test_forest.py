"""The merge forest against components per level."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from twinedge.operators.components import linked_nodes, undirected
from twinedge.operators.forest import groups_at, memberships, merge_forest
from twinedge.plans.sweep import reached, threshold_stats, threshold_sweep


def graphs():
    draw = random.Random(5)
    path = [(k, k + 1, draw.randint(1, 9)) for k in range(60)]
    rising = [(k, k + 1, 1 + k // 7) for k in range(60)]
    star = [(0, k, draw.randint(0, 9)) for k in range(1, 50)]
    mixed = [(draw.randrange(70), draw.randrange(70), draw.randint(0, 9)) for _ in range(150)]
    clique = [(a, b, 4) for a in range(12) for b in range(12)]
    return {"path": path, "rising": rising, "star": star, "mixed": mixed + mixed[:20], "clique": clique + [(3, 40, 2)], "empty": [], "loops": [(1, 1, 3)]}


@pytest.mark.parametrize("name", graphs())
def test_groups_of_every_level(spark, name):
    edges = spark.createDataFrame(graphs()[name], "src bigint, dst bigint, level int").cache()
    forest = merge_forest(edges, 9)
    members = memberships(forest, 9).cache()
    for level in (1, 2, 4, 5, 9):
        expected = rows(linked_nodes(undirected(edges.where(F.col("level") >= level))))
        assert rows(groups_at(members, level)) == expected, level
    # every level of a node is covered once
    assert members.groupBy("idx").agg(F.sum(F.col("joined") - F.col("lost")).alias("n")).where("n <> 9").count() == 0


@pytest.mark.parametrize("levels", [11, 1000])
def test_rows_do_not_grow_with_levels(spark, levels):
    """In each round hooks and edges left are no more than the edges before, and
    all hooks together no more than the edges that came in."""
    draw = random.Random(levels)
    edges = spark.createDataFrame([(draw.randrange(300), draw.randrange(300), draw.randint(1, levels)) for _ in range(900)], "src bigint, dst bigint, level int")
    forest = merge_forest(edges, levels)
    assert all(hooks + left <= before for before, hooks, left in forest.written)
    assert [w[0] for w in forest.written[1:]] == [w[2] for w in forest.written[:-1]] and forest.written[-1][2] == 0
    assert sum(w[1] for w in forest.written) <= forest.written[0][0] <= 900
    assert memberships(forest, levels).count() <= 300 * (len(forest.written) + 1)


def sweep_inputs(spark, digits):
    draw = random.Random(digits)
    scored = [(a, b, round(draw.random(), digits)) for a, b in {(draw.randrange(80), draw.randrange(80)) for _ in range(200)}]
    scored += [(1, 2, float("nan")), (5, 5, 0.9), scored[0]]
    identities = [(k, ["", None, "x"][k % 3] if k % 5 == 0 else f"o{k // 4}") for k in range(90)]
    truth = [(a, b) for a, b, _ in scored if a // 4 == b // 4]
    return (
        spark.createDataFrame(scored, "src bigint, dst bigint, score double"),
        spark.createDataFrame(truth, "src bigint, dst bigint"),
        spark.createDataFrame(identities, "idx bigint, orcid string"),
    )


@pytest.mark.parametrize("thresholds", [[0.0, 0.25, 0.5, 0.75, 1.0], [k / 1000 for k in range(1001)]])
def test_sweep_equals_one_threshold_at_a_time(spark, thresholds):
    from twinedge.operators.components import connected_components
    from twinedge.operators.metrics import prune_edges

    scored, truth, identities = sweep_inputs(spark, 2 if len(thresholds) < 10 else 3)
    found = {r["threshold"]: r for r in threshold_sweep(scored, truth, identities, thresholds).collect()}
    assert len(found) == len(thresholds)
    for t in (0.0, 0.25, 0.5, 0.75, 1.0):
        edges = prune_edges(scored, t)
        expected = threshold_stats(edges, truth, identities, connected_components(identities, edges)).first()
        for name in expected.asDict():
            assert found[t][name] == pytest.approx(expected[name]), (t, name)
        assert found[t]["edges"] == edges.count()


def test_levels_of_scores(spark):
    cuts = [k / 200 for k in range(201)]
    scores = [-1.0, 0.0, 0.0049, 0.005, 0.5, 0.999, 1.0, 7.0, float("nan"), None]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    for thresholds in (cuts, cuts[::20]):
        found = [r[0] for r in df.select(reached(thresholds)).collect()]
        assert found == [0 if s is None or s != s else sum(s >= t for t in thresholds) for s in scores]
