"""Hand-checked values on the micro graph."""

import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from twinedge.operators import blocking, graph, labels, metrics
from twinedge.operators.components import connected_components
from twinedge.plans.sweep import best_threshold, threshold_stats, threshold_sweep

CITATION = [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 3), (3, 1), (3, 2)]


@pytest.fixture(scope="module")
def grouped(spark, micro):
    groups = connected_components(micro["nodes"], micro["candidates"])
    return micro["identities"].join(groups, "idx").persist()


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.5), (0, 0.1)], "label int, score double")


def test_metapath(micro):
    assert rows(graph.metapath(micro["edges"], ["writes", "cites", "is_written_by"])) == CITATION


@pytest.mark.parametrize("side", [1, 2, 3])
def test_metapath_grid_for_hubs_gives_the_same(micro, side):
    found = graph.metapath(micro["edges"], ["writes", "cites", "is_written_by"], hub_output=1, side=side)
    assert rows(found) == CITATION


def test_grid_on_a_real_hub(spark):
    # publication 0 is linked to 300 authors and to 200 publications
    writes = spark.range(300).selectExpr("id AS src", "0L AS dst")
    cites = spark.range(200).selectExpr("0L AS src", "id + 1 AS dst")
    back = spark.range(200).selectExpr("id + 1 AS src", "id % 7 AS dst")
    edges = {"writes": writes, "cites": cites, "is_written_by": back}
    path = ["writes", "cites", "is_written_by"]
    expected = rows(graph.metapath(edges, path))
    assert len(expected) == 300 * 7
    assert rows(graph.metapath(edges, path, hub_output=1000, side=50)) == expected


def test_self_loops(micro):
    view = graph.metapath(micro["edges"], ["writes", "cites", "is_written_by"])
    weights = {(s, d): w for s, d, w in rows(graph.with_self_loops(view, micro["nodes"]))}
    assert len(weights) == 13
    assert weights[1, 1] == 2 and weights[4, 4] == 1 and weights[5, 5] == 1
    assert all(w == 1 for pair, w in weights.items() if pair != (1, 1))


def test_components(grouped):
    assert rows(grouped.select("idx", "component")) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 5)]


def test_pairs_and_agreement(grouped):
    pairs = [blocking.pair_counts(grouped, *k).first()[0] for k in (["orcid"], ["component"], ["orcid", "component"])]
    assert pairs == [4, 2, 2]
    assert blocking.pairwise_prf(grouped, "orcid", "component").first().asDict() == pytest.approx(
        {"precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    )
    report = blocking.blocking_report(grouped, "orcid", "component").first().asDict()
    assert report == pytest.approx(
        {
            "blocks": 4, "singletons": 2, "homogeneity": 1.0, "completeness": 0.760648, "v_measure": 0.864055,
            "nmi": 0.864055, "rand_index": 0.866667, "adjusted_rand_index": 0.594595,
        },
        abs=1e-6,
    )
    assert blocking.reduction_ratio(grouped, "component").first()[0] == pytest.approx(0.866667, abs=1e-6)
    assert blocking.block_count(grouped, "component").first()[0] == 4
    assert blocking.singleton_blocks(grouped, "component").first()[0] == 2


def test_agreement_of_trivial_groupings(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a")], "p int, t string")
    assert set(blocking.blocking_quality(one, "t", "p").first()) == {1.0}
    apart = spark.createDataFrame([(1, "a"), (2, "b")], "p int, t string")
    assert set(blocking.blocking_quality(apart, "t", "p").first()) == {1.0}
    assert blocking.pairwise_prf(apart, "t", "p").first() == (0.0, 0.0, 0.0)
    single = apart.limit(1)
    assert blocking.reduction_ratio(single, "p").first()[0] is None
    assert blocking.blocking_report(single, "t", "p").first()["rand_index"] == 1.0


def test_null_label_is_a_label_of_its_own(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, None), (2, "x")], "p int, t string")
    assert blocking.block_count(df, "t").first()[0] == 3
    assert blocking.pair_counts(df, "t").first()[0] == 1
    # pairs: true 1 (two nulls), predicted 3, common 1
    assert blocking.pairwise_prf(df, "t", "p").first()["precision"] == pytest.approx(1 / 3)


def test_pair_counts_beyond_long(spark):
    from twinedge.functions.scalar import pairs_of

    n = 7 * 10**10
    big = spark.createDataFrame([(n,)], "n bigint").select(pairs_of("n")).first()[0]
    assert int(big) == n * (n - 1) // 2


def test_scores(scored):
    assert metrics.round_accuracy(scored).first()[0] == 75.0
    assert [r[2] for r in rows(metrics.confusion_matrix(scored))] == [2, 0, 1, 1]
    assert metrics.bce_loss(scored).first()[0] == pytest.approx(0.455040, abs=1e-6)
    assert metrics.roc_auc(scored).first() == pytest.approx((0.75, 0.25))


def test_other_losses(spark):
    pairs = spark.createDataFrame([(0.9, 0.5), (0.4, 0.1)], "pos_score double, neg_score double")
    assert metrics.margin_loss(pairs).first()[0] == pytest.approx(0.65)
    distances = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.5), (0, 0.1)], "label int, distance double")
    assert metrics.contrastive_loss(distances).first()[0] == pytest.approx(0.5075)
    logits = spark.createDataFrame([(1, 800.0), (0, 800.0), (1, 0.0)], "label int, logit double")
    assert metrics.bce_logits_loss(logits).first()[0] == pytest.approx((0 + 800 + math.log(2)) / 3)
    hard = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, 1.0)], "label int, score double")
    assert metrics.bce_loss(hard).first()[0] == pytest.approx(200 / 3)


def test_undefined_metrics_are_null(spark):
    empty = spark.createDataFrame([], "label int, score double")
    assert set(metrics.confusion_metrics(metrics.confusion_counts(empty)).first()) == {None}
    assert metrics.roc_auc(empty).first() == (None, None)
    one_class = spark.createDataFrame([(1, 0.3)], "label int, score double")
    assert metrics.roc_auc(one_class).first()["auc"] is None
    counts = metrics.simrel_counts(empty).first()
    assert tuple(counts) == (0, 0, 0, None)


def test_nan_never_survives(spark):
    scored = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 0.5), (0, 3, 0.4)], "src bigint, dst bigint, score double")
    assert [r["dst"] for r in metrics.prune_edges(scored, 0.5).collect()] == [2]
    assert metrics.binarise(scored).where("above = 1").count() == 0


def test_labels_keep_copies_and_order(spark):
    candidates = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "src bigint, dst bigint")
    truth = spark.createDataFrame([(0, 1), (0, 1)], "src bigint, dst bigint")
    assert rows(labels.label_candidates(candidates, truth)) == [(0, 1, 1), (0, 1, 1), (1, 0, 0)]


def test_sweep_edge_cases(spark, micro):
    scored = spark.createDataFrame(
        [(0, 1, 0.5), (1, 2, float("nan")), (3, 4, 0.49), (3, 4, 0.8), (5, 5, 1.0)],
        "src bigint, dst bigint, score double",
    )
    truth = spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")
    result = {r["threshold"]: r for r in threshold_sweep(scored, truth, micro["identities"], [0.0, 0.5, 0.9, 1.0]).collect()}
    assert [result[t]["edges"] for t in (0.0, 0.5, 0.9, 1.0)] == [4, 3, 1, 1]
    assert [result[t]["groups"] for t in (0.0, 0.5, 0.9, 1.0)] == [4, 4, 6, 6]
    assert result[0.5]["simrels_accuracy"] == pytest.approx(1 / 3)
    assert (result[0.5]["precision"], result[0.5]["recall"]) == (1.0, 0.5)
    assert (result[0.9]["precision"], result[0.9]["f1"]) == (0.0, 0.0)
    assert result[0.9]["singleton_fraction"] == 1.0


def test_sweep_without_candidates(spark, micro):
    none = spark.createDataFrame([], "src bigint, dst bigint, score double")
    result = threshold_sweep(none, none.select("src", "dst"), micro["identities"], [0.2, 0.1]).orderBy("threshold").collect()
    assert [tuple(r) for r in result] == [(t, 0, None, 6, 1.0, 0.0, 0.0, 0.0) for t in (0.1, 0.2)]


def test_sweep_agrees_with_single_threshold(spark, micro):
    scored = spark.createDataFrame(
        [(i, j, ((i * 7 + j * 3) % 10) / 10) for i in range(6) for j in range(i)], "src bigint, dst bigint, score double"
    )
    truth = micro["candidates"]
    swept = {r["threshold"]: r for r in threshold_sweep(scored, truth, micro["identities"]).collect()}
    for t in (0.3, 0.7):
        edges = metrics.prune_edges(scored, t)
        groups = connected_components(micro["nodes"], edges)
        stats = threshold_stats(edges, truth, micro["identities"], groups).first().asDict()
        assert {k: swept[t][k] for k in stats} == pytest.approx(stats)


def test_best_threshold_takes_the_lowest_of_equals(spark):
    sweep = spark.createDataFrame([(0.1, 0.5), (0.2, 0.9), (0.3, 0.9)], "threshold double, f1 double")
    assert tuple(best_threshold(sweep).first()) == (0.2, 0.9)


def test_integrity(spark, micro):
    def report(idx, edges):
        nodes = {
            "author": spark.createDataFrame([(i, [0.0] * w) for i, w in idx], "idx bigint, feat array<double>"),
            "publication": spark.range(14).select(F.col("id").alias("idx"), F.array(F.lit(0.0)).alias("feat")),
        }
        table = spark.createDataFrame(edges, "etype string, src bigint, dst bigint")
        return graph.integrity_report(nodes, table)

    sound = report([(0, 2), (1, 2)], [("writes", 1, 13)])
    graph.require_intact(sound)
    broken = report([(0, 2), (2, 2), (2, 3)], [("writes", 5, 13), ("cites", 0, 14)])
    found = {(r["check"], r["subject"]): r["violations"] for r in broken.collect()}
    assert found["unique", "author"] == 1 and found["feature_width", "author"] == 1
    assert found["contiguous", "author"] == 0  # three rows, highest index 2: the copy shows as not unique
    assert found["edge_range", "writes"] == 1 and found["edge_range", "cites"] == 1
    with pytest.raises(ValueError):
        graph.require_intact(broken)


def test_keys_are_counted_only_where_a_bucket_is_full(micro):
    """And copies of walks count once in a view, copies of other links each."""
    frontier = micro["edges"]["writes"].selectExpr("src AS start", "dst AS at")
    cites = micro["edges"]["cites"]
    assert graph._hubs(frontier, cites, 50, 5) is None
    assert {r["key"] for r in graph._hubs(frontier, cites, 1, 5).collect()} == {10, 11}
    twice = {t: e.union(e) for t, e in micro["edges"].items()}
    twice |= {"coprojected": twice["cites"], "collaborates": twice["writes"], "potentially_equates": twice["writes"]}
    nodes = micro["nodes"]
    found = graph.author_views(twice, nodes)
    by_path = graph.with_self_loops(graph.metapath(twice, ["writes", "cites", "is_written_by"]), nodes)
    plain = graph.with_self_loops(twice["writes"], nodes)
    for view, expected in (("citation", by_path), ("collaboration", plain)):
        assert rows(found.where(found.view == view).select("src", "dst", "w")) == rows(expected.select("src", "dst", "w"))
