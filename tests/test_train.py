"""Training on edges whose label the vectors determine."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from twinedge.plans import train
from twinedge.sources import runs
from twinedge.sources.store import stored_models


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    nodes = [(i, rng.normal(size=2).tolist()) for i in range(300)]
    sign = {i: v[0] > 0 for i, v in nodes}
    edges = [
        (("train", "train", "train", "valid", "test")[n % 5], int(sign[a] == sign[b]), int(a), int(b))
        for n, (a, b) in enumerate(rng.integers(0, 300, size=(1500, 2)))
    ]
    nodes = spark.createDataFrame(nodes, "idx bigint, vec array<double>")
    edges = spark.createDataFrame(edges, "split string, label int, src bigint, dst bigint")
    return train.edge_vectors(edges, nodes).persist()


def test_learns_and_stops_early(spark, vectors, tmp_path):
    found = train.train_edge_scorer(vectors, str(tmp_path), "r", hidden=8, rounds=8, iterations=15, patience=2)
    history = {(r["epoch"], r["split"], r["metric"]): r["value"] for r in found.metrics(spark).collect()}
    losses = {e: v for (e, split, metric), v in history.items() if split == "valid" and metric == "loss"}
    best = min(losses, key=lambda e: (losses[e], -e))
    assert found.model_path.endswith(f"epoch{best}")
    # the patience is spent once in the best round itself
    assert max(losses) == 8 or max(losses) == best + 1
    assert losses[best] < losses[1]
    tested = {r["metric"]: r["value"] for r in train.evaluate_edge_scorer(found, vectors).collect()}
    assert tested["accuracy"] > 85
    assert tested["tn"] + tested["fp"] + tested["fn"] + tested["tp"] == 300


def test_means_of_one_and_two_steps(spark):
    nodes = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "idx bigint, vec array<double>")
    loops = [(v, i, i, 1) for v in train.VIEWS for i in range(3)]
    views = spark.createDataFrame(loops + [("citation", 0, 1, 1), ("citation", 1, 2, 3)], "view string, src bigint, dst bigint, w bigint")
    found = {r["idx"]: r["vec"] for r in train.propagated_features(views, nodes, 1).collect()}
    k = 1 + 2 * list(train.VIEWS).index("citation")
    for i, (one, two) in enumerate([(0.0, 0.0), (0.5, 0.25), (1.25, 0.6875)]):
        expected = [float(i)] * 9
        expected[k], expected[k + 1] = one, two
        assert found[i] == pytest.approx(expected)


def test_resumed_run_equals_one_without_cut(spark, vectors, tmp_path):
    options = {"hidden": 4, "iterations": 5, "patience": 50}
    root = str(tmp_path)
    whole = train.train_edge_scorer(vectors, root, "whole", rounds=6, **options)
    first = train.train_edge_scorer(vectors, root, "cut", rounds=4, **options)
    kept = first.model_path
    again = train.train_edge_scorer(vectors, root, "cut", rounds=6, **options)

    def history(t):
        return {tuple(r)[1:4]: r["value"] for r in t.metrics(spark).collect()}

    assert history(again) == pytest.approx(history(whole), abs=1e-6)
    assert again.model_path.rsplit("/", 1)[1] == whole.model_path.rsplit("/", 1)[1]
    # two runs side by side, each with one model; nothing is left to do for either
    for run in ("whole", "cut"):
        assert len(stored_models(spark, f"{root}/{run}/models")) == 1
    assert train.train_edge_scorer(vectors, root, "cut", rounds=6, **options) == again
    assert runs.stored_runs(spark, root) == ["cut", "whole"]
    assert train.stored_scorer(spark, root, "whole") == whole
    assert kept.rsplit("/", 1)[0] == again.model_path.rsplit("/", 1)[0]


def test_a_round_is_committed_once(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path), "r")
    assert store.latest() is None and store.best_model() is None and store.metrics().count() == 0
    for n in (1, 2, 3, 4):
        store.commit(runs.RunState(n, 1, [0.5, float(n)], [(k, "valid", "loss", 1.0 / k) for k in range(1, n + 1)]))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store.commit(runs.RunState(4, 1, [9.0], []))
    latest = store.latest()
    assert (latest.round, latest.weights, latest.losses()) == (4, [0.5, 4.0], {k: 1.0 / k for k in range(1, 5)})
    # a state that was written but not committed does not count, nor an empty commit
    (tmp_path / "r" / "commits" / "5").touch()
    assert store.committed_round() == 4
    store.commit(runs.RunState(5, 1, [1.0], []))
    assert store.latest().weights == [1.0]
    assert sorted({p.name.split("-")[0] for p in (tmp_path / "r" / "states").iterdir()}) == ["4", "5"]
    with pytest.raises(FileNotFoundError):
        train.stored_scorer(spark, str(tmp_path), "other")


def test_rounds_read_the_vectors_once(spark, vectors, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(label):
        seen.add(1)
        return label

    fitted_and_judged = vectors.where("split <> 'test'").count()
    train.train_edge_scorer(vectors.withColumn("label", counted("label")), str(tmp_path), "r", hidden=2, rounds=3, iterations=2)
    assert seen.value == fitted_and_judged


def test_sums_agree_with_the_scorer_and_with_differences(spark, vectors):
    width, hidden = 4, 3
    weights = np.random.default_rng(5).normal(size=width * hidden + hidden + hidden * 2 + 2)
    blocks = train.packed(vectors, width).persist()
    found = train.edge_sums(blocks, ("train", "valid"), weights, width, hidden)
    assert set(found) == {"train", "valid"}
    n, loss, hits, slope = found["valid"]
    scored = train.with_scores(train.scorer_of(spark, width, hidden, weights), vectors.where("split = 'valid'"))
    row = scored.agg(F.count("score"), F.sum(train.bce_term()), F.sum(train.hit_term())).first()
    assert (n, loss, hits) == (row[0], pytest.approx(row[1], rel=1e-6), row[2])
    for k in (0, width * hidden, len(weights) - 1):
        near = [train.edge_sums(blocks, ("valid",), weights + h * np.eye(len(weights))[k], width, hidden)["valid"][1] for h in (1e-4, -1e-4)]
        assert slope[k] == pytest.approx((near[0] - near[1]) / 2e-4, rel=1e-4, abs=1e-4)


def test_descends_to_the_minimum():
    scale = np.array([1.0, 10.0, 100.0])
    found = train.descend(lambda w: (float(scale @ (w - 3) ** 2), 2 * scale * (w - 3)), np.zeros(3), 40)
    assert found == pytest.approx([3.0] * 3, abs=1e-4)


def test_labels_and_splits_that_cannot_be_fitted(spark, vectors, tmp_path):
    longer = vectors.withColumn("features", F.when(F.col("src") == 7, array_to_vector(F.array_repeat(F.lit(1.0), 8))).otherwise(F.col("features")))
    refused = (
        (vectors.withColumn("label", F.lit(2)), "labels must be 0 or 1"),
        (vectors.where("split = 'valid'"), "'train' is empty"),
        (longer, "every vector must hold"),
    )
    for rows, message in refused:
        with pytest.raises(Exception, match=message):
            train.train_edge_scorer(rows, str(tmp_path), message, hidden=2, rounds=1)


def test_no_weights_are_read_twice(spark, vectors, tmp_path, monkeypatch):
    """A round begins and is judged where the last descent ended."""
    seen = []
    sums = train.edge_sums

    def counted(blocks, splits, weights, width, hidden):
        seen.extend((split, weights.tobytes()) for split in splits)
        return sums(blocks, splits, weights, width, hidden)

    monkeypatch.setattr(train, "edge_sums", counted)
    train.train_edge_scorer(vectors, str(tmp_path), "r", hidden=2, rounds=3, iterations=3, patience=9)
    assert len(seen) == len(set(seen)) and sum(split == "valid" for split, _ in seen) == 3


def test_runs_share_what_was_packed_once(spark, vectors, tmp_path):
    options = {"hidden": 3, "rounds": 2, "iterations": 3}
    plain = vectors.withColumn("features", vector_to_array("features"))
    edges = train.PackedEdges.of(plain)
    shared = [train.train_edge_scorer(edges, str(tmp_path), run, **options) for run in ("a", "b")]
    edges.release()
    whole = train.train_edge_scorer(vectors, str(tmp_path), "c", **options)

    def history(t):
        return {tuple(r)[1:4]: r["value"] for r in t.metrics(spark).collect()}

    assert history(shared[0]) == history(shared[1]) == pytest.approx(history(whole))
    # vectors and plain arrays are judged alike
    found = [{r["metric"]: r["value"] for r in train.evaluate_edge_scorer(whole, v).collect()} for v in (vectors, plain)]
    assert found[0] == pytest.approx(found[1])
