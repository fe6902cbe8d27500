"""From raw text to the evaluations, on the smallest tables."""

import pytest

from twinedge import __main__ as cli
from twinedge.operators.embed import formula_weights, save_weights
from twinedge.plans.entities import EntityGraph, build_graph, weights_scorer
from twinedge.plans.fixture import DerivedGraph
from twinedge.plans.queries import write_raw
from twinedge.plans.train import stored_scorer
from twinedge.schema import RAW_DATASETS
from twinedge.sources.runs import stored_runs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw_dir(spark):
    return write_raw(DerivedGraph(spark, SMALL), *RAW_DATASETS)


def test_raw_to_evaluations(spark, raw_dir, tmp_path, capsys):
    store = str(tmp_path / "graph")
    with pytest.raises(ValueError, match="writes_rels"):
        EntityGraph.open(spark, raw_dir, store)
    entities = EntityGraph.open(spark, raw_dir, store, tolerance=10_000)
    drops = {r["dataset"]: (r["malformed"], r["unknown_src"], r["unknown_dst"]) for r in entities.drops().collect()}
    assert drops["authors"] == (4, 0, 0) and drops["publications"] == (0, 0, 0) and drops["writes_rels"][2] > 0
    assert entities.store.report("quarantine").count() == 4
    assert entities.store.report("unresolved").count() == sum(n for *_, n in drops.values())
    assert entities.edges("similar").count() == 870
    assert entities.authors.count() == 150
    sizes = {(r["split"], r["label"]): r["n"] for r in entities.splits().groupBy("split", "label").agg({"copies": "sum"}).toDF("split", "label", "n").collect()}
    assert sizes == {(s, y): n for s, n in (("train", 88), ("valid", 29), ("test", 30)) for y in (0, 1)}

    sweep = entities.evaluate_thresholds(weights_scorer(formula_weights(64, 8))).collect()
    assert len(sweep) == 11
    assert {r["threshold"]: r["edges"] for r in sweep}[0.0] == 580

    model = str(tmp_path / "model")
    common = ["--raw", raw_dir, "--graph", store, "--model", model]
    for run, rounds in (("one", "2"), ("two", "1"), ("two", "2")):
        cli.main(["train", *common, "--width", "4", "--hidden", "4", "--rounds", rounds, "--run", run])
    assert stored_runs(spark, model) == ["one", "two"]
    assert all(stored_scorer(spark, model, run).model().weights.size for run in ("one", "two"))
    cli.main(["sweep", *common])
    cli.main(["inspect", *common, "--run", "one"])
    cli.main(["evaluate", *common, "--run", "one"])
    shown = capsys.readouterr().out
    assert "accuracy" in shown and "loss" in shown
    save_weights(spark, formula_weights(64, 8), str(tmp_path / "weights"))
    cli.main(["sweep", "--raw", raw_dir, "--graph", store, "--weights", str(tmp_path / "weights")])
    assert "singleton_fraction" in capsys.readouterr().out
    assert "valid" in shown and "singleton_fraction" in shown and "balanced_accuracy" in shown


def test_incomplete_raw_data_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        build_graph(spark, str(tmp_path))
