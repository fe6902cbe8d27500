"""Growing components, mergeable counts, reasons of a quarantine."""

import random

from helpers import rows
from pyspark.sql import functions as F

from twinedge.operators.components import linked_nodes, undirected
from twinedge.operators.incremental import ComponentStore
from twinedge.operators.sketches import estimated_labels, label_sketches
from twinedge.sources import raw

EDGES = "src bigint, dst bigint"


def test_batches_equal_one_run(spark, tmp_path):
    """After each of five batches, with joins of old components, repeated edges,
    new nodes below old ones, loops and nulls."""
    draw = random.Random(2)
    batches = [[(draw.randrange(20, 200), draw.randrange(20, 200)) for _ in range(30)] for _ in range(3)]
    batches += [batches[0] + [(0, 25), (5, 5), (None, 3), (7, None)], []]
    store = ComponentStore(spark, str(tmp_path / "c"))
    assert store.labels().count() == 0
    so_far = []
    for batch in batches:
        store.add(spark.createDataFrame(batch, EDGES))
        so_far += [(a, b) for a, b in batch if a is not None and b is not None]
        expected = dict(rows(linked_nodes(undirected(spark.createDataFrame(so_far, EDGES)))))
        found = dict(rows(store.labels()))
        assert len(found) == store.labels().count()
        assert {k: v for k, v in found.items() if k in expected} == expected
        assert all(k == v for k, v in found.items() if k not in expected)  # only loops


def test_a_batch_reads_no_earlier_edges(spark, tmp_path):
    """Labels of a batch hold its new nodes only; moves hold merged components only."""
    store = ComponentStore(spark, str(tmp_path / "c"))
    store.add(spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)], EDGES))
    store.add(spark.createDataFrame([(1, 2), (100, 101)], EDGES))
    _, folders, moves = store._state()
    assert [spark.read.parquet(f"{tmp_path}/c/{f}").count() for f in folders] == [40, 2]
    assert rows(spark.read.parquet(f"{tmp_path}/c/{moves}")) == [(2, 0)]
    store.add(spark.createDataFrame([(3, -5)], EDGES))
    assert {r["idx"]: r["component"] for r in store.labels().collect() if r["idx"] < 4} == {k: -5 for k in (-5, 0, 1, 2, 3)}


def test_sketches_unite_in_any_order(spark):
    records = spark.range(30000).select((F.col("id") % 7).alias("part"), (F.col("id") % 3).alias("group"), F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919) % 27011).alias("label"))
    parts = label_sketches(records, "label", "group", "part").cache()
    whole = estimated_labels(parts).first()
    assert rows(estimated_labels(parts.orderBy(F.desc("part")))) == rows(estimated_labels(parts.repartition(5))) == [tuple(whole)]
    assert whole["rows"] == 30000
    for subset in ("part < 3", "group = 1", "true"):
        exact = records.where(subset).select("label").distinct().count()
        assert abs(estimated_labels(parts.where(subset)).first()["labels"] - exact) <= 0.02 * exact
    few = label_sketches(spark.createDataFrame([(None,), ("",), ("null",), ("",)], "label string"), "label")
    assert tuple(estimated_labels(few).first()) == (4, 3)


def test_reasons(spark):
    lines = [
        ("('{\"id\": \"a\"}', 3)", None), ("('{\"id\": 5}', 0)", None), ("nonsense", "no tuple"), ("('x', 'y')", "no tuple"), (None, "no tuple"),
        ("('{\"id\": ', 1)", "bad JSON"), ("('', 1)", "bad JSON"), ("('[1]', 1)", "no object"), ("('7', 1)", "no object"), ("('null', 1)", "no object"),
        ("('{}', 1)", "no id"), ("('{\"id\": null}', 1)", "no id"), ("('{\"id\": \"a\"}', -1)", "index out of range"), ("('{\"id\": \"a\"}', 4)", "index out of range"),
        ("('{\"id\": \"a\"}', 99999999999999999999)", "index out of range"), ("(\"{'id': 'a'}\", 1)", "bad JSON"), ("('{\"id\": \"a\\\\u0041\"}', 2)", None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in lines], "value string")
    found = {r["line"]: r["reason"] for r in raw.node_faults(df, 4).collect()}
    assert found == {t: why for t, why in lines if why}
    edges = spark.createDataFrame([("('a', 'b')",), ("('a', 3)",), ("",)], "value string")
    assert rows(raw.edge_faults(edges)) == [("", "no tuple"), ("('a', 3)", "no tuple")]
