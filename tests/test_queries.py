"""Golden values of the derived graph and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from twinedge.plans.fixture import DerivedGraph

SMALL = "/root/testdata/sf0.001"

GOLDEN_COUNTS = {
    "writes": 2992, "collaborates": 2796, "equates": 147, "similar": 870, "similar_for_dedup": 580,
}
# threshold: surviving edges, edge accuracy, groups, singleton fraction, precision, recall, F1
GOLDEN_SWEEP = {
    0.0: (580, 0.168966, 12, 0, 0.172414, 1, 0.294118),
    0.4: (561, 0.174688, 12, 0, 0.172414, 1, 0.294118),
    0.5: (344, 0.284884, 16, 0, 0.194553, 1, 0.325733),
    0.6: (129, 0.759690, 37, 0, 0.454545, 1, 0.625000),
    0.7: (100, 0.980000, 50, 0, 1, 1, 1),
    0.8: (100, 0.980000, 50, 0, 1, 1, 1),
    0.9: (97, 0.979381, 53, 0.02, 1, 0.96, 0.979592),
    1.0: (0, None, 150, 1, 0, 0, 0),
}


@pytest.mark.parametrize("etype", GOLDEN_COUNTS)
def test_golden_counts(spark, etype):
    assert DerivedGraph(spark, SMALL).edges(etype).count() == GOLDEN_COUNTS[etype]


def test_golden_sweep(spark):
    found = {r["threshold"]: tuple(r)[1:] for r in entry.entry(spark).collect()}
    assert len(found) == 11
    for t, expected in GOLDEN_SWEEP.items():
        assert found[t] == pytest.approx(expected)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# one query per module; check.py runs all of them
@pytest.mark.parametrize("name", ["blocking_report", "edge_splits", "roc_auc", "lnfi_key", "resolve_writes", "inspection_report"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    verdict = compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["train_edge_scorer", "evaluate_edge_scorer", "raw_to_graph_drops"])
def test_facts_against_sql(spark, name):
    test_against_sql(spark, name)


def test_runs_from_any_folder(tmp_path):
    """The package reaches the Python workers without a common folder."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        f"for name in ('scan_edges', 'sage_layer', 'edge_scores'): print(name, e.queries()[name](spark, {SMALL!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "edge_scores 870" in done.stdout
