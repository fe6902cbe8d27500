import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinedge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def micro(spark):
    """Six author records, four publications, by hand."""
    edges = "src bigint, dst bigint"
    pubs = {"writes": [(0, 10), (1, 10), (1, 11), (2, 11), (3, 12), (4, 13)], "cites": [(10, 11), (11, 12), (12, 11)]}
    tables = {name: spark.createDataFrame(rows, edges) for name, rows in pubs.items()}
    tables["is_written_by"] = tables["writes"].selectExpr("dst AS src", "src AS dst")
    return {
        "nodes": spark.range(6).withColumnRenamed("id", "idx"),
        "edges": tables,
        "candidates": spark.createDataFrame([(1, 0), (0, 1), (4, 3), (3, 3)], edges),
        "identities": spark.createDataFrame(
            list(enumerate(["A", "A", "A", "", "", "B"])), "idx bigint, orcid string"
        ),
    }
