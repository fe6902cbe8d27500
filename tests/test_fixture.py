"""The derived test graph on rows built here."""

from helpers import rows
from pyspark.sql import functions as F

from twinedge.plans.fixture import DerivedGraph, star


def test_star_links_members_to_the_first(spark):
    groups = {"one": [1], "copies": [2, 2], "two": [5, 3], "two and null": [6, None, 7], "three": [9, 8, 10], "a copy more": [11, 12, 12], None: [20, 21]}
    data = [(g, "x", m) for g, members in groups.items() for m in members] + [("two", None, 30), ("two", None, 31)]
    found = star(spark.createDataFrame(data, "g string, h string, m bigint"), ["g", "h"], "m")
    assert found.columns == ["first", "m"]
    assert rows(found) == [(3, 5), (6, 7), (8, 9), (8, 10), (11, 12), (11, 12)]


def test_vectors_of_authors_are_made_in_many_tasks(spark, tmp_path):
    """Though one file, with few bytes an author, is read by one."""
    spark.range(60).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    found = DerivedGraph(spark, str(tmp_path)).author_features
    assert found.count() == 60
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
