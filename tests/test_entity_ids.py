"""Whole numbers for the entities of the tables: no two alike, named by the paths they stand for; hubs from the steps of a fixpoint."""

import pytest
from pyspark.sql import functions as F

from ripple import adapters
from ripple.operators import graph, scoring


def test_named_as_edges(spark, sf_dir):
    ids = adapters.entity_ids(spark, sf_dir)
    assert dict(ids.dtypes) == {"repo": "string", "src": "bigint", "dst": "bigint"}
    named = ids.select("repo", adapters.entity_path("src").alias("src"), adapters.entity_path("dst").alias("dst"))
    paths = adapters.entity_edges(spark, sf_dir)
    assert named.exceptAll(paths).isEmpty() and paths.exceptAll(named).isEmpty()


def test_odd_keys(spark):
    keys = spark.createDataFrame([(-3, 1), (0, 0), (1 << 43, 65535), (None, 1), (5, None)], "k long, n int")
    got = keys.select(adapters.entity_path(adapters.entity_id("line", "k", "n")).alias("p"), adapters.entity_path(adapters.entity_id("order", "k")).alias("q")).collect()
    assert [x.p for x in got] == ["line/-3-1", "line/0-0", f"line/{1 << 43}-65535", None, None]
    assert [x.q for x in got] == ["order/-3", "order/0", f"order/{1 << 43}", None, "order/5"]
    with pytest.raises(Exception, match="beyond its bits"):
        keys.select(adapters.entity_id("line", "k", F.lit(1 << 16))).collect()


def test_hubs_move_nothing(spark):
    edges = spark.createDataFrame([("r", 1, 9), ("r", 1, 9), ("r", 2, 9), ("s", 1, 9), ("r", 3, 8)], "repo string, src long, dst long")
    steps = graph.prepared(edges)
    hubs = scoring.hubs(steps, 2)
    assert [tuple(x) for x in hubs.select("repo", "path", "in_degree").collect()] == [("r", 9, 2)]
    assert "Exchange" not in hubs._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def test_one_repository_is_sorted_by_path(spark):
    """A sort looks at the leading bytes of its first column, which all rows of a repository shared."""
    steps = graph.prepared(spark.createDataFrame([("r", "a", "b")], "repo string, src string, dst string"))
    assert "Sort [path" in steps._jdf.queryExecution().toString()
